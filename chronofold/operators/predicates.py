"""Point-in-time predicates: history is strictly before the cutoff, a window is [t - w, t)."""

from __future__ import annotations

import datetime as dt
import numbers

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import check_window_us, micros


def check_cutoff(value: object) -> dt.datetime:
    """An absolute naive cutoff: a datetime, a date or an ISO text; numbers, relative words and zones are rejected."""
    if value is None:
        raise ValueError("a cutoff is needed")
    if isinstance(value, bool | numbers.Number):
        raise TypeError("a cutoff is a timestamp, not a number")
    if isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value.strip())
        except ValueError as e:
            raise ValueError(f"not an absolute timestamp: {value!r}") from e
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            raise ValueError("a cutoff has no zone")
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    raise TypeError(f"not a timestamp: {type(value).__name__}")


def cutoff_us(value: object) -> int:
    return (check_cutoff(value) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def strictly_prior(event_us: Column | str, cutoff: object) -> Column:
    return (F.col(event_us) if isinstance(event_us, str) else event_us) < cutoff_us(cutoff)


def in_window(event_us: Column | str, cutoff: object, window_us: int) -> Column:
    t, w = cutoff_us(cutoff), check_window_us(window_us)
    us = F.col(event_us) if isinstance(event_us, str) else event_us
    return (us >= t - w) & (us < t)


def historical(events: DataFrame, cutoff: object, filters: dict | None = None, time: str = "event_us") -> DataFrame:
    """Rows strictly before the cutoff that equal every filter."""
    where = strictly_prior(time, cutoff)
    for name, value in (filters or {}).items():
        if name not in events.columns:
            raise ValueError(f"no column {name}")
        where = where & F.col(name).eqNullSafe(F.lit(value))
    return events.where(where)


def relationship_inputs(events: DataFrame, bridge: DataFrame, cutoff: object, filters: dict | None = None) -> DataFrame:
    """History joined with a many-to-many bridge: a row an association, the event's id kept."""
    return historical(events, cutoff, filters).join(bridge, "item_id")


def split_label(time: Column | str, splits: list[tuple[str, object, object]]) -> Column:
    """Name of the half-open split [start, end) that holds a time; NULL outside; None is open."""
    check_splits(splits)
    us = micros(time) if isinstance(time, str) else time
    out = None
    for name, start, end in splits:
        inside = F.lit(True)
        if start is not None:
            inside = inside & (us >= cutoff_us(start))
        if end is not None:
            inside = inside & (us < cutoff_us(end))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def check_splits(splits: list[tuple[str, object, object]]) -> None:
    """Ordered, not empty, without overlap; open only at the ends."""
    last = None
    for k, (name, start, end) in enumerate(splits):
        if (start is None and k) or (end is None and k < len(splits) - 1):
            raise ValueError(f"{name}: open inside")
        a, b = start and cutoff_us(start), end and cutoff_us(end)
        if a is not None and b is not None and a >= b:
            raise ValueError(f"{name}: empty")
        if last is not None and a < last:
            raise ValueError(f"{name}: overlaps the one before")
        last = b


def stride_sample(df: DataFrame, key: str, stride: int) -> DataFrame:
    if stride < 1:
        raise ValueError("a stride is 1 or more")
    return df.where(F.col(key) % stride == 0)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for a seed at any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def allow_columns(df: DataFrame, names: list[str], forbidden: set[str]) -> DataFrame:
    """Exactly ``names``; fails if one of them is forbidden or missing."""
    if leak := forbidden & set(names):
        raise ValueError(f"leaks {sorted(leak)}")
    if missing := set(names) - set(df.columns):
        raise ValueError(f"missing {sorted(missing)}")
    return df.select(*names)
