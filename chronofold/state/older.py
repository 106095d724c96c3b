"""Reads state documents of older shapes: running moments (count, mean, M2) by user, item and group.

Which shape a document has follows from its fields. Each shape tracks what the one before it does, and more; what one doesn't
track is filled in as unknown: users without a last time have no recency, and no shape has the sums that rolling windows
need, so the state is one without windows. Neither it nor any state advanced from it can become a checkpoint.

Nothing is cast: fields that are missing or unknown, values of other types, keys that repeat, counts or squares below what they can be,
times out of order, and sums that disagree raise ValueError. Ratings are half stars, so sums are read back exactly from means.
"""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import SparkSession

from ..operators.validate import NO_GENRE
from .tables import DOCUMENT, DOCUMENTS, OLD, State, conservation

# The fields of each shape, oldest first.
MOMENTS = {"global", "users", "movies"}
TIMED = MOMENTS | {"lastUserRatings", "movieRatingBatches30d"}
GROUPED = TIMED | {"userGenres"}
TRACKED = GROUPED | {"movieRatingCounts30d", "latestAppliedTimestamp", "timestampTrackingComplete", "genreTrackingComplete", "activityExpirationWatermark", "activityExpiredCount"}
SHAPES = {"moments": MOMENTS, "timed": TIMED, "grouped": GROUPED, "tracked": TRACKED}

_TIME = re.compile(r"(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?")


def shape_of(document: object) -> str:
    if isinstance(document, dict):
        for name, fields in SHAPES.items():
            if set(document) == fields:
                return name
    raise ValueError("the document has no known shape")


def _micros(text: object) -> int:
    found = _TIME.fullmatch(text) if isinstance(text, str) else None
    if not found:
        raise ValueError(f"no time: {text!r}")
    nanos = (found[3] or "").ljust(9, "0")
    if nanos[6:] != "000":
        raise ValueError(f"a time finer than microseconds: {text}")
    since = dt.datetime.fromisoformat(f"{found[1]}T{found[2]}") - dt.datetime(1970, 1, 1)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + int(nanos[:6])


def _whole(value: object, low: int = 1) -> int:
    if type(value) is not int or value < low:
        raise ValueError(f"no whole number from {low}: {value!r}")
    return value


def _sums(row: dict) -> tuple[int, float, float]:
    """Count, sum and sum of squares of half stars from count, mean and M2."""
    n, mean, m2 = row["count"], row["mean"], row["M2"]
    _whole(n, 0)
    if any(isinstance(x, bool) or not isinstance(x, int | float) or not math.isfinite(x) for x in (mean, m2)) or m2 < 0 or (n == 0 and (mean or m2)) or (n == 1 and m2):
        raise ValueError(f"no moments: {row}")
    s, ss = round(2 * n * mean) / 2, round(4 * (m2 + n * mean * mean)) / 4
    if not math.isclose(s, n * mean, abs_tol=1e-6 * max(1, n)) or not math.isclose(ss, m2 + n * mean * mean, abs_tol=1e-6 * max(1, n)):
        raise ValueError(f"no moments of half stars: {row}")
    return n, s, ss


def _table(rows: object, keys: dict, more: set[str]) -> dict:
    """Rows as a dict by their keys; ``keys`` has a check for each."""
    if not isinstance(rows, list) or len(rows) > DOCUMENT:
        raise ValueError("no list of rows that a document may have")
    out = {}
    for row in rows:
        if not isinstance(row, dict) or set(row) != set(keys) | more:
            raise ValueError(f"a row's fields differ: {row}")
        key = tuple(check(row[k]) for k, check in keys.items())
        if key in out:
            raise ValueError(f"a key repeats: {key}")
        out[key] = row
    return out


def _genre(value: object) -> str:
    if not isinstance(value, str) or not value or value.strip() != value or "|" in value or value == NO_GENRE:
        raise ValueError(f"no group: {value!r}")
    return value


def _recent(batches: object) -> dict[int, int]:
    """Counts by item over batches of ascending times; they are checked, and have no sums that windows could use."""
    counts: dict[int, int] = {}
    last = None
    if not isinstance(batches, list):
        raise ValueError("no list of batches")
    for batch in batches:
        if not isinstance(batch, dict) or set(batch) != {"timestamp", "movies"} or not batch["movies"]:
            raise ValueError(f"a batch's fields differ: {batch}")
        us = _micros(batch["timestamp"])
        if last is not None and us <= last:
            raise ValueError("times of batches don't rise")
        last = us
        for (item,), row in _table(batch["movies"], {"movieId": _whole}, {"count"}).items():
            counts[item] = counts.get(item, 0) + _whole(row["count"])
    return counts


def from_older(spark: SparkSession, document: dict, cutoff_us: int | None = None) -> State:
    """The state of a document of an older shape. Its cutoff follows the last time that the document knows; one that knows none, or events
    that lie between, need ``cutoff_us``, which can't be earlier."""
    shape = shape_of(document)
    moments = {"count", "mean", "M2"}
    users = {k[0]: _sums(r) for k, r in _table(document["users"], {"userId": _whole}, moments).items()}
    items = {k[0]: _sums(r) for k, r in _table(document["movies"], {"movieId": _whole}, moments).items()}
    if not isinstance(document["global"], dict) or set(document["global"]) != moments:
        raise ValueError("the whole's fields differ")
    n, s, _ = _sums(document["global"])
    last, groups, recent, known, complete = {}, {}, {}, [], False
    if shape != "moments":
        last = {k[0]: _micros(r["timestamp"]) for k, r in _table(document["lastUserRatings"], {"userId": _whole}, {"timestamp"}).items()}
        recent = _recent(document["movieRatingBatches30d"])
        known = [*last.values(), *[_micros(b["timestamp"]) for b in document["movieRatingBatches30d"]]]
        if set(last) - set(users) or any(c > items.get(i, (0,))[0] for i, c in recent.items()):
            raise ValueError("times of users or counts of items that have no ratings")
    if shape in ("grouped", "tracked"):
        groups = {k: _sums(r) for k, r in _table(document["userGenres"], {"userId": _whole, "genreId": _genre}, moments).items()}
    if shape == "tracked":
        if {k[0]: _whole(r["count"]) for k, r in _table(document["movieRatingCounts30d"], {"movieId": _whole}, {"count"}).items()} != recent:
            raise ValueError("counts of items differ from their batches")
        flags = [document[k] for k in ("timestampTrackingComplete", "genreTrackingComplete")]
        if any(type(f) is not bool for f in flags):
            raise ValueError("flags are true or false")
        _whole(document["activityExpiredCount"], 0)
        for k in ("latestAppliedTimestamp", "activityExpirationWatermark"):
            if document[k] is not None:
                known.append(_micros(document[k]))
        complete = all(flags)
    least = max(known) + 1 if known else None
    if cutoff_us is None and least is None:
        raise ValueError("the document knows no time; a cutoff is needed")
    if cutoff_us is not None and least is not None and cutoff_us < least:
        raise ValueError("the cutoff is before a time of the document")
    rows = {
        "user": [(u, last.get(u, OLD), *m) for u, m in users.items()], "item": [(i, OLD, *m) for i, m in items.items()],
        "group": [(u, g, OLD, *m[:2]) for (u, g), m in groups.items()],
    }
    tables = [spark.createDataFrame(rows[name], schema) for name, schema in DOCUMENTS.items()]
    state = State(least if cutoff_us is None else cutoff_us, n, s, *tables, windows=False, trusted=complete)
    if not conservation(state).first()["ok"]:
        raise ValueError("the document's sums disagree")
    return state
