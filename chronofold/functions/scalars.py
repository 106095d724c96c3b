"""Scalar expressions: time as microseconds, safe ratios, year parsing, vectors."""

from __future__ import annotations

import numbers

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
# Fixed value: seconds of a mean Gregorian year.
YEAR_SECONDS = 365.2425 * 86_400


def micros(ts: Column | str) -> Column:
    """A naive timestamp as microseconds since the epoch; the session's zone must be UTC."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where den is 0 or either is missing."""
    return num / F.nullif(den, F.lit(0).cast("double"))


def release_year(title: Column | str) -> Column:
    """The year in brackets that ends a title; NULL without one and for 0000."""
    found = F.regexp_extract(F.trim(title), r"\((\d{4})\)$", 1)
    return F.when(~found.isin("", "0000"), found).cast("int")


def age_years(event_us: Column, year: Column) -> Column:
    """Elapsed Gregorian years since the first of January of ``year``; negative before it."""
    start = micros(F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return (event_us - start) / F.lit(1e6) / F.lit(YEAR_SECONDS)


def quarter_label(ts: Column | str) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def iso_nanos(ts: Column | str) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000"))


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def pop_std(n: Column, s: Column, ss: Column) -> Column:
    """Population deviation from count, sum and sum of squares; 0 below two values.

    Half-star ratings are dyadic, so the sums are exact and the result is the same in any order of rows.
    """
    return F.when(n > 1, F.sqrt(F.greatest(n * ss - s * s, F.lit(0.0)) / (n * n))).otherwise(F.lit(0.0))


def check_window_us(window_us: object) -> int:
    """A window in whole microseconds, above zero; booleans, floats and strings are rejected."""
    if isinstance(window_us, bool) or not isinstance(window_us, numbers.Integral):
        raise TypeError("a window is a whole number of microseconds")
    if window_us <= 0:
        raise ValueError("a window is longer than zero")
    return int(window_us)


def check_column(df, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"no column {column}")
