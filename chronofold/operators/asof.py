"""As-of join: to each row of one table the row of another that is nearest in time, by key.

Both tables go through one shuffle by key and lie in one run ordered by time; the last row of the right table is carried
forward over the rows of the left one. There is no join of rows with rows, so nothing multiplies, whatever the number of
rows between two times. A key with over ``hot`` rows of both tables is cut into buckets of time, and what is last in a bucket is handed on
to the buckets after it, a row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .buckets import bucketed, carried, hot_keys

DIRECTIONS = ("backward", "forward", "nearest")


def _names(left: DataFrame, new: list[str]) -> None:
    taken = {c.lower() for c in left.columns}
    if clash := [c for c in new if c.lower() in taken]:
        raise ValueError(f"columns in both tables: {clash}; give a prefix")


def asof_join(
    left: DataFrame, right: DataFrame, on: str | list[str], time: str = "event_us", right_time: str | None = None, values: list[str] | None = None, *,
    direction: str = "backward", strict: bool = False, tolerance: int | None = None, ties: list[str] | None = None, carry: bool = False,
    prefix: str = "", hot: int | None = None,
) -> DataFrame:
    """``left``, each row once and in its columns, with ``values`` of the matching right row and its time, ``{prefix}matched``.

    Times are whole numbers. ``backward`` takes the latest right row at or before the left row's time, ``forward`` the
    earliest at or after it, ``nearest`` the closer of both, the earlier one where they are equally close. With ``strict`` equal
    times don't match; rows farther than ``tolerance`` don't either. Of right rows of one time that counts which is greatest by
    ``ties`` (all values unless given; NULLs are smallest). With ``carry`` each value is the last one that isn't NULL, of whatever row, and its time is
    ``{prefix}{value}_matched``. Keys or times that are NULL match nothing.
    """
    on = [on] if isinstance(on, str) else list(on)
    right_time = right_time or time
    values = [c for c in right.columns if c not in (*on, right_time)] if values is None else list(values)
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    if tolerance is not None and (isinstance(tolerance, bool) or not isinstance(tolerance, int) or tolerance < 0):
        raise ValueError("a tolerance is a whole number, not below zero")
    if direction == "nearest":
        return _nearest(left, right, on, time, right_time, values, strict, tolerance, ties, carry, prefix, hot)
    # the columns that are carried: name, what it is where a row has it
    parts = {v: F.when(F.col(v).isNotNull(), F.struct(F.col("__at"), F.col(v).alias("v"))) for v in values} if carry else {"": F.struct("__at", *values)}
    new = [f"{prefix}{v}" for v in values] + ([f"{prefix}{v}_matched" for v in values] if carry else [f"{prefix}matched"])
    _names(left, new)

    sign = 1 if direction == "backward" else -1
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(on)])
    known = F.lit(True)
    for c in on:
        known &= F.col(c).isNotNull()
    tie = F.struct(*(F.col(c) for c in (values if ties is None else ties)), F.lit(0).alias("none"))
    r = right.where(known & F.col(right_time).isNotNull())
    r = r.select(key.alias("__key"), F.col(right_time).cast("long").alias("__at"), tie.alias("__tie"), *values)
    r = r.select("__key", (sign * F.col("__at")).alias("__t"), "__tie", *[p.alias(f"__p{i}") for i, p in enumerate(parts.values())])
    rows = left.select(key.alias("__key"), (sign * F.col(time).cast("long")).alias("__t"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__row"), (known & F.col(time).isNotNull()).alias("__known"))
    held = [f"__p{i}" for i in range(len(parts))]
    # of equal times, the right rows come first where they count
    both = rows.where("__known").drop("__known").withColumn("__side", F.lit(0 if strict else 1))
    both = both.unionByName(r.withColumn("__side", F.lit(1 if strict else 0)), allowMissingColumns=True)
    buckets = hot_keys(both, "__key", hot, "__t")
    by = ["__key"]
    if buckets is not None:
        by = ["__key", "__b"]
        both = bucketed(both, "__key", buckets, "__t")
        order = F.struct("__t", "__tie")
        latest = {p: F.max_by(p, F.when(F.col(p).isNotNull(), order)) for p in held}
        before = carried(both.where("__row IS NULL"), ["__key"], {}, latest)
    w = W.partitionBy(*by).orderBy("__t", "__side", "__tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = both.withColumns({f"__l{p}": F.last(p, ignorenulls=True).over(w) for p in held}).where("__row IS NOT NULL")
    if buckets is not None:
        out = out.join(before, by, "left").withColumns({f"__l{p}": F.coalesce(f"__l{p}", f"__0{p}") for p in held})
    alone = rows.where("NOT coalesce(__known, false)")
    out = out.select("__t", "__row", *[f"__l{p}" for p in held]).unionByName(alone.select("__t", "__row"), allowMissingColumns=True)
    near = [F.col(f"__l{p}") for p in held]
    if tolerance is not None:
        near = [F.when(F.col("__t") - sign * p["__at"] <= tolerance, p) for p in near]
    cols = [p["v"] for p in near] + [p["__at"] for p in near] if carry else [*[near[0][v] for v in values], near[0]["__at"]]
    return out.select("__row.*", *[c.alias(n) for c, n in zip(cols, new, strict=True)])


def _nearest(left, right, on, time, right_time, values, strict, tolerance, ties, carry, prefix, hot) -> DataFrame:
    both = {"strict": strict, "tolerance": tolerance, "ties": ties, "carry": carry, "hot": hot}
    new = [f"{prefix}{v}" for v in values] + ([f"{prefix}{v}_matched" for v in values] if carry else [f"{prefix}matched"])
    _names(left, new)
    out = asof_join(left, right, on, time, right_time, values, direction="backward", prefix=f"__1{prefix}", **both)
    out = asof_join(out, right, on, time, right_time, values, direction="forward", prefix=f"__2{prefix}", **both)

    def pick(name: str, at: str) -> Column:
        a, b = F.col(f"__1{at}"), F.col(f"__2{at}")
        first = b.isNull() | (F.col(time) - a <= b - F.col(time))
        return F.when(first, F.col(f"__1{name}")).otherwise(F.col(f"__2{name}")).alias(name)

    at = [f"{prefix}{v}_matched" for v in values] * 2 if carry else [f"{prefix}matched"] * len(new)
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *[pick(n, a) for n, a in zip(new, at, strict=True)])
