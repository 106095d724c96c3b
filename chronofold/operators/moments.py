"""Sums and moments of any doubles.

A double is a whole multiple of a power of two, so it is cut, without rounding, into limbs of ``BITS`` bits on fixed places. Limbs of a
place are added as whole numbers, in any order and on any number of tasks, and only the last step, a row a group, rounds:
the total is the double nearest to the exact sum, however rows are partitioned.

Deviations don't come from sums of squares, which lose all digits where values are large and close, but from counts, means and
sums of squared differences from the mean, which are merged as such.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.scalars import check_column
from ..session import reach_workers
from .buckets import bucketed, hot_keys
from .history import prior

#: Bits of a limb: 2^39 rows of a group don't overflow a long. Limbs of a number: 53 bits, up to 23 places higher.
BITS, LIMBS = 24, 4


def limbs(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The places of finite doubles, and the limbs from there up: x is the sum of limb k * 2^(BITS * (place + k))."""
    part, power = np.frexp(np.abs(x))
    whole, mask = (part * 2.0**53).astype(np.int64), (1 << BITS) - 1
    place, shift = np.divmod(power.astype(np.int64) - 53, BITS)
    sign, carry, out = np.where(x < 0, -1, 1), np.zeros(len(x), np.int64), []
    for k in range(LIMBS):
        carry += (whole >> BITS * k & mask) << shift if k < 3 else 0
        out.append(sign * (carry & mask))
        carry >>= BITS
    return place, out


def _limbs_of(by: list[str]):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            place, found = limbs(b.column("__x").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in by], pa.array(place), *map(pa.array, found)], names=[*by, "__p", *[f"__l{k}" for k in range(LIMBS)]])

    return run


def nearest_double(places: list[int], sums: list[int]) -> float:
    """The double nearest to the sum of sums * 2^(BITS * places); infinite past the largest."""
    total = sum((Fraction(s) * Fraction(2) ** (BITS * p) for p, s in zip(places, sums, strict=True)), Fraction(0))
    try:
        return float(total)
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


def exact_sums(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, n, total): how many values there are, and their sum, the double nearest to the exact one; NULL without values.

    NULLs don't count. Infinities and NaN give what adding them gives.
    """
    check_column(df, column)
    reach_workers(df.sparkSession)
    x = F.col(column).cast("double")
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    each = df.groupBy(*by).agg(F.count(x).alias("n"), F.sum(F.when(~finite, x)).alias("__odd"))
    finite_x = df.where(x.isNotNull() & finite & (x != 0)).select(*by, x.alias("__x"))
    schema = StructType([*[StructField(f.name, f.dataType) for f in df.select(*by).schema], *[StructField(c, LongType()) for c in ("__p", *[f"__l{k}" for k in range(LIMBS)])]])
    parts = finite_x.mapInArrow(_limbs_of(by), schema).groupBy(*by, "__p").agg(*[F.sum(f"__l{k}").alias(f"__s{k}") for k in range(LIMBS)])
    parts = parts.select(*by, F.explode(F.array(*[F.struct((F.col("__p") + k).alias("__p"), F.col(f"__s{k}").alias("__s")) for k in range(LIMBS)])).alias("__l")).select(*by, "__l.*")
    parts = parts.groupBy(*by).agg(F.collect_list(F.struct("__p", "__s")).alias("__parts"))  # some hundred at most

    @F.udf("double")
    def total(rows):
        return nearest_double([r[0] for r in rows], [r[1] for r in rows])

    found = parts.select(*by, total("__parts").alias("__total"))
    same = F.lit(True)
    for c in by:
        same &= each[c].eqNullSafe(found[c])
    j = each.join(found, same, "left")
    value = F.when(F.col("__odd").isNotNull(), F.col("__odd")).when(F.col("n") > 0, F.coalesce("__total", F.lit(0.0)))
    return j.select(*[each[c] for c in by], "n", value.alias("total"))


def _merge(a, b):
    """Count, mean and sum of squared differences of two sets of values together."""
    n = a["n"] + b["n"]
    d = b["mean"] - a["mean"]
    return F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))


def prior_moments(events: DataFrame, key: str, column: str, hot: int | None = None) -> DataFrame:
    """Adds prior_n, prior_mean and prior_std (of the population) of the key's values strictly before each row's event_us.

    No values: 0, NULL and NULL. Of a hot key (``buckets.hot_keys``) what earlier buckets hold is merged in, a row a bucket.
    """
    check_column(events, column)
    x = F.col(column).cast("double")
    buckets = hot_keys(events, key, hot)
    own = lambda over: F.struct(F.count(x).over(over).cast("double").alias("n"), F.avg(x).over(over).alias("mean"), (F.var_pop(x).over(over) * F.count(x).over(over)).alias("m2"))
    if buckets is None:
        e = events.withColumn("__m", own(prior(key)))
    else:
        e = bucketed(events, key, buckets).drop("__last")
        stats = e.join(buckets.select(key), key, "left_semi").groupBy(key, "__b").agg(F.struct(F.count(x).cast("double").alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2")).alias("m")).where("m.n > 0")
        # for each bucket, all before it: as many structs as a key has buckets
        w = W.partitionBy(key).orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
        zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
        upto = stats.select(key, "__b", F.aggregate(F.collect_list("m").over(w), zero, _merge).alias("__before"), F.lead("__b").over(W.partitionBy(key).orderBy("__b")).alias("__next"))
        last = buckets.select(key, F.size("__cuts").cast("long").alias("__last"))
        upto = upto.join(last, key).where("__b < __last")
        upto = upto.withColumn("__b", F.explode(F.sequence(F.col("__b") + 1, F.coalesce("__next", "__last")))).select(key, "__b", "__before")
        e = e.withColumn("__m", own(prior(key, "__b"))).join(upto, [key, "__b"], "left").drop("__b")
        m, b = F.col("__m"), F.col("__before")
        e = e.withColumn("__m", F.when(b.isNull(), m).when(m["n"] == 0, b).otherwise(_merge(b, m))).drop("__before")
    m = F.col("__m")
    std = F.when(m["n"] > 0, F.sqrt(m["m2"] / m["n"]))
    return e.select(*events.columns, m["n"].cast("long").alias("prior_n"), F.when(m["n"] > 0, m["mean"]).alias("prior_mean"), std.alias("prior_std"))
