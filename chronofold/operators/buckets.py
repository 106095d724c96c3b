"""Hot keys cut into buckets of time of about equal depth.

A key with very many rows is cut where its rows are: rows are counted by (key, timestamp), the counts are summed up in
order of time, and a bucket ends at the first timestamp past the rows asked for. So a bucket has fewer than twice so many rows,
a single timestamp with more aside, however the rows lie in time. The sum goes over range partitions with the totals of
earlier ones added, so no task holds a key.

A window by (key, bucket) then sees the bucket; what it must see of earlier ones is summed by bucket and carried forward, a row
a bucket.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.publish import stored

#: Rows of a key from which its time is cut into buckets of about so many rows.
HOT = 1_000_000
#: Numbers of a table that is broadcast, at most; beyond that its joins shuffle.
BROADCAST = 1_000_000
#: Events of a task, about, where what it holds grows with them.
TASK = 250_000
#: Columns of buckets of time that history functions leave there if asked to.
BUCKET = ["__b", "__last"]


def small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """``df`` with the hint to broadcast it, if it has at most ``BROADCAST`` rows, or numbers by ``size`` a row."""
    if df.limit(BROADCAST + 1).count() > BROADCAST:
        return df
    if size is not None and (df.agg(F.sum(size)).first()[0] or 0) > BROADCAST:
        return df
    return F.broadcast(df)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of so many rows, dealt by ``keys`` so that a task has about ``TASK`` of them, where the session's shuffles would have fewer tasks."""
    tasks = -(-rows // TASK)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


@contextlib.contextmanager
def small_reads(spark: SparkSession, rows: int):
    """Inside, tables of files are read by a task for each ``TASK`` of so many rows, where they would be read by fewer; no row is shuffled for that.

    A task takes whole row groups, so it has about that many rows where the files have at most that many.
    """
    key, tasks = "spark.sql.files.minPartitionNum", -(-rows // TASK)
    before = spark.conf.get(key, None)
    if tasks > int(before or spark.sparkContext.defaultParallelism):
        spark.conf.set(key, str(tasks))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def hot_keys(events: DataFrame, key: str, rows: int | None = None, time: str = "event_us") -> DataFrame | None:
    """(key, __cuts, __outer, __step): keys with over ``rows`` rows, with the times at which their buckets after the first begin;
    __outer has every __step-th of them. None if there are no such keys; there are at most events / rows of them, and as many cuts."""
    rows = HOT if rows is None else rows
    if events.limit(rows + 1).count() <= rows:
        return None
    events = events.select(key, F.col(time).alias("__t")).where(F.col(key).isNotNull() & F.col("__t").isNotNull())
    found = stored(events.groupBy(key).count().where(F.col("count") > rows).select(key), "hot-keys")
    if found.isEmpty():
        return None
    counts = events.join(small(found), key, "left_semi").groupBy(key, "__t").agg(F.count("*").alias("__n"))
    counts = stored(counts.repartitionByRange(key, "__t").withColumn("__p", F.spark_partition_id()), "times-of-hot-keys")
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    totals = counts.groupBy(key, "__p").agg(F.sum("__n").alias("__s"))
    totals = totals.select(key, "__p", F.coalesce(F.sum("__s").over(upto(W.partitionBy(key).orderBy("__p"))), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("__n").over(upto(W.partitionBy(key, "__p").orderBy("__t"))), F.lit(0))
    ranks = counts.withColumn("__inside", inside).join(totals, [key, "__p"])
    starts = ranks.groupBy(key, F.floor((F.col("__inside") + F.col("__before")) / rows).alias("__d")).agg(F.min("__t").alias("__t"))
    cuts = starts.groupBy(key).agg(F.array_sort(F.collect_list("__t")).alias("__cuts"))  # rows / HOT of the key
    cuts = cuts.select(key, F.slice("__cuts", 2, F.size("__cuts")).alias("__cuts"))
    cuts = cuts.withColumn("__step", F.ceil(F.sqrt(F.size("__cuts"))).cast("int"))
    outer = F.filter("__cuts", lambda _, i: i % F.col("__step") == 0)
    return small(stored(cuts.select(key, "__cuts", outer.alias("__outer"), "__step"), "cuts"), 2 * F.size("__cuts"))


def bucket_of(time: Column) -> Column:
    """The bucket of a time, by the columns of ``hot_keys``; 0 where these are NULL."""
    upto = lambda array: F.size(F.filter(array, lambda c: c <= time))
    rest = F.transform(F.array(upto("__outer")), lambda i: F.when(i > 0, (i - 1) * F.col("__step") + upto(F.slice("__cuts", (i - 1) * F.col("__step") + 1, F.col("__step")))).otherwise(0))
    return F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(F.element_at(rest, 1)).cast("long")


def bucketed(events: DataFrame, key: str, hot: DataFrame, time: str = "event_us", **more: Column) -> DataFrame:
    """Adds __b, the event's bucket, and of hot keys __last, the key's last one; rows of other keys are one bucket, 0, and have
    NULL there. ``more`` are columns that are buckets of other times of the row."""
    e = events.join(hot, key, "left")
    e = e.withColumns({"__b": bucket_of(F.col(time)), "__last": F.size("__cuts").cast("long")} | {k: F.when(F.col("__cuts").isNotNull(), bucket_of(t)) for k, t in more.items()})
    return e.withColumn("__last", F.when(F.col("__cuts").isNotNull(), F.col("__last"))).drop("__cuts", "__outer", "__step")


def over_buckets(rows: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``rows``, a row a key, once for each bucket of time of the key, so that a join by (key, __b) leaves events where they are."""
    if hot is None:
        return rows
    last = F.when(F.col("__cuts").isNull(), 0).otherwise(F.size("__cuts")).cast("long")
    return rows.join(hot.select(key, "__cuts"), key, "left").withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("__cuts")


def carried(rows: DataFrame, keys: list[str], sums: dict[str, Column], latest: dict[str, Column] | None = None) -> DataFrame:
    """(keys, __b, __0{k}): the sums (of "last", the maximum) of all earlier buckets, for each bucket of hot keys that has some;
    of ``latest``, what the latest earlier bucket has that has any.

    The last bucket of a key is before no other and isn't summed.
    """
    latest = latest or {}
    totals = rows.where(F.col("__b") < F.col("__last")).groupBy(*keys, "__b").agg(F.max("__last").alias("__last"), *[c.alias(k) for k, c in (sums | latest).items()])
    w = W.partitionBy(*keys).orderBy("__b")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    found = [(F.max(k) if k == "last" else F.sum(k)).over(upto).alias(f"__0{k}") for k in sums]
    found += [F.last(k, ignorenulls=True).over(upto).alias(f"__0{k}") for k in latest]
    to = totals.select(*keys, (F.col("__b") + 1).alias("__from"), F.coalesce(F.lead("__b").over(w), F.col("__last")).alias("__to"), *found)
    return to.withColumn("__b", F.explode(F.sequence("__from", "__to"))).drop("__from", "__to")
