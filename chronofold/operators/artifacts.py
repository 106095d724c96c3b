"""Audits of materialised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import Feature


def id_bits(table: DataFrame, column: str = "event_id") -> DataFrame:
    """(bucket, bits, n): the ids of a table as a bitmap of 32,768 ids a row, with how many rows have one of them.

    Bits are set before the shuffle, so that a row a bucket and task goes through it, not a row an id.
    """
    id_ = F.col(column).cast("long")
    rows = table.where(id_.isNotNull()).select(F.bitmap_bucket_number(id_).alias("bucket"), F.bitmap_bit_position(id_).alias("at"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"), F.count("*").alias("n"))


def id_difference(a: DataFrame, b: DataFrame, column: str = "event_id") -> DataFrame:
    """One row: only_a and only_b, distinct ids that the other table lacks; repeats_a and repeats_b, rows beyond the first of an id."""
    rows = id_bits(a, column).withColumn("of", F.lit("a")).unionByName(id_bits(b, column).withColumn("of", F.lit("b")))
    count = lambda x: F.coalesce(F.sum(F.when(F.col("of") == x, F.bitmap_count("bits"))), F.lit(0))
    each = rows.groupBy("bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("both"), count("a").alias("a"), count("b").alias("b"),
        *[F.coalesce(F.sum(F.when(F.col("of") == x, F.col("n"))), F.lit(0)).alias(f"n_{x}") for x in "ab"],
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    both = total("both")
    return each.agg((both - total("b")).alias("only_a"), (both - total("a")).alias("only_b"), (total("n_a") - total("a")).alias("repeats_a"), (total("n_b") - total("b")).alias("repeats_b"))


def artifact_audit(table: DataFrame, features: tuple[Feature, ...]) -> DataFrame:
    """One row: rows, distinct ids, first and last time, the columns that hold NULL against the contract; first and last id, rows
    beyond the first of an id, rows without one, and whether the ids are the whole numbers from 1 to the number of rows."""
    broken = [F.when(F.count_if(F.col(f.name).isNull()) > 0, F.lit(f.name)) for f in features if not f.nullable]
    one = table.agg(
        F.count("*").alias("rows"), F.min("event_us").alias("first_us"), F.max("event_us").alias("last_us"), F.concat_ws(",", *broken).alias("broken"),
        F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count_if(F.col("event_id").isNull()).alias("without_id"),
    )
    ids = id_bits(table).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("with_id"))
    complete = (F.col("ids") == F.col("rows")) & (F.coalesce("first_id", F.lit(1)) == 1) & (F.coalesce("last_id", F.lit(0)) == F.col("rows"))
    return one.crossJoin(ids).select(  # a row each
        "rows", "ids", "first_us", "last_us", "broken", "first_id", "last_id", (F.col("with_id") - F.col("ids")).alias("repeats"), "without_id", complete.alias("complete"),
    )


def check_artifact(table: DataFrame, events: DataFrame, version: int, source: str | None = None) -> None:
    """Holds a materialised table against the events it comes from; raises ValueError.

    Columns and types of the contract, exactly the events' ids, no NULL where the contract has none, time that never falls
    within a file nor from a file to the next, and, with ``source``, the digest of the events as the sidecar names it.
    """
    from ..schemas import check_contract, contract
    from ..sources.publish import identity

    check_contract(table.dtypes, version)
    found = artifact_audit(table, contract(version)).first()
    if any(id_difference(table, events).first()) or found["without_id"]:
        raise ValueError("the artifact doesn't have the events' ids")
    if found["broken"]:
        raise ValueError(f"missing values in {found['broken']}")
    if falls := unsorted_files(table).where("falls > 0").limit(5).collect():
        raise ValueError(f"time falls in {[r['file'] for r in falls]}")
    if overlaps := overlapping_files(table).limit(5).collect():
        raise ValueError(f"times overlap in {[(r['before'], r['file']) for r in overlaps]}")
    if source is not None and source != identity(events.select("event_id", "user_id", "item_id", "rating", "event_us")):
        raise ValueError("the artifact comes from other events")


def unsorted_files(table: DataFrame) -> DataFrame:
    """(file, falls): how often time falls from a row to the next within a file of a Parquet table; files without falls too.

    Files are told apart by their whole paths: those of all folders of a partitioned table share names.
    """
    w = W.partitionBy("file").orderBy("row")
    rows = table.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "event_us")
    return rows.select("file", (F.col("event_us") < F.lag("event_us").over(w)).alias("fall")).groupBy("file").agg(F.count_if("fall").alias("falls"))


def overlapping_files(table: DataFrame) -> DataFrame:
    """(folder, before, file): files of a folder of a Parquet table that begin before one that begins no later ends.

    From the first and last time of each file alone.
    """
    files = table.select(F.col("_metadata.file_path").alias("file"), "event_us").groupBy("file").agg(F.min("event_us").alias("first"), F.max("event_us").alias("last"))
    w = W.partitionBy("folder").orderBy("first", "last", "file")  # a row a file
    files = files.withColumn("folder", F.regexp_extract("file", "^(.*)/[^/]*$", 1)).withColumn("before", F.max(F.struct("last", "file")).over(w.rowsBetween(W.unboundedPreceding, -1)))
    return files.where(F.col("first") < F.col("before.last")).select("folder", F.col("before.file").alias("before"), "file")


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of a that b lacks, and of b that a lacks, repeated rows counted."""
    return a.exceptAll(b).agg(F.count("*").alias("only_a")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_b")))
