"""Typed and validated scans of CSV and Parquet; identity of source rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import check_frame
from ..schemas import Dataset

#: A value that no CSV has, so that texts such as NA and the empty text stay what they are.
NEVER = "\x00\x01never"
TIMESTAMP = "yyyy-MM-dd HH:mm:ss"


def row_identity(df: DataFrame, name: str) -> DataFrame:
    """Adds the 1-based position of a row in its source file, whatever is filtered or sorted later.

    ``df`` is a Parquet scan. In a table of several files the position is told apart by the file's rank in the sorted list
    of paths (rank << 40), as the folders of a partitioned table have files of one name; a table whose files may be rewritten
    must carry an id of its own.
    """
    files = sorted(df.inputFiles())
    position = F.col("_metadata.row_index") + 1
    if len(files) <= 1:
        return df.select("*", position.alias(name))
    path, rank = "__path", "__rank"
    ranks = df.sparkSession.createDataFrame([(_plain(f), k) for k, f in enumerate(files)], f"{path} string, {rank} long")
    keyed = df.select("*", position.alias(name), F.regexp_replace("_metadata.file_path", "^([a-z0-9]+:)/+", "$1/").alias(path))
    return keyed.join(F.broadcast(ranks), path).withColumn(name, F.shiftleft(rank, 40) + F.col(name)).drop(path, rank)


def _plain(uri: str) -> str:
    """One slash after the scheme, as some file systems give three."""
    return re.sub("^([a-z0-9]+:)/+", r"\1/", uri)


def read_csv(spark: SparkSession, path: str, dataset: Dataset, multiline: bool = True) -> DataFrame:
    """Reads a CSV with a header by ``dataset``: every column as text, then cast, then checked.

    The order of columns is free. A field in quotes may hold commas, doubled quotes and line ends. A value that doesn't cast,
    in a nullable column too, a missing or an unknown column raises ValueError. Domains are checked on the wide type, before a
    narrow one would round them away. A file that may have line ends in fields is read by one task; with ``multiline`` off,
    large files are split.
    """
    options = {"header": True, "inferSchema": False, "nullValue": NEVER, "emptyValue": "", "quote": '"', "escape": '"', "multiLine": multiline}
    raw = spark.read.options(**options).csv(path)
    dataset.check_columns(raw.columns)
    wide, malformed = [], []
    for c in dataset.columns:
        text = F.coalesce(c.name, F.lit(""))  # the reader takes an empty field without quotes for missing
        if c.nullable:
            text = F.nullif(text, F.lit(""))
        if c.kind == "timestamp_ntz":
            value = F.try_to_timestamp(text, F.lit(TIMESTAMP)).cast("timestamp_ntz")
        elif c.kind == "string":
            value = text
        else:
            value = text.try_cast("double" if c.kind in ("float", "double") else "long")
        wide.append(value.alias(c.name))
        if c.nullable:  # a value that is missing may be so, one that can't be read may not
            malformed.append(F.count_if(text.isNotNull() & value.isNull()).alias(c.name))
    typed = raw.select(*wide)
    if malformed:
        bad = [k for k, n in raw.agg(*malformed).first().asDict().items() if n]
        if bad:
            raise ValueError(f"values that can't be read in {bad}")
    check_frame(typed, dataset)
    return typed.select(*[F.col(c.name).cast(c.kind).alias(c.name) for c in dataset.columns])


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """Scan with projection and filter; both reach the Parquet reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df
