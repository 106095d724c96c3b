"""Shared folder, intermediate tables and small helpers of the operators."""

from __future__ import annotations

import contextlib
import posixpath
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reach_workers

_OWN: dict[str, str] = {}
#: Rows of an Arrow batch, at most: texts may be long, and a batch is held by the JVM and by the worker.
BATCH_ROWS = 1000
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where the repository lies on the same path, and bounds their batches.

    The bound is a setting of the session, which stays; a smaller one is left as it is.
    """
    if not 0 < int(spark.conf.get(_ROWS_CONF)) <= BATCH_ROWS:
        spark.conf.set(_ROWS_CONF, str(BATCH_ROWS))
    reach_workers(spark)


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session in one process doesn't name one (local tests) is a folder made here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="chronofold-")
        named = _OWN[app]
    return named if "://" in named or named.startswith("file:") else f"file://{named}"


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application's intermediate tables and files are in."""
    return posixpath.join(shared_dir(spark), "chronofold", spark.sparkContext.applicationId)


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh URI in the shared folder."""
    return posixpath.join(own_dir(spark), f"{name}-{uuid.uuid4().hex}")


def clean(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables and files, once results that read them are written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_RUN: ContextVar[list[str] | None] = ContextVar("run", default=None)


@contextlib.contextmanager
def recorded():
    """A list of the folders that ``store`` writes inside, in order. Each run, session and thread has its own."""
    own: list[str] = []
    token = _RUN.set(own)
    try:
        yield own
    finally:
        _RUN.reset(token)


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    if (run := _RUN.get()) is not None:
        run.append(path)
    return spark.read.schema(schema).parquet(path)


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Deletes stored tables that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; the size check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


#: Rows of one key from which a join spreads them; sides of a join that are broadcast, at most.
HOT, BROADCAST = 100_000, 1_000_000


def join_counted(rows: DataFrame, side: DataFrame, keys: list[str], n: str = "n", hot: int | None = None) -> DataFrame:
    """``rows`` joined to ``side``, which is unique in ``keys`` and whose column ``n`` says how many rows have each key.

    The side of keys with over ``HOT`` rows is broadcast, so their rows stay where they are; there are at most rows / HOT of
    them, and their number is checked. Past that, and for all other keys, the join shuffles.
    """
    heavy = side.where(F.col(n) > (HOT if hot is None else hot))
    if heavy.isEmpty() or not small_enough(heavy, BROADCAST):
        return rows.join(side, keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(side.join(F.broadcast(heavy.select(*keys)), keys, "left_anti"), keys)
    return rest.unionByName(rows.join(F.broadcast(heavy), keys))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- files in the shared folder, read and written by Python workers -------------------------------------------------


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI; works for file:, hdfs: and object stores pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def publish(uri: str):
    """A binary output stream whose file appears under ``uri`` only when it is complete.

    A task that is run again, or twice at once, replaces the file by an equal one.
    """
    files, path = filesystem(uri)
    files.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    out = files.open_output_stream(part)
    try:
        yield out
        out.close()
        files.move(part, path)
    except BaseException:
        with contextlib.suppress(Exception):
            out.close()
            files.delete_file(part)
        raise


def open_file(uri: str):
    files, path = filesystem(uri)
    return files.open_input_file(path)


#: Bytes of a slice that becomes Python objects at once, about.
SLICE = 4 << 20


def slices(batches, rows: int = 256, size: int = SLICE):
    """Cuts Arrow batches, so that long texts become Python objects a few at a time: at most ``rows`` rows whose columns have
    ``size`` bytes together, or one row that is longer than that."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows == 0:
            continue
        if batch.nbytes <= size:
            for i in range(0, batch.num_rows, rows):
                yield batch.slice(i, rows)
            continue
        each = np.full(batch.num_rows, 16, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                wide = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
                each += np.diff(wide)
            elif pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                each += np.diff(np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset))
            else:
                each += column.nbytes // len(column)
        ends, first = np.cumsum(each), 0
        while first < batch.num_rows:
            limit = size + (ends[first - 1] if first else 0)
            last = min(first + rows, max(first + 1, int(np.searchsorted(ends, limit, side="right"))))
            yield batch.slice(first, last - first)
            first = last
