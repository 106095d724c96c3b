"""Staged publishing of tables with a JSON sidecar, round-trip checks, and content identities."""

from __future__ import annotations

import contextlib
import gc
import json
import tempfile
import uuid
from contextvars import ContextVar
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import same_rows
from ..session import reach_workers


class Files:
    """Small files and renames through Spark's own file systems."""

    def __init__(self, spark: SparkSession, near: str):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.hadoop = self.jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(near).getFileSystem(self.conf)

    def path(self, p: str):
        return self.hadoop.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def write(self, p: str, text: str) -> None:
        stream = self.fs.create(self.path(p), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def rename(self, a: str, b: str) -> None:
        """Fails where ``b`` exists."""
        context = self.hadoop.FileContext.getFileContext(self.path(a).toUri(), self.conf)
        context.rename(self.path(a), self.path(b), self.gateway.new_array(self.hadoop.Options.Rename, 0))

    def size(self, p: str) -> int:
        """Bytes of a file, or of all files of a folder."""
        return self.fs.getContentSummary(self.path(p)).getLength()

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.exists(p) else []


def scratch(spark: SparkSession) -> str:
    """A new folder for intermediate files: in the shared checkpoint folder, which only a local session may leave unnamed."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/chronofold/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='chronofold-')}"


_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextlib.contextmanager
def owned(spark: SparkSession):
    """Deletes, at its end, the tables that ``stored`` and ``kept`` wrote inside; what reads them must be written or collected by then."""
    own: list[str] = []
    token = _OWNED.set(own)
    try:
        yield own
    finally:
        _OWNED.reset(token)
        for path in own:
            Files(spark, path).delete(path)


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` stored in a folder of ``scratch``, with further ``options`` of the writer, and read back; ``owned`` deletes it."""
    folder, schema = scratch(df.sparkSession), df.schema
    df.write.options(compression="zstd", **options).parquet(f"{folder}/{name}")
    if (own := _OWNED.get()) is not None:
        own.append(folder)
    return df.sparkSession.read.schema(schema).parquet(f"{folder}/{name}")


def kept(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` as by ``stored``; the files of shuffles that nothing needs any more are let go.

    Spark deletes these once its driver has collected their handles, which a driver that is idle puts off.
    """
    out = stored(df, name, **options)
    del df
    gc.collect()
    out.sparkSession._jvm.System.gc()
    return out


def to_json(value: object) -> str:
    """Deterministic JSON: sorted keys, no NaN."""
    return json.dumps(value, sort_keys=True, indent=1, allow_nan=False, default=str) + "\n"


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", codec: str = "snappy") -> None:
    df.write.mode(mode).option("compression", codec).parquet(path)


def publish_pair(df: DataFrame, path: str, metadata: dict, check=None) -> None:
    """Writes a table and its sidecar ``{path}.json`` so that either both are new or both are as before.

    Both are staged beside their places; ``check(staged)`` may raise; then old ones step aside, the new ones are renamed
    into place, and on any failure the old ones come back.
    """
    spark, token = df.sparkSession, uuid.uuid4().hex
    files, side = Files(spark, path), f"{path}.json"
    stage, stage_side, old, old_side = (f"{p}.{token}.{k}" for k in ("new", "old") for p in (path, side))
    moved: list[tuple[str, str]] = []
    try:
        write_parquet(df, stage)
        if check:
            check(spark.read.parquet(stage))
        files.write(stage_side, to_json(metadata))
        for a, b in ((path, old), (side, old_side), (stage, path), (stage_side, side)):
            if files.exists(a):
                files.rename(a, b)
                moved.append((a, b))
    except BaseException:
        for a, b in reversed(moved):
            with contextlib.suppress(Exception):
                files.rename(b, a)
        for p in (stage, stage_side):
            with contextlib.suppress(Exception):
                files.delete(p)
        raise
    for p in (old, old_side):
        files.delete(p)


def convert(spark: SparkSession, df: DataFrame, path: str) -> dict:
    """Writes a validated table, reads it back, compares, and only then puts it in place; rows, bytes and source_bytes.

    source_bytes is the size of the files that ``df`` reads, None where it reads none.

    An old table steps aside, and comes back if the new one can't be put in place.
    """
    files, token = Files(spark, path), uuid.uuid4().hex
    stage, old = f"{path}.{token}.new", f"{path}.{token}.old"
    try:
        write_parquet(df, stage)
        if not same_rows(df, spark.read.parquet(stage)):
            raise ValueError(f"{path}: what was written isn't what was read")
        if files.exists(path):
            files.rename(path, old)
        files.rename(stage, path)
    except BaseException:
        with contextlib.suppress(Exception):
            files.delete(stage)
        if files.exists(old) and not files.exists(path):
            files.rename(old, path)
        raise
    files.delete(old)
    size = files.size(path)
    read = sum(Files(spark, p).size(p) for p in df.inputFiles()) or None
    return {"rows": spark.read.parquet(path).count(), "bytes": size, "source_bytes": read}


def convert_all(spark: SparkSession, frames: dict[str, DataFrame], root: str) -> DataFrame:
    """(dataset, rows, bytes, source_bytes, ratio) of tables converted one after another; the first failure stops it.

    ratio is how many bytes of the source a byte of the table stands for.
    """
    rows = [(name, *convert(spark, df, f"{root}/{name}.parquet").values()) for name, df in frames.items()]
    found = spark.createDataFrame(rows, "dataset string, rows long, bytes long, source_bytes long")
    return found.withColumn("ratio", F.col("source_bytes") / F.col("bytes"))


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row: each value as text with its length, NULL told from the empty text."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


#: Groups of rows whose numbers are summed as whole numbers; each may have 2 ** 31 rows. A task shuffles so many rows a bucket.
GROUPS = 256


SUMS = ("n", *[f"s{k}" for k in range(8)])


def digest_sums(df: DataFrame, columns: list[str] | None = None, by: Column | None = None) -> DataFrame:
    """(bucket, n, s0 to s7): for each value of ``by`` whole numbers that stand for the bag of its rows.

    Each row's digest gives eight numbers of 32 bits, which are summed by group and then over the groups: one pass with a
    partial aggregate, without a sort. They add up: what all buckets have together is what their rows have.
    """
    columns = sorted(columns or df.columns)
    bucket = (F.lit(0) if by is None else by).cast("long").alias("bucket")
    d = df.select(bucket, row_digest(columns).alias("d")).select("bucket", *[F.xxhash64(F.lit(k), "d").alias(f"h{k}") for k in range(4)])
    halves = [x for k in range(4) for x in (F.shiftrightunsigned(f"h{k}", 32), F.col(f"h{k}").bitwiseAND(F.lit(2**32 - 1)))]
    g = d.groupBy("bucket", F.pmod("h0", F.lit(GROUPS)).alias("g")).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{k}") for k, x in enumerate(halves)])
    return g.groupBy("bucket").agg(*[F.sum(F.col(c).cast("decimal(28,0)")).cast("decimal(38,0)").alias(c) for c in SUMS])


def identity_of(sums: DataFrame, columns: list[str]) -> str:
    """The digest of the rows of all buckets of ``digest_sums``."""
    zero = F.lit(0).cast("decimal(38,0)")
    total = [F.coalesce(F.sum(c).cast("decimal(38,0)"), zero).cast("string") for c in SUMS]
    return sums.agg(F.sha2(F.concat_ws("|", F.lit(",".join(sorted(columns))), *total), 256)).first()[0]


def identity(df: DataFrame, columns: list[str] | None = None) -> str:
    """A digest of the bag of rows: the same for any order and partitioning, another if a row changes, goes or repeats."""
    columns = sorted(columns or df.columns)
    return identity_of(digest_sums(df, columns), columns)


def _digests(batches):
    import hashlib

    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        found = []
        for uri in batch.column("path").to_pylist():
            files, path = (fs.LocalFileSystem(), "/" + unquote(uri[5:]).lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
            digest = hashlib.sha256()
            with files.open_input_stream(path) as stream:
                while piece := stream.read(8 << 20):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array(found, pa.string())], names=["n", "h"])


def files_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the sorted names and digests of a folder's files, each read in pieces where it lies, whatever its size."""
    reach_workers(spark)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    names = rows.select("path", F.element_at(F.split("path", "/"), -1).alias("n"))
    d = names.mapInArrow(_digests, "n string, h string").select(F.struct("n", "h").alias("x"))
    joined = F.concat_ws("|", F.transform(F.sort_array(F.collect_list("x")), lambda x: F.concat(x["n"], F.lit(":"), x["h"])))
    return d.agg(F.sha2(joined, 256)).first()[0]
