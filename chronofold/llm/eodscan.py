"""Token counts of flat token files, found by their end-of-document ids alone.

A flat file is little-endian unsigned 16-bit ids, nothing else: no index, no header. Files are cut into blocks of bytes that
know nothing of documents; a vectorised search finds the end ids of each block. A block's summary is how many it has and
where its last one is; a prefix scan of a file's summaries gives each block the number of documents before it and where its
first document began, so a document that spans blocks is stitched.

Which document has which rank in a file is known to the rows that the task returned when it wrote the file. A task that
runs again may see its rows in another order, so each attempt has a file of its own, which only its rows name.

Defined results: a NULL or empty text has the end id alone and counts 1; ids after a file's last end id belong to no
document; an empty file has no documents; repeated ids and rows are documents of their own; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_dir, open_file, publish, ship, slices, store, table
from .tokens import RUN as TEXT
from .tokens import encoder, vocabulary_path

#: The vocabulary and its end-of-document id; ids are below 2 ** 16.
VOCABULARY, END = "word_bpe_49k.json", 49_407
#: Bytes of a block, an even number.
BLOCK = 1 << 20


def _write(root: str, path: str, end: int):
    def run(batches):
        import pyarrow as pa

        part, mark, at, k = TaskContext.get().partitionId(), np.array([end], "<u2").tobytes(), 0, 0
        uri = f"{root}/part-{part:08d}-{TaskContext.get().taskAttemptId()}.u16"
        rest = slices(batches, size=TEXT)
        first = next(rest, None)
        if first is None:
            return
        with publish(uri) as out:
            while first is not None:
                encoded = encoder(path, apart=True).encode(first.column("text").to_pylist())
                data = b"".join([np.frombuffer(e, "<u4").astype("<u2").tobytes() + mark for e in encoded])
                out.write(data)
                n = first.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * n), pa.array(np.arange(k, k + n)), first.column("doc_id"), pa.array([0] * (n - 1) + [len(data)])],
                    names=["file", "place", "doc_id", "bytes"],
                )
                k, at, first = k + n, at + len(data), next(rest, None)

    return run


def write_flat(docs: DataFrame, root: str, tokenizer: str, end: int = END) -> DataFrame:
    """Writes (doc_id, text) as flat files, a file a task; (file, place, doc_id, bytes): which document is where in
    the order of its file. ``bytes`` sums to the size of the file; no position of a document is kept."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return store(rows.mapInArrow(_write(root, tokenizer, end), "file string, place long, doc_id long, bytes long"), "flat")


def _ends(end: int, block: int):
    def search(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, k in zip(*[batch.column(c).to_pylist() for c in ("file", "block")], strict=True):
                with open_file(uri) as file:
                    file.seek(k * block)
                    ids = np.frombuffer(file.read(block), "<u2")
                found = np.flatnonzero(ids == end) + k * (block // 2)
                yield pa.RecordBatch.from_pydict({"file": [uri], "block": [k], "ends": [found]}, schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("ends", pa.list_(pa.int64()))]))

    return search


def count_tokens(files: DataFrame, end: int = END, block: int = BLOCK) -> DataFrame:
    """Files (file, bytes) to a row a document: file, place (its rank in the file), start, n_tokens (with the end)."""
    ship(files.sparkSession)
    blocks = files.select("file", F.explode(F.expr(f"sequence(0L, cast(ceil(bytes / {block}) as long) - 1)")).alias("block")).where("bytes > 0")
    spread = blocks.repartition(F.col("file"), F.col("block"))
    found = store(spread.mapInArrow(_ends(end, block), "file string, block long, ends array<long>"), "ends")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    scanned = found.select(
        "file", "ends", F.coalesce(F.sum(F.size("ends").cast("long")).over(before), F.lit(0)).alias("documents"),
        F.coalesce(F.max(F.array_max("ends")).over(before) + 1, F.lit(0)).alias("begun"),
    )
    first = scanned.select("file", "documents", "begun", "ends", F.posexplode("ends").alias("k", "at"))
    start = F.when(F.col("k") == 0, F.col("begun")).otherwise(F.element_at("ends", F.greatest("k", F.lit(1))) + 1)
    return first.select("file", (F.col("documents") + F.col("k")).alias("place"), start.alias("start"), (F.col("at") + 1 - start).alias("n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens: counts with the end id, found in the flat files."""
    written = write_flat(table(spark, sf_dir, "documents"), new_dir(spark, "flat"), vocabulary_path(VOCABULARY))
    files = written.groupBy("file").agg(F.sum("bytes").alias("bytes"))
    return count_tokens(files).join(written, ["file", "place"]).select("doc_id", "n_tokens")
