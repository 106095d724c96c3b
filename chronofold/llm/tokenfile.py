"""Token files of patched frame-of-reference blocks.

A file: the magic; blocks; the starts of the blocks; the documents' ids and lengths, and a bit for each that says whether
its id is NULL; a trailer. A block holds ``ROWS x
LANES`` ids: their minimum is subtracted, the differences are packed at the width that ``PERCENTILE`` of them fit in, and
the low bits of the others are packed too, with their whole difference in an exception list. Bit ``i * width`` of lane
``j`` is where id ``i * LANES + j`` starts, so that packing is a few vector operations for all blocks of a width.

Files hold documents in ascending doc_id order (NULL first; equal ids by a hash of the text, then by the text, so that rows
of one id may lie in several files), and file names ascend too. Each is written under a temporary name and moved when
complete, under a name of its attempt: the manifest lists the files of the attempts that counted.

Defined results: a NULL text is empty; an empty text has the end id alone; repeated ids and rows are documents of their
own; no rows give no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_dir, open_file, publish, ship, slices, store, table
from .tokens import RUN as TEXT
from .tokens import encoder, vocabulary_path

MAGIC = b"CFPFOR02"
ROWS = LANES = 64
SIZE = ROWS * LANES
#: Share of a block's differences that fit in its width.
PERCENTILE = 0.95
END = 2
#: Blocks packed, or read, at once.
RUN = 256
#: Chunks of text that a worker's encoder keeps (some 200 bytes each).
MEMO = 1_000_000
_HEAD = struct.Struct("<IIHBx")  # minimum, exceptions, ids, width
_TAIL = struct.Struct("<QQQQ8s")  # blocks, documents, ids, start of the index


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, ROWS, LANES) unsigned 64-bit, the low ``width`` bits of each, to (n, width, LANES) words."""
    out = np.zeros((len(values), max(width, 1), LANES), dtype=np.uint64)
    if not width:
        return out[:, :0]
    low = values & np.uint64((1 << width) - 1)
    for i in range(ROWS):
        word, shift = divmod(i * width, 64)
        out[:, word] |= low[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= low[:, i] >> np.uint64(64 - shift)
    return out


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), ROWS, LANES), dtype=np.uint64)
    for i in range(ROWS if width else 0):
        word, shift = divmod(i * width, 64)
        out[:, i] = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            out[:, i] |= words[:, word + 1] << np.uint64(64 - shift)
    return out & np.uint64((1 << width) - 1)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Unsigned 32-bit ids to blocks; the last may be short."""
    n = -(-len(ids) // SIZE)
    short = n * SIZE - len(ids)
    full = np.concatenate([ids, np.full(short, ids[-1], dtype=ids.dtype)]) if short else ids
    full = full.reshape(n, SIZE)
    low = full.min(axis=1)
    rest = (full - low[:, None]).astype(np.uint64)
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)  # the bit length of each difference
    k = min(SIZE - 1, int(PERCENTILE * SIZE))
    widths = np.partition(bits, k, axis=1)[:, k]
    over = bits > widths[:, None]
    packed: list = [None] * n
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        for r, words in zip(rows.tolist(), pack(rest[rows].reshape(-1, ROWS, LANES), width), strict=True):
            packed[r] = words
    out = []
    for r in range(n):
        places = np.flatnonzero(over[r])
        count = SIZE - short if r == n - 1 else SIZE
        head = _HEAD.pack(int(low[r]), len(places), count, int(widths[r]))
        out.append(head + packed[r].astype("<u8").tobytes() + places.astype("<u2").tobytes() + rest[r, places].astype("<u4").tobytes())
    return out


def decode_blocks(data: bytes) -> np.ndarray:
    """The ids of blocks that stand one after another."""
    at, heads = 0, []
    while at < len(data):
        low, exceptions, count, width = _HEAD.unpack_from(data, at)
        heads.append((low, exceptions, count, width, at + _HEAD.size))
        at += _HEAD.size + width * LANES * 8 + 6 * exceptions
    out = np.zeros((len(heads), SIZE), dtype=np.uint64)
    widths = np.array([h[3] for h in heads])
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        words = np.stack([np.frombuffer(data, "<u8", width * LANES, heads[r][4]) for r in rows]).reshape(len(rows), width, LANES)
        out[rows] = unpack(words, width).reshape(len(rows), SIZE)
    for r, (_, exceptions, _, width, start) in enumerate(heads):
        if exceptions:
            start += width * LANES * 8
            places = np.frombuffer(data, "<u2", exceptions, start)
            out[r, places] = np.frombuffer(data, "<u4", exceptions, start + 2 * exceptions)
    out += np.array([h[0] for h in heads], dtype=np.uint64)[:, None]
    flat = out.reshape(-1)
    return flat[: len(flat) - SIZE + heads[-1][2]].astype("<u4") if heads else flat.astype("<u4")


class Writer:
    def __init__(self, stream):
        self.stream, self.at, self.starts, self.docs, self.lengths, self.ids = stream, len(MAGIC), [], [], [], 0
        self.held: list[np.ndarray] = []
        self.waiting = 0
        stream.write(MAGIC)

    def add(self, doc_ids: list, encoded: list[bytes]) -> None:
        """Documents, each as the bytes of its ids."""
        got = np.frombuffer(b"".join(encoded), "<u4")
        self.docs += doc_ids
        self.lengths += [len(e) // 4 for e in encoded]
        self.held.append(got)
        self.waiting += len(got)
        self.ids += len(got)
        if self.waiting >= RUN * SIZE:
            self._flush(self.waiting // SIZE * SIZE)

    def _flush(self, n: int) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        self.held, self.waiting = [flat[n:].copy()], len(flat) - n
        for i in range(0, n, RUN * SIZE):
            blocks = encode_blocks(flat[i : min(n, i + RUN * SIZE)])
            for block in blocks:
                self.starts.append(self.at)
                self.at += len(block)
            self.stream.write(b"".join(blocks))

    def close(self) -> None:
        if self.waiting:
            self._flush(self.waiting)
        docs = np.array([d or 0 for d in self.docs], "<i8")
        nulls = np.packbits(np.array([d is None for d in self.docs], dtype=bool))
        self.stream.write(np.array(self.starts, "<u8").tobytes() + docs.tobytes() + np.array(self.lengths, "<u8").tobytes() + nulls.tobytes())
        self.stream.write(_TAIL.pack(len(self.starts), len(docs), self.ids, self.at, MAGIC))


class Reader:
    """``index()``: doc ids and lengths; ``runs()``: the ids of the file, some blocks at a time."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - _TAIL.size)
        self.blocks, self.n_docs, self.n_ids, self.index_at, magic = _TAIL.unpack(file.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        file.seek(self.index_at)
        fixed = 8 * (self.blocks + 2 * self.n_docs)
        raw = file.read(fixed + -(-self.n_docs // 8))
        self.starts = np.append(np.frombuffer(raw, "<u8", self.blocks), self.index_at).astype(np.int64)
        self.docs = np.frombuffer(raw, "<i8", self.n_docs, 8 * self.blocks)
        self.lengths = np.frombuffer(raw, "<u8", self.n_docs, 8 * (self.blocks + self.n_docs)).astype(np.int64)
        self.nulls = np.unpackbits(np.frombuffer(raw, np.uint8, offset=fixed), count=self.n_docs).astype(bool)

    def runs(self, first: int = 0, last: int | None = None):
        for i in range(first, self.blocks if last is None else last, RUN):
            j = min(i + RUN, self.blocks if last is None else last)
            self.file.seek(int(self.starts[i]))
            yield decode_blocks(self.file.read(int(self.starts[j] - self.starts[i])))

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; reads only the blocks that hold them."""
        start = int(self.lengths[:k].sum())
        end = start + int(self.lengths[k])
        first = start // SIZE
        flat = np.concatenate([np.zeros(0, "<u4"), *self.runs(first, -(-end // SIZE))])
        return flat[start - first * SIZE : end - first * SIZE]


def _write(root: str, path: str, end: int):
    def run(batches):
        import pyarrow as pa

        part, encode, mark, writer = TaskContext.get().partitionId(), None, struct.pack("<I", end), None
        uri = f"{root}/part-{part:08d}-{TaskContext.get().taskAttemptId()}.pfor"
        rest = slices(batches, size=TEXT)
        first = next(rest, None)
        if first is None:
            return
        encode = encoder(path, MEMO).encode
        with publish(uri) as out:
            writer = Writer(out)
            while first is not None:
                ids = [e + mark for e in encode(first.column("text").to_pylist())]
                writer.add(first.column("doc_id").to_pylist(), ids)
                first = next(rest, None)
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [uri], "docs": [len(writer.docs)], "ids": [writer.ids]})

    return run


def write_files(docs: DataFrame, root: str, tokenizer: str, end: int = END) -> DataFrame:
    """Writes (doc_id, text) as token files under ``root``; the manifest: part, file, docs, ids, base (ids before)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    rows = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    manifest = store(rows.mapInArrow(_write(root, tokenizer, end), "part long, file string, docs long, ids long"), "token-manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a file
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _read(batches):
    import pyarrow as pa

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for uri, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
            with open_file(uri) as file:
                reader = Reader(file)
                ends = np.cumsum(reader.lengths)
                sums, at, k = [0] * reader.n_docs, 0, 0
                for ids in reader.runs():
                    data, stop = memoryview(ids.tobytes()), at + len(ids)
                    while k < reader.n_docs and at < stop:
                        upto = min(int(ends[k]), stop)
                        start = stop - len(ids)
                        sums[k] = zlib.crc32(data[4 * (at - start) : 4 * (upto - start)], sums[k])
                        at = upto
                        k += at == ends[k]
                docs = pa.array(reader.docs, mask=reader.nulls)
                yield pa.RecordBatch.from_arrays([docs, pa.array(ends - reader.lengths + base), pa.array(reader.lengths), pa.array(sums, pa.int64())], names=names)


def read_files(manifest: DataFrame) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32."""
    ship(manifest.sparkSession)
    files = manifest.select("part", "file", "base")
    # a file's rows carry some hundred bytes; a task for each keeps one task from reading several
    spread = files.repartition(max(1, manifest.count()), "part")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_files(write_files(docs, new_dir(spark, "tokens"), vocabulary_path("byte_bpe_50k.json")))
