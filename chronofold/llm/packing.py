"""Packing of token sequences by the sum of squares.

A document's ids with an end id are cut into pieces of ``LENGTH`` only where longer. A whole piece is a sequence of its own. The
others are dealt to groups of about ``GROUP`` pieces by a hash of their place in the stored table, whatever their keys; in a
group each piece goes, longest first, where the sum over residual gaps of the squared number of open sequences with that
gap becomes smallest: into a sequence with gap g at a change of 2 (N[g - s] - N[g] + 1), or 1 - 2 N[g] if it fills it. A new one
is opened when no open one takes the piece, as the aim is few sequences. Only the counts by gap are needed, so one
placement is one vector operation.

Sequences that a group leaves open by more than ``SLACK`` give their pieces back; they are packed again in fewer groups,
until one group is left of them or none shrinks. So the waste of the groups' ends doesn't grow with their number.

Defined results: a NULL or empty text has the end id alone; repeated ids and rows are documents of their own, told apart by
the order of rows with that id; no rows give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, slices, store, table, unused
from .tokens import RUN as TEXT
from .tokens import encoder, vocabulary_path

LENGTH, END = 2048, 0
#: Pieces of a group; tokens that a closed sequence may leave open; times that pieces are given back.
GROUP, SLACK, ROUNDS = 40_000, 16, 3


def _cut(path: str, length: int, end: int):
    def run(batches):
        import pyarrow as pa

        mark, step = np.array([end], "<u4").tobytes(), 4 * length
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in slices(batches, size=TEXT):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(path).encode(batch.column("text").to_pylist()), strict=True):
                ids += mark
                for k, i in enumerate(range(0, len(ids), step)):
                    part = ids[i : i + step]
                    rows.append((doc, k, i // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, text) to (doc_id, piece, start, length, ids_crc32)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_cut(tokenizer, length, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Places pieces of ``sizes`` (0 < s <= capacity), longest first; the sequence and offset of each."""
    order = np.argsort(-sizes, kind="stable")
    n = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by gap
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, used = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64), 0
    big = np.iinfo(np.int64).max // 4
    widest = 0
    for i in order.tolist():
        s = int(sizes[i])
        if s == capacity:
            where[i], offset[i] = used, 0
            used += 1
            continue
        gap = capacity
        if widest >= s:
            now = n[s : widest + 1]
            cost = 2 * (n[: widest + 1 - s] - now + 1)
            cost[0] = 1 - 2 * now[0]
            cost[now == 0] = big
            k = int(cost.argmin())
            if cost[k] < big:
                gap = s + k
        if gap == capacity:
            bin_ = used
            used += 1
        else:
            bin_ = open_[gap].pop()
            n[gap] -= 1
        where[i], offset[i] = bin_, capacity - gap
        left = gap - s
        if left:
            open_[left].append(bin_)
            n[left] += 1
            widest = max(widest, left)
    return where, offset


def _pack(capacity: int, slack: int, base: int, mark: str, full: str):
    def run(group):
        import pyarrow as pa

        sizes = group.column("length").to_numpy()
        where, offset = sum_of_squares(sizes, capacity)
        fill = np.bincount(where, weights=sizes)
        number = group.column(mark)[0].as_py()
        done = fill[where] >= capacity - slack
        return group.append_column("sequence_id", pa.array(base + (number << 32) + where)).append_column("offset", pa.array(offset)).append_column(full, pa.array(done))

    return run


def pack(rows: DataFrame, capacity: int = LENGTH, group: int = GROUP, slack: int = SLACK, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to rows with ``length`` (1 to capacity); columns of these names are replaced."""
    ship(rows.sparkSession)
    base = store(rows.drop("sequence_id", "offset"), "pieces")
    mark, full = unused(base, "__group"), unused(base, "__done")
    whole = base.where(F.col("length") == capacity)
    out = [whole.select("*", (F.monotonically_increasing_id() + (1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = base.where(F.col("length") < capacity)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rest.dtypes)
    left = rest.count()
    for k in range(rounds + 1):
        if not left:
            break
        groups = -(-left // group)
        last = groups == 1 or k == rounds
        deal = F.pmod(F.xxhash64(F.lit(k), F.monotonically_increasing_id()), F.lit(groups))
        packed = rest.withColumn(mark, deal).groupBy(mark)
        kind = f"{kinds}, `{mark}` long, sequence_id long, offset long, `{full}` boolean"
        packed = packed.applyInArrow(_pack(capacity, -1 if last else slack, k << 56, mark, full), kind)
        packed = store(packed, "packed")
        if last:
            out.append(packed.drop(mark, full))
            break
        out.append(packed.where(F.col(full)).drop(mark, full))
        rest = packed.where(~F.col(full)).drop(mark, full, "sequence_id", "offset")
        left = rest.count()
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json")))
