"""Phrase collocations: sums of hashes pick what may be frequent, a second pass counts that exactly.

First pass: each task turns the hashes of its phrases of one to ``LONGEST`` words into cells of one row, sorts a bounded run of them and
hands on each cell once, with its count, by block of the row; those of all runs are added up by block. Such a row never counts too little,
so a phrase whose cell reaches the threshold may be frequent and no other can be; what is kept of it is a filter of the cells that do.
Second pass: the texts are read again, and only phrases that survive are counted, as words and not as hashes, in a bounded dictionary a
task, which hands on what is rarer when it is full, and then by grouping. Nothing frequent is lost and nothing rare is left, whatever the filter.

Then each candidate is scored at its weakest cut, in whole numbers of up to 38 digits, and candidates that stand inside a longer one as often
as alone are dropped, each by joins with the counts.

The row has a cell for 2 to 4 bytes of text, 2^``NARROWEST`` at least, so that it is as sparse for large texts as for small ones: some three
phrases a cell. No task has all of it: a run is ``RUN`` phrases, a block 2^``BLOCK`` cells. What is shuffled are cells that are there, about two bytes
for each distinct phrase of a run; what goes to all tasks are ``BITS`` bits in each of ``DEPTH`` rows for a cell that survives. Both grow with the texts.

Defined results: a NULL text has no words, a NULL language is ``und``; repeated ids and rows count each time; a language without candidates has no row;
no rows give no rows. Columns beside text and lang aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_counted, ship, slices, small_enough, store, table

LEAST, LONGEST, PERCENT, TOP = 100, 5, 100, 2_000
#: Bytes of text for a cell; the narrowest and the widest row and a block of it, as powers of two; phrases of a run.
SPARE, NARROWEST, WIDEST, BLOCK, RUN = 4, 16, 48, 22, 1 << 23
#: Rows of the filter, and the bits of a row for a cell in it.
DEPTH, BITS = 2, 32
#: Phrases that a task holds before it hands on the counts of the rarer ones; bytes of text whose phrases are a bucket of them, at most.
HELD, SHARE = 1 << 19, 1 << 20
#: Bytes of text for a partition of what is shuffled.
PARTITION = 64 << 20
#: Parts of a language that are ranked before all of it; buckets at least.
PARTS = 64
BROADCAST = 100_000
_SPLIT = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class Texts:
    """The words of some texts, one after another, with their pieces, languages and hashes."""

    def __init__(self, texts: list[str | None], langs: list[str]):
        import xxhash

        each = [(t or "").encode().lower().translate(_SPLIT) for t in texts]  # bytes: ASCII letters alone
        raw = b"\n".join(each)
        self.words = raw.split()
        self.n = len(self.words)
        bytes_ = np.frombuffer(raw, np.uint8)
        blank = (bytes_ == 10) | (bytes_ == 32)
        starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(raw) else np.zeros(0, np.int64)
        self.piece = np.cumsum(bytes_ == 10, dtype=np.int32)[starts]
        known = sorted(set(langs))
        ends = np.cumsum([len(e) + 1 for e in each])
        self.langs, self.lang = known, np.array([known.index(x) for x in langs], dtype=np.int32)[np.searchsorted(ends, starts, side="right")]
        seeds = np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in known], dtype=np.uint64)
        self.own = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, self.n)
        self.seed = seeds[self.lang] if known else np.zeros(0, np.uint64)

    def hashes(self, longest: int):
        """Yields (k, places where k words of a piece begin, their hashes)."""
        h, place = _mix(self.own ^ self.seed), np.arange(self.n)
        yield 1, place, h
        for k in range(2, longest + 1):
            place, h = place[: np.searchsorted(place, self.n - k + 1)], h[: np.searchsorted(place, self.n - k + 1)]
            fits = self.piece[place] == self.piece[place + k - 1]
            place, h = place[fits], h[fits]
            h = _mix(h * np.uint64(3) + self.own[place + k - 1])
            yield k, place, h

    def phrases(self, place: np.ndarray, k: int):
        """The phrases of k words from each place on, as bytes with single spaces."""
        if not hasattr(self, "flat"):
            self.flat = b" ".join(self.words)
            length = np.fromiter(map(len, self.words), np.int64, self.n)
            self.end = np.cumsum(length + 1) - 1
            self.start = self.end - length
        return map(self.flat.__getitem__, map(slice, self.start[place].tolist(), self.end[place + k - 1].tolist()))


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return (hashes >> np.uint64(32 * row) & np.uint64(width - 1)).astype(np.int64)


def _texts(batches):
    for batch in slices(batches):
        yield Texts(batch.column("text").to_pylist(), batch.column("lang").to_pylist())


def _filtered(cell: np.ndarray, row: int, size: int) -> np.ndarray:
    """The bits of mixed cells in a row of a filter of ``size`` bits."""
    return ((cell >> np.uint64(32 * row) & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def _pack(gaps: np.ndarray, counts: np.ndarray) -> bytes:
    """Whole numbers and their counts, byte by byte of them: the first bytes are noise, the others compress."""
    import pyarrow as pa

    planes = gaps.view(np.uint8).reshape(len(gaps), -1).T.tobytes()
    return pa.compress(planes + counts.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, wide: int, kind) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa

    raw = np.frombuffer(pa.decompress(data, n * (wide + np.dtype(kind).itemsize), codec="zstd", asbytes=True), np.uint8)
    gaps = np.ascontiguousarray(raw[: n * wide].reshape(wide, n).T).reshape(-1).view(f"<u{wide}")
    return np.cumsum(gaps, dtype=np.int64), raw[n * wide :].view(kind)


def _sketch(width: int, least: int, longest: int):
    """Of each run, by block the cells that its phrases fill: gaps between them and counts up to ``least``."""
    kind, step = np.min_scalar_type(least), min(width, 1 << BLOCK)

    def rows(held: list[np.ndarray]):
        import pyarrow as pa

        every = np.concatenate(held)
        held.clear()
        every.sort()
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        counts = np.minimum(np.diff(np.append(first, len(every))), least).astype(kind)
        every = every[first].astype(np.int64)
        block = every // step
        out, starts = [], np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for i, j in zip(starts, np.append(starts[1:], len(every)), strict=True):
            gaps = np.diff(every[i:j], prepend=block[i] * step)
            wide = 2 if gaps.max() < 1 << 16 else 4
            out.append((block[i], j - i, wide, _pack(gaps.astype(f"<u{wide}"), counts[i:j])))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["b", "n", "wide", "data"])

    def run(batches):
        held, n = [], 0
        for some in _texts(batches):
            for _, _, h in some.hashes(longest):
                held.append(cells(h, 0, width).astype(np.uint32 if width <= 1 << 32 else np.uint64))
                n += len(h)
            if n >= RUN:
                yield rows(held)
                n = 0
        if n:
            yield rows(held)

    return run


def _merge(width: int, least: int):
    """Adds up blocks, sorted by their number; gives the cells that reach ``least``. One block is held at a time."""
    kind, step = np.min_scalar_type(least), min(width, 1 << BLOCK)

    def run(batches):
        import pyarrow as pa

        now, total = None, np.zeros(step, dtype=np.uint32)

        def found():
            some = np.flatnonzero(total >= least) + now * step
            total[:] = 0
            return pa.RecordBatch.from_arrays([pa.array([len(some)], pa.int64()), pa.array([some.astype("<u8").tobytes()], pa.binary())], names=["n", "cells"])

        for batch in batches:
            for b, n, wide, data in zip(*(batch.column(c).to_pylist() for c in ("b", "n", "wide", "data")), strict=True):
                if b != now:
                    if now is not None:
                        yield found()
                    now = b
                at, counts = _unpack(data, n, wide, kind)
                total[at] += counts
        if now is not None:
            yield found()

    return run


def _dealt(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` by ``key``, over more partitions than the session has where texts of ``size`` bytes ask for it."""
    n = int(size // PARTITION)
    return rows.repartition(n, key) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(key)


def survivors(texts: DataFrame, width: int, least: int = LEAST, longest: int = LONGEST) -> tuple[np.ndarray, int]:
    """(text, lang) to a filter of the cells that all texts together fill to ``least``, and the bits of a row of it."""
    blocks = texts.mapInArrow(_sketch(width, least, longest), "b int, n int, wide int, data binary")
    blocks = _dealt(blocks, "b", width * SPARE).sortWithinPartitions("b")
    merged = store(blocks.mapInArrow(_merge(width, least), "n long, cells binary"), "cells")
    size = max(64, BITS * (merged.agg(F.sum("n")).first()[0] or 0))
    bits = np.zeros((DEPTH, -(-size // 8)), dtype=np.uint8)
    for row in merged.select("cells").where("n > 0").toLocalIterator():
        cell = _mix(np.frombuffer(row[0], "<u8"))
        for r in range(DEPTH):
            at = _filtered(cell, r, size)
            np.bitwise_or.at(bits[r], at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return bits, size


def _rarer(counts: dict[str, Counter]) -> dict[str, dict[bytes, int]]:
    """Takes out of ``counts`` the half of its phrases that are rarest, or more."""
    limit = np.median(np.fromiter((n for of in counts.values() for n in of.values()), np.int64))
    rare = {lang: {p: n for p, n in of.items() if n <= limit} for lang, of in counts.items()}
    for lang, of in rare.items():
        counts[lang] = Counter({p: n for p, n in counts[lang].items() if n > limit})
    return rare


def _count(bits, longest: int, width: int, size: int, buckets: int):
    """Exact counts of the phrases whose cells are in the filter, a row a bucket with some of them; the number of words as that of
    the empty phrase. A key is the phrase, a tab, which no phrase has, and the language."""

    def rows(counts: dict[str, Counter]):
        import pyarrow as pa

        keys, n, bucket = [], [], []
        for lang, of in counts.items():
            tail = b"\t" + lang.encode()
            keys += [p + tail for p in of]
            n += of.values()
            bucket += [zlib.crc32(p) % buckets for p in of]
        order = np.argsort(np.array(bucket), kind="stable")
        some, first = np.unique(np.array(bucket)[order], return_index=True)
        ends = pa.array(np.append(first, len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, x.take(pa.array(order))) for x in (pa.array(keys, pa.binary()), pa.array(n, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *lists], names=["bucket", "keys", "counts"])

    def run(batches):
        table, counts = bits.value, {}
        for some in _texts(batches):
            for x, n in zip(some.langs, np.bincount(some.lang, minlength=len(some.langs)).tolist(), strict=True):
                if n:
                    counts.setdefault(x, Counter())[b""] += n
            alive = np.ones(some.n + 1, dtype=bool)
            for k, place, h in some.hashes(longest):
                # a phrase is there no more often than the two that are a word shorter
                keep = alive[place] & alive[place + (k > 1)]
                place, h = place[keep], h[keep]
                cell = _mix(cells(h, 0, width).astype(np.uint64))
                for r in range(DEPTH):
                    at = _filtered(cell, r, size)
                    keep = (table[r, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                    place, cell = place[keep], cell[keep]
                alive = np.zeros(some.n + 1, dtype=bool)
                alive[place] = True
                lang = some.lang[place]
                for i in np.unique(lang).tolist():
                    counts.setdefault(some.langs[i], Counter()).update(some.phrases(place[lang == i], k))
            if sum(map(len, counts.values())) >= HELD:
                yield rows(_rarer(counts))
        if any(counts.values()):
            yield rows(counts)

    return run


def _total(least: int):
    """Rows of counts, sorted by bucket, to (lang, k, phrase, c) of what is there ``least`` times; one bucket is held at a time."""

    def rows(of: dict[bytes, int]):
        import pyarrow as pa

        kept = [(*key.split(b"\t", 1), c) for key, c in of.items() if c >= least or key[:1] == b"\t"]
        phrase, lang, c = zip(*kept, strict=True) if kept else ((), (), ())
        k = [p.count(b" ") + 1 if p else 0 for p in phrase]
        text = [pa.array(x, pa.binary()).cast(pa.string()) for x in (lang, phrase)]
        return pa.RecordBatch.from_arrays([text[0], pa.array(k, pa.int32()), text[1], pa.array(c, pa.int64())], names=["lang", "k", "phrase", "c"])

    def run(batches):
        now, of = None, {}
        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != now:
                    yield rows(of)
                    now, of = bucket, {}
                for key, c in zip(batch.column("keys")[i].as_py(), batch.column("counts")[i].as_py(), strict=True):
                    of[key] = of.get(key, 0) + c
        yield rows(of)

    return run


def row_width(size: int, widest: int = WIDEST) -> int:
    """Cells for texts of ``size`` bytes."""
    return 1 << min(widest, max(NARROWEST, int(size // SPARE).bit_length()))


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, widest: int = WIDEST) -> tuple[DataFrame, DataFrame]:
    """(text, lang) to (lang, k, phrase, c) of all phrases of up to ``longest`` words that are there ``least`` times, and (lang, n) of all words."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = row_width(size, widest)
    bits, bits_a_row = survivors(texts, width, least, longest)
    bits = spark.sparkContext.broadcast(bits)
    buckets = max(PARTS, int(size // SHARE))
    counted = texts.mapInArrow(_count(bits, longest, width, bits_a_row, buckets), "bucket int, keys array<binary>, counts array<long>")
    counted = _dealt(counted, "bucket", size).sortWithinPartitions("bucket").mapInArrow(_total(least), "lang string, k int, phrase string, c long")
    counted = store(counted, "frequent")
    return counted.where("k > 0"), counted.where("k = 0").select("lang", F.col("c").alias("n"))


def _look_up(rows: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the count of phrase ``key`` as ``name``; a phrase that many rows ask for stays where they are."""
    asked = rows.groupBy("lang", key).agg(F.count("*").alias("n_rows"))
    side = asked.join(counts.select("lang", F.col("phrase").alias(key), F.col("c").alias(name)), ["lang", key])
    return join_counted(rows, store(side, "asked"), ["lang", key], "n_rows").drop("n_rows")


def score(counts: DataFrame, words: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(lang, k, phrase, c) and (lang, n) to (lang, phrase, a, l, r, n, score) of the candidates that no longer one holds ``percent`` as often."""
    w = F.split("phrase", " ")
    candidates = counts.where("k > 1").select("lang", "k", "phrase", F.col("c").alias("a"), w.alias("w"))
    cuts = candidates.select("lang", "k", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = _look_up(_look_up(store(cuts, "cuts"), counts, "first", "l"), counts, "rest", "r")
    words = F.broadcast(words) if small_enough(words, BROADCAST) else words
    big = {c: F.col(c).cast("decimal(38,0)") for c in "anlr"}
    cuts = cuts.join(words, "lang").withColumns({"top": big["a"] * big["n"] * F.lit(1000), "bottom": big["l"] * big["r"]})
    cuts = cuts.withColumn("score", F.expr("top div bottom"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    # every phrase inside a longer candidate, with the highest count of such
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    inside = candidates.where("k > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    best = best.join(inside, ["lang", "phrase"], "left")
    return best.where(F.coalesce(F.col("longer") * 100 < F.col("a") * percent, F.lit(True))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = PERCENT, top: int = TOP, widest: int = WIDEST) -> DataFrame:
    """(text, lang) to (lang, rank, phrase, a, l, r, n, score), each language's first ``top``."""
    found = store(score(*frequent(docs, least, longest, widest), percent), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(W.partitionBy("lang", *by).orderBy(*order)).cast("long")
    # the first of each part of a language hold the first of all of it
    found = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    found = found.withColumn("rank", rank("part")).where(F.col("rank") <= top)
    found = found.withColumn("rank", rank()).where(F.col("rank") <= top)
    return found.select("lang", "rank", "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM i)),
n AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS c FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
cuts AS (SELECT *, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.c AS a, j, x.c AS l, y.c AS r, n,
    CAST(1000::HUGEINT * cuts.c::HUGEINT * n::HUGEINT // (x.c::HUGEINT * y.c::HUGEINT) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest JOIN n ON n.lang = cuts.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
spans AS (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2),
inside AS (SELECT lang, phrase, max(c) AS longer FROM (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, c FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM spans)) GROUP BY lang, phrase),
kept AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""
