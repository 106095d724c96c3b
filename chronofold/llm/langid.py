"""Language by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, everything but letters becomes one space, and its n-grams of 1 to 3 code points, spaces included,
are hashed into ``BUCKETS``. Counts by language are summed on the executors; the log-probability matrix, of ``MATRIX``
numbers at most, goes to every task, where numpy adds the rows that a text's n-grams select. With over MATRIX / BUCKETS =
128 languages there are fewer buckets, so that all are learned and the matrix stays bounded. The fit takes about
``PER_LANGUAGE`` rows of each language at most, chosen by a hash of id and text, and weighs languages by their counts over
all rows. ``lang`` is taken to have ``LANGUAGES`` values at most; more are an error, as they can't be languages.

Defined results: a NULL text or one without a letter is ``und`` with score 0; with no labelled rows all are ``und``;
equal scores go to the language first in order; repeated ids and rows each give a row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, ship, slices, table

BUCKETS, ORDERS = 1 << 16, (1, 2, 3)
PER_LANGUAGE, LANGUAGES = 5_000, 1 << 15
MATRIX = 1 << 23
SMOOTHING, FOLDS, UNKNOWN = 0.5, 4, "und"
#: Code points handled at once.
RUN = 400_000


def letters(text: str) -> str:
    """Lower case, each run of other characters one space, a space at either end; without a letter, empty."""
    text = text.lower()
    if text.isascii():
        text = text.translate(_ASCII)
    else:
        text = "".join([c if c.isalpha() else " " for c in text]) if not _latin(text) else text.translate(_LATIN)
    words = text.split()
    return f" {' '.join(words)} " if words else ""


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_ASCII = "".join(chr(i) if chr(i).isalpha() else " " for i in range(128))
_LATIN = "".join(chr(i) if chr(i).isalpha() else " " for i in range(256))


def buckets_for(languages: int) -> int:
    """A power of two: BUCKETS, or fewer where the matrix would be too large."""
    n = BUCKETS
    while n * languages > MATRIX:
        n //= 2
    return n


def grams(points: np.ndarray, buckets: int = BUCKETS) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each place, for each order; those that would run over the end are left out."""
    x = points.astype(np.uint32)
    out = []
    for n in ORDERS:
        if len(x) < n:
            out.append(np.zeros(0, dtype=np.int64))
            continue
        h = np.full(len(x) - n + 1, n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ x[k : len(x) - n + 1 + k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out.append((h & np.uint32(buckets - 1)).astype(np.int64))
    return out


def _runs(texts: list[str]):
    """(indices of texts, code points, starts) with whole texts joined, or parts of a long one, of RUN at most."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for j in range(0, max(1, len(text)), RUN):
            part = text[j : j + RUN + max(ORDERS) - 1]
            if held and size + len(part) > RUN:
                yield _joined(held)
                held, size = [], 0
            held.append((i, part))
            size += len(part)
    if held:
        yield _joined(held)


def _joined(held):
    flat = np.frombuffer("".join([p for _, p in held]).encode("utf-32-le", "surrogatepass"), "<u4")
    return np.array([i for i, _ in held]), flat, np.cumsum([0, *(len(p) for _, p in held)])


def _spans(h: np.ndarray, n: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) n-gram of each part that lies in it wholly and doesn't begin in the next one's characters."""
    first = np.minimum(starts[:-1], len(h))
    return first, np.maximum(first, np.minimum(np.minimum(starts[1:] - n + 1, starts[:-1] + RUN), len(h)))


def _count(languages: list[str], buckets: int):
    def run(batches):
        import pyarrow as pa

        place = {x: k for k, x in enumerate(languages)}
        counts = np.zeros((len(languages), buckets), dtype=np.int64)
        for batch in slices(batches):
            langs = batch.column("lang").to_pylist()
            for who, flat, starts in _runs([letters(t or "") for t in batch.column("text").to_pylist()]):
                for n, h in zip(ORDERS, grams(flat, buckets), strict=True):
                    for i, a, b in zip(who, *_spans(h, n, starts), strict=True):
                        counts[place[langs[i]]] += np.bincount(h[a:b], minlength=buckets)
        lang, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(lang.astype(np.int32)), "bucket": pa.array(bucket.astype(np.int32)), "n": pa.array(counts[lang, bucket])})

    return run


class Model:
    def __init__(self, languages: list[str], logs: np.ndarray, priors: np.ndarray):
        self.languages, self.logs, self.priors = languages, logs, priors

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        clean = [letters(t or "") for t in texts]
        total = np.tile(self.priors, (len(texts), 1))
        for who, flat, starts in _runs(clean) if self.languages else ():
            for n, h in zip(ORDERS, grams(flat, self.logs.shape[1]), strict=True):
                first, last = _spans(h, n, starts)
                some = last > first
                # each part is summed on its own, so that equal texts have equal scores whatever stands beside them
                cuts = np.stack([first[some], last[some]], axis=1).reshape(-1)
                h = np.append(h, 0)
                for k in range(len(self.languages) if len(cuts) else 0):
                    np.add.at(total[:, k], who[some], np.add.reduceat(self.logs[k].take(h), cuts)[::2])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        known = np.array([bool(c) for c in clean], dtype=bool)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from (doc_id, text, lang)."""
    ship(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().limit(LANGUAGES + 1).collect())
    if len(sizes) > LANGUAGES:
        raise ValueError(f"lang has over {LANGUAGES} values")
    languages = [x for x, _ in sizes]
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    buckets = buckets_for(len(languages))
    # the share of a language's rows that gives per_language of them
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    shares = docs.sparkSession.createDataFrame([(x, min(1.0, per_language / n)) for x, n in sizes], "lang string, share double")
    sample = known.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", "text")  # LANGUAGES rows at most
    counted = sample.mapInArrow(_count(languages, buckets), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # MATRIX rows at most
    counts = np.zeros((len(languages), buckets))
    counts[got["lang"], got["bucket"]] = got["n"]
    logs = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING * buckets)
    weight = np.array([n for _, n in sizes], dtype=float)
    return Model(languages, logs, np.log(weight / weight.sum()))


def _predict(model: Model):
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            langs, scores = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) to (doc_id, lang_pred, score)."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def select(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` that show a language with a score of ``least`` at least, as they are."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            langs, scores = model.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_mod("doc_id", FOLDS) != 2))
    held = (crc_mod("doc_id", FOLDS) == 2).alias("held_out")
    return predict(docs, model).select("doc_id", held, "lang_pred", "score")
