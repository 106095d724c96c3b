"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is cut into blocks of ``BLOCK`` bytes, all of it, and each block is compressed with the dictionary trained on good
texts and with the one trained on bad texts. The normalised difference of the summed sizes becomes a probability by a
logistic curve, fitted on other labelled rows than the dictionaries were. The curve is a linear spline in that difference;
how far the text compresses at all and how long it is (the difference of a few words is mostly noise) are splines beside it.
Knots are quantiles of the rows that the curve is fitted on.

The fit takes at most ``PER_CLASS`` labelled texts of each class for the dictionaries, ``SAMPLES`` blocks of each, spread over
the whole text, and as many whole texts for the curve, chosen by hashes of id and text. Texts of any length are read on
the executors; the driver gets those blocks, and three sizes of each text of the curve. The curve weighs rows so that the
classes count as often as in all labels. Scoring covers all of every text.

Defined results: NULL and empty texts are scored as the empty text; without labelled texts of both classes every score is
the share of good labels, or 0.5 with none; labels other than 0 and 1 and ids without a document don't count; equal
(id, text, label) rows count once in the fit; repeated ids and rows each give a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, ship, slices, store, table

BLOCK, LEVEL, DICTIONARY = 1024, 3, 65_536
#: Texts of a class that the dictionaries are trained on, and the curve, at most; blocks of a text for a dictionary.
PER_CLASS, SAMPLES = 2_000, 8
#: Quantiles at which a spline has its knots; closer at the ends, where repetition and noise lie.
KNOTS = (0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99)
THRESHOLD, FOLDS = 0.3, 5


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    knots: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    prior: float = 0.5


class Sizes:
    """Compressed sizes of a text with either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def compressor(data: bytes):
            kind = zstandard.ZstdCompressionDict(data)
            kind.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=kind, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.good, self.bad = compressor(good), compressor(bad)

    def of(self, text: str | None) -> tuple[int, int, int]:
        data = (text or "").encode()
        blocks = [data[i : i + BLOCK] for i in range(0, max(1, len(data)), BLOCK)]
        return sum(len(self.good(b)) for b in blocks), sum(len(self.bad(b)) for b in blocks), len(data)


def measures(sizes: np.ndarray) -> np.ndarray:
    """(good, bad, length) to the normalised difference, the ratio of compression and the logarithm of the length."""
    good, bad, length = sizes.T.astype(float)
    return np.stack([(bad - good) / (bad + good), good / (length + 16), np.log(length + 16)], axis=1)


def choose_knots(sizes: np.ndarray) -> np.ndarray:
    """A row for each measure: its quantiles."""
    return np.quantile(measures(sizes), KNOTS, axis=0).T


def features(sizes: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """A constant, the measures, and their hinges at the knots."""
    m = measures(sizes)
    hinges = [np.maximum(0, m[:, k, None] - knots[k]) for k in range(3)]
    return np.concatenate([np.ones((len(m), 1)), m, *hinges], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Penalised logistic regression by Newton's method: mean, scale, weights."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-9] = 1
    x, w = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = x.T @ (weight * (y - p)) - penalty * w
        w += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), step)
    return mean, scale, w


def probability(model: Model, sizes: np.ndarray) -> np.ndarray:
    if model.weights is None:
        return np.full(len(sizes), model.prior)
    z = (features(sizes, model.knots) - model.mean) / model.scale @ model.weights
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sample_blocks(text: str | None, most: int = SAMPLES) -> list[bytes]:
    """At most ``most`` blocks of a text, at equal distances over all of it; those of under 8 bytes are left out."""
    data = (text or "").encode()
    n = -(-len(data) // BLOCK)
    places = sorted({k * n // most for k in range(most)}) if n > most else range(n)
    return [s for k in places if len(s := data[k * BLOCK : (k + 1) * BLOCK]) >= 8]


def train_dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: their own bytes serve as the dictionary
        return b"".join(samples)[-DICTIONARY:]


def _blocks(batches):
    import pyarrow as pa

    for batch in slices(batches):
        for id_, hash_, quality, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "hash", "quality", "text")], strict=True):
            got = sample_blocks(text)
            n = len(got)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([id_] * n, pa.int64()), "hash": pa.array([hash_] * n, pa.int64()), "quality": pa.array([quality] * n, pa.int32()), "place": pa.array(range(n), pa.int32()), "block": pa.array(got, pa.binary())})


def _sizes(model: Model):
    def run(batches):
        import pyarrow as pa

        sizes = Sizes(model.good, model.bad)
        for batch in slices(batches):
            got = np.array([sizes.of(t) for t in batch.column("text").to_pylist()], dtype=np.int64)
            cols = [*map(batch.column, ("doc_id", "hash", "quality")), *(pa.array(got[:, k]) for k in range(3))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "hash", "quality", "good", "bad", "length"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from ``labels`` (doc_id, quality) and the texts of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1) AND doc_id IS NOT NULL")
    total = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    if len(total) < 2:
        return Model(prior=float(next(iter(total), 0.5)))
    prior = total[1] / (total[0] + total[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").where("text IS NOT NULL")
    known = texts.select("doc_id", "hash").join(marked, "doc_id").distinct()
    turn = F.pmod(F.xxhash64(F.lit(3), "doc_id", "hash"), F.lit(2)).alias("turn")
    order = [F.xxhash64("doc_id", "hash"), "doc_id", "hash"]
    picked = [known.where((F.col("quality") == q) & (turn == t)).orderBy(*order).limit(per_class).withColumn("turn", F.lit(t)) for q in (0, 1) for t in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).unionByName(picked[2]).unionByName(picked[3]).toPandas()  # 4 * per_class rows of numbers at most
    if len(chosen.groupby(["quality", "turn"])) < 4:
        return Model(prior=prior)
    chosen = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, hash long, quality int, turn int"))
    rows = store(texts.drop("hash").join(chosen, "doc_id").where(F.xxhash64("text") == F.col("hash")), "labelled")
    # equal rows give equal blocks and sizes, which count once: so what comes to the driver is bounded
    blocks = rows.where("turn = 0").select("doc_id", "hash", "quality", "text").mapInArrow(_blocks, "doc_id long, hash long, quality int, place int, block binary")
    blocks = blocks.distinct().orderBy("quality", *order, "place").select("quality", "block").toPandas()
    samples = [[bytes(b) for b in blocks.block[blocks.quality == q]] for q in (0, 1)]
    model = Model(good=train_dictionary(samples[1]), bad=train_dictionary(samples[0]), prior=prior)
    sizes = rows.where("turn = 1").select("doc_id", "hash", "quality", "text").mapInArrow(_sizes(model), "doc_id long, hash long, quality int, good long, bad long, length long")
    sizes = sizes.distinct().orderBy("quality", *order).toPandas()
    y, x = sizes.quality.to_numpy(), sizes[["good", "bad", "length"]].to_numpy()
    share = np.array([total[q] / max(1, (y == q).sum()) for q in (0, 1)])
    weight = share[y] * len(y) / share[y].sum()
    model.knots = choose_knots(x)
    model.mean, model.scale, model.weights = fit_curve(features(x, model.knots), y, weight)
    return model


def _score(model: Model):
    def run(batches):
        import pyarrow as pa

        sizes = Sizes(model.good, model.bad) if model.weights is not None else None
        for batch in slices(batches):
            got = np.array([sizes.of(t) if sizes else (0, 0, 0) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probability(model, got))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) to (doc_id, score)."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, score double")


def select(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` at least, as they are."""

    def run(batches):
        import pyarrow as pa

        sizes = Sizes(model.good, model.bad) if model.weights is not None else None
        for batch in slices(batches):
            got = np.array([sizes.of(t) if sizes else (0, 0, 0) for t in batch.column(text).to_pylist()]).reshape(-1, 3)
            yield batch.filter(pa.array(probability(model, got) >= threshold))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(crc_mod("doc_id", FOLDS) != 0))
    held = (crc_mod("doc_id", FOLDS) == 0).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
