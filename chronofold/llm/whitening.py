"""Embedding whitening from a compensated covariance.

Vectors become whole numbers ``floor(SCALE * c) + SHIFT``; each distinct one counts once. Their sums are exact. A row is
centred in double-double (its whole number less the mean, as a high and a low part), and outer products of centred rows are
added up in double-double too. The products are error-free: a column is split into parts of ``BITS`` bits, so that the
product of two parts, summed over ``BLOCK`` rows, still fits a double and a matrix product of parts has no rounding at all;
only the sum of such products is rounded, and its error is carried in the low part. Tasks give a high and a low part for
each row of the matrix, and both are merged, again without loss, in tasks that each hold some rows of the matrix.

The matrix is reduced to tridiagonal form and solved by divide and conquer (LAPACK's ``syevd``) on the driver: dimensions
squared, at most ``DIMENSIONS`` squared numbers, whatever the number of vectors.

Defined results: a vector that is NULL or holds a NULL or non-finite entry, or one beyond 2^52 / ``SCALE``, gives no row, nor
does one of another length than most have (ties: the shortest); repeated ids and rows each give rows, and a NULL id stays; a component
without variance has NULL for ``whitened``, and ``explained`` is NULL where no component has any; fewer dimensions than components give
as many as there are; a deviation past 64 bits is NULL; no rows give no rows. Other columns aren't read.
"""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, store, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, DIMENSIONS = 16, 4096
#: Rows of a block of products, and bits of a part of a number: two parts and the sum over a block fit 53 bits.
BLOCK, BITS = 1024, 21


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  # falling
    vectors: np.ndarray  # a column a component
    trace: float
    identity_error: float | None


# --- double-double --------------------------------------------------------------------------------------------------


def two_sum(a, b):
    """The rounded sum, and what rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high, low, more, more_low=0.0):
    s, e = two_sum(high, more)
    e = e + (low + more_low)
    t = s + e
    return t, e - (t - s)


def mean_parts(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    exact = [Fraction(s, n) for s in sums]
    high = [float(x) for x in exact]
    return np.array(high), np.array([float(x - Fraction(h)) for x, h in zip(exact, high, strict=True)])


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return add(*two_sum(x.astype(np.float64), -mean[0]), -mean[1])


def parts(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Three matrices that add up to ``high + low``; the first two are whole multiples, of ``BITS`` bits, of a power of two of
    each column."""
    top = np.abs(high).max(axis=0, initial=0)
    grid = np.ldexp(1.0, np.frexp(top)[1] - BITS)
    out, rest = [], high
    for _ in range(2):
        one = np.rint(rest / grid) * grid
        rest = rest - one
        out.append(one)
        grid = grid * 2.0**-BITS
    return [*out, rest + low]


def products(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the outer products of the rows of ``high + low``, as a high and a low part."""
    total = lost = np.zeros((high.shape[1], high.shape[1]))
    for i in range(0, len(high), BLOCK):
        a, b, c = parts(high[i : i + BLOCK], low[i : i + BLOCK])
        cross, far, small = a.T @ b, a.T @ c, b.T @ c
        for term in (a.T @ a, cross, cross.T, b.T @ b, far, far.T, small, small.T):
            total, lost = add(total, lost, term)
    return total, lost


# --- jobs -----------------------------------------------------------------------------------------------------------


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def coded(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, embedding) to (vec_id, x) of the vectors that count: whole numbers."""
    wide = F.transform("embedding", lambda c: c.cast("double") * scale)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("w"))
    rows = rows.where(F.forall("w", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**52)))
    return rows.select("vec_id", F.transform("w", lambda c: F.floor(c).cast("long") + shift).alias("x"))


def _sums(batches):
    """For each dimension the exact sum of the task's rows; at -1 their number."""
    from decimal import Decimal

    import pyarrow as pa

    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"))
            each = [(h << 26) + l for h, l in zip((x >> 26).sum(axis=0).tolist(), (x & (1 << 26) - 1).sum(axis=0).tolist(), strict=True)]
            n, total = n + len(x), each if total is None else [a + b for a, b in zip(total, each, strict=True)]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))], names=["d", "total"])


def _rows(high: dict[int, np.ndarray], low: dict[int, np.ndarray]):
    import pyarrow as pa

    kind = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(list(high), pa.int32()), pa.array(list(high.values()), kind), pa.array([low[i] for i in high], kind)], names=["d", "high", "low"])


def _outer(values):
    """Of each task, the high and low rows of the sum of outer products of ``values`` of its matrices."""

    def run(batches):
        high = low = None
        for batch in batches:
            if batch.num_rows:
                more = products(*values(_matrix(batch.column("x"))))
                high, low = more if high is None else add(high, low, *more)
        if high is not None:
            yield _rows(dict(enumerate(high)), dict(enumerate(low)))

    return run


def _merge(batches):
    high, low = {}, {}
    for batch in batches:
        for i, h, l in zip(batch.column("d").to_pylist(), _matrix(batch.column("high")), _matrix(batch.column("low")), strict=True):
            high[i], low[i] = add(high[i], low[i], h, l) if i in high else (h, l)
    if high:
        yield _rows(high, low)


def moments(fit: DataFrame, n: int, values) -> tuple[np.ndarray, np.ndarray]:
    """High and low part of the matrix of ``values``' products over all rows of ``fit``, divided by n."""
    kind = "d int, high array<double>, low array<double>"
    merged = fit.select("x").mapInArrow(_outer(values), kind).repartition("d").mapInArrow(_merge, kind)
    got = merged.orderBy("d").collect()  # a row a dimension
    high, low = (np.array([r[k] for r in got]) for k in ("high", "low"))
    q = high / n
    # what the division leaves, exactly: n * q as a product of two parts each
    p, e = _two_product(q, float(n))
    return q, ((high - p) - e + low) / n


def _two_product(a, b):
    def split(x):
        t = x * 134217729.0  # 2^27 + 1
        h = t - (t - x)
        return h, x - h

    p, (ah, al), (bh, bl) = a * b, split(a), split(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fits on each distinct ``x`` of ``coded`` rows of one length; None without rows."""
    ship(rows.sparkSession)
    distinct = store(rows.select("x").distinct(), "distinct-vectors")
    totals = dict(distinct.mapInArrow(_sums, "d int, total decimal(38,0)").groupBy("d").agg(F.sum("total").cast("decimal(38,0)")).collect())
    if not totals:
        return None
    n, sums = int(totals[-1]), [int(totals[i]) for i in range(len(totals) - 1)]
    if len(sums) > DIMENSIONS:
        raise ValueError(f"vectors of over {DIMENSIONS} dimensions")
    mean = mean_parts(sums, n)
    high, low = moments(distinct, n, lambda x: centred(x, mean))
    v = high + low
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1][:components].copy(), vectors[:, ::-1][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    values[values <= len(sums) * np.finfo(float).eps * max(values[0], 0)] = 0
    model = Whitening(n, sums, values, vectors, float(np.trace(high) + np.trace(low)), None)
    some = values > 0
    if not some.any():
        return model
    own = _projection(model)
    own = own[0][:, some]

    def white(x):
        c = centred(x, mean)
        w = (c[0] + c[1]) @ own
        return w, np.zeros_like(w)

    again = sum(moments(distinct, n, white))
    return model._replace(identity_error=float(np.abs(again - np.eye(len(again))).max()))


def _projection(model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    some = model.values > 0
    return np.where(some, model.vectors / np.sqrt(np.where(some, model.values, 1)), 0), some


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n * x - S)^2, exact; None past 64 bits."""
    most = max([n * int(np.abs(x).max(initial=0)) + abs(s) for s in sums], default=0)
    d = x * n - np.array(sums) if most < 2**62 else x.astype(object) * n - np.array(sums, dtype=object)
    if d.size and d.shape[1] * max(int(d.max()), -int(d.min())) ** 2 < 2**63:
        return (d * d).sum(axis=1).tolist()
    total = (d.astype(object) ** 2).sum(axis=1).tolist()
    return [t if t < 2**63 else None for t in total]


def _apply(model: Whitening):
    mean, (own, some) = mean_parts(model.sums, model.n), _projection(model)
    k = own.shape[1]
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.values]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            rows = len(x)
            c = centred(x, mean)
            white = ((c[0] + c[1]) @ own).reshape(-1)
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)),
                    pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(each)), pa.array(white, mask=~np.tile(some, rows)),
                    pa.array(explained * rows, pa.float64()), pa.array([model.identity_error] * (rows * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def transform(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, x) to a row a component."""
    ship(rows.sparkSession)
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.sparkSession.createDataFrame([], kind) if model is None else rows.select("vec_id", "x").mapInArrow(_apply(model), kind)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, embedding) to (vec_id, component, n, deviation, whitened, explained, identity_error), a row a component."""
    rows = coded(vectors, scale, shift)
    length = rows.groupBy(F.size("x").alias("l")).count().orderBy(F.desc("count"), "l").first()
    rows = rows.where(F.size("x") == (length["l"] if length else 0))
    return transform(rows, fit(rows, components) if length and length["l"] else None)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
