"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside them.

Equal vectors of a label are one node with a multiplicity. Cell centres are fitted on a bounded sample, at every size of
table; each node goes to its nearest centre and also to every lower-numbered cell whose border it lies within the chord of
``COSINE`` of: a partner on the other side of that border can't be farther. So every pair at 0.98 or more meets exactly
once, and no recall is lost. How many cells there are is chosen on the sample: the number for which the copies that go over
borders and the products that are left cost least.

A cell of more than ``BLOCK`` rows is cut into blocks, and its pairs of blocks are tasks of their own. A task cuts its rows
into smaller cells by k-means once more and multiplies each such cell only with the rows that lie within the chord of its
border, which is exact for the same reason. It returns, for each row, the weight of its links and the smallest node it
reaches there, never the pairs.

Defined results: a vector that is NULL, empty, zero, or holds a NULL or non-finite component, or has a NULL label or
vec_id, links with nothing; vectors of different length don't link; repeated ids and rows each give a row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, ship, store, table
from .graph import connected

COSINE = 0.98
#: Vectors that the centres are fitted on, at most; centres, at most; rows of a block; rows of a cell inside a task.
SAMPLE, CELLS, BLOCK, FINE = 20_000, 2_048, 8_192, 96
#: Seconds of a row that is copied over a border or to a block, and of a product of two vectors.
COPY, PRODUCT = 2e-5, 4e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def fit_centres(vectors: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit vectors; fewer than k centres where vectors repeat."""
    rng = np.random.RandomState(seed)
    centres = vectors[rng.permutation(len(vectors))[:k]].copy()
    for _ in range(rounds):
        home = (vectors @ centres.T).argmax(axis=1)
        for d in range(vectors.shape[1]):
            centres[:, d] = np.bincount(home, weights=vectors[:, d], minlength=len(centres))
        size = np.sqrt(np.einsum("ij,ij->i", centres, centres))
        lost = np.flatnonzero(size < 1e-12)
        centres[lost] = vectors[rng.randint(0, len(vectors), len(lost))]
        size[lost] = 1
        centres /= size[:, None]
    return np.unique(centres, axis=0)


def margins(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each unit vector, and how far it lies from the border with each other centre's cell."""
    dots = vectors @ centres.T
    home = dots.argmax(axis=1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))
    gap = np.maximum(gap, 1e-4)  # where centres almost meet, a margin may be said to be smaller, never larger
    return home, (dots[np.arange(len(dots)), home][:, None] - dots) / gap[home]


def chord(cosine: float) -> float:
    return float(np.sqrt(2 - 2 * cosine)) + 1e-9


def choose_centres(vectors: np.ndarray, group: np.ndarray, scale: float, cosine: float = COSINE, block: int = BLOCK, most: int = CELLS) -> np.ndarray:
    """Centres for which copies and products cost least over ``scale`` times the sample; two at least where vectors differ.

    ``group`` numbers the label of each vector: only rows of a label and cell meet.
    """
    best, found, k = np.inf, vectors[:1], 2
    while k <= max(2, min(most, len(vectors) // 8)):
        centres = fit_centres(vectors, min(k, len(vectors)))
        home, margin = margins(vectors, centres)
        near = (margin <= chord(cosine)) & (np.arange(len(centres)) < home[:, None])
        m = len(centres)
        own = scale * np.bincount(group * m + home, minlength=m * (group.max() + 1))
        row, cell = np.nonzero(near)
        copies = scale * np.bincount(group[row] * m + cell, minlength=len(own))
        there = own + copies
        cost = COPY * (there * np.ceil(there / block)).sum() + PRODUCT * (own * (own / 2 + copies)).sum()
        if cost >= best:
            break
        best, found, k = cost, centres, 2 * k
    return found


def _matrix(column) -> np.ndarray:
    """Arrow list column of equal lengths to a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _assign(centres: dict[int, np.ndarray], width: float):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        step = max(256, (1 << 20) // max([len(c) for c in centres.values()], default=1))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                part = whole.slice(i, step)
                for dim in pc.unique(part.column("dim")).to_pylist():
                    batch = part.filter(pc.equal(part.column("dim"), dim))
                    if dim in centres:
                        home, margin = margins(unit(_matrix(batch.column("embedding"))), centres[dim])
                        near = (margin <= width) & (np.arange(len(centres[dim])) < home[:, None])
                        near[np.arange(len(home)), home] = True
                        row, cell = np.nonzero(near)
                    else:  # a length that the sample doesn't have
                        home = np.zeros(batch.num_rows, dtype=np.int64)
                        row, cell = np.arange(len(home)), home
                    out = batch.take(pa.array(row))
                    cols = [out.column(x) for x in ("label", "dim", "node", "weight", "embedding")]
                    yield pa.RecordBatch.from_arrays(
                        [*cols[:2], pa.array(cell.astype(np.int32)), pa.array(home[row] == cell), *cols[2:]],
                        names=["label", "dim", "cell", "home", "node", "weight", "embedding"],
                    )

    return run


def products(v: np.ndarray, a: np.ndarray, b: np.ndarray, meets, cosine: float = COSINE):
    """Yields (rows, columns, mask): which of the unit vectors ``v[rows]`` and ``v[columns]`` link, rows from ``a`` and
    columns from ``b`` (positions in v; the same array, or disjoint ones). Each pair is compared once at most.

    ``meets(rows, columns)`` is a mask of the pairs that count.
    """
    rng = np.random.RandomState(5)
    centres = fit_centres(v[rng.permutation(len(v))[:4096]], max(1, min(64, len(v) // FINE)), rounds=3)
    home, margin = margins(v, centres)
    close = margin <= chord(cosine)
    within = len(a) == len(b) and a[0] == b[0]
    for c in range(len(centres)):
        # rows whose cell is c, with columns near its border; a pair of two cells is compared in one of them
        sides = [(a[home[a] == c], b[close[b, c] & (home[b] >= c)])]
        if not within:
            sides.append((a[close[a, c] & (home[a] > c)], b[home[b] == c]))
        for left, right in sides:
            if len(left) and len(right):
                for i in range(0, len(left), 1024):
                    rows = left[i : i + 1024]
                    mask = v[rows] @ v[right].T >= cosine
                    mask &= meets(rows, right)
                    if within:  # both in cell c: once
                        mask &= (home[right][None, :] > c) | (rows[:, None] < right[None, :])
                    yield rows, right, mask


def _within(cosine: float):
    def run(group):
        """Links of two blocks of a cell, or of a block with itself."""
        import pyarrow as pa

        block = group.column("block").to_numpy()
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        node, weight = group.column("node").to_numpy(), group.column("weight").to_numpy()
        home = group.column("home").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        v = unit(_matrix(group.column("embedding").combine_chunks()))
        # a pair of two copies meets in the cell of one of them
        meets = lambda x, y: home[x][:, None] | home[y][None, :]
        count, low, hits = np.zeros(len(node), dtype=np.int64), node.copy(), []
        for x, y, mask in products(v, np.flatnonzero(block == p), np.flatnonzero(block == q), meets, cosine):
            r, c = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
            if len(r):
                x, y, mask = x[r], y[c], mask[np.ix_(r, c)]
                np.add.at(count, x, mask @ weight[y])
                np.add.at(count, y, mask.T @ weight[x])
                hits.append((x, y, mask))
        moved, top = bool(hits), np.iinfo(np.int64).max
        while moved:
            before = low.copy()
            for x, y, mask in hits:
                low[x] = np.minimum(low[x], np.where(mask, low[y][None, :], top).min(axis=1))
                low[y] = np.minimum(low[y], np.where(mask, low[x][:, None], top).min(axis=0))
            moved = bool((low != before).any())
        keep = count > 0
        return pa.table({"node": node[keep], "links": count[keep], "low": low[keep]})

    return run


def _key(label: Column, embedding: Column) -> list[Column]:
    """128 bits that tell nodes apart."""
    return [F.xxhash64(F.lit(k), label, embedding).alias(f"k{k}") for k in (1, 2)]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """(vec_id, embedding, label) to (vec_id, n_links, component_id, kept)."""
    spark = vectors.sparkSession
    ship(spark)
    # adding zero makes -0.0 and 0.0 one value
    plain = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), plain.alias("embedding"), "label")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    usable = rows.where("fine")
    nodes = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"))
    keys = _key(F.col("label"), F.col("embedding"))
    nodes = store(nodes.select(F.monotonically_increasing_id().alias("node"), *keys, "*", F.size("embedding").alias("dim")), "nodes")

    picked = nodes.select("dim", F.xxhash64("label").alias("label"), "embedding").orderBy(F.xxhash64("embedding")).limit(sample).toPandas()
    n, centres = nodes.count(), {}
    for dim, part in picked.groupby("dim"):
        group = np.unique(part["label"].to_numpy(), return_inverse=True)[1]
        centres[int(dim)] = choose_centres(unit(np.stack(part["embedding"].map(np.asarray).to_list())), group, n / len(picked), cosine, block, cells)

    kind = dict(nodes.dtypes)
    schema = f"label {kind['label']}, dim int, cell int, home boolean, node long, weight long, embedding {kind['embedding']}"
    placed = store(nodes.select("label", "dim", "node", "weight", "embedding").mapInArrow(_assign(centres, chord(cosine)), schema), "placed")
    key = ["label", "dim", "cell"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("n"))
    placed = join_counted(placed, store(sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "sizes"), key)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = placed.select(*key, "home", "node", "weight", "embedding", "block", other)
    paired = paired.select("*", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    found = store(paired.groupBy(*key, "p", "q").applyInArrow(_within(cosine), "node long, links long, low long"), "found")

    roots = connected(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    flat = nodes.select("node", "k1", "k2", "first_id", "weight").join(roots, "node", "left").join(links, "node", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("weight") - 1
    flat = store(flat.select("k1", "k2", "first_id", "weight", F.coalesce("root", "node").alias("root"), n_links.alias("n_links")), "flat")
    lowest = flat.where("n_links >= weight").groupBy("root").agg(F.min("first_id").alias("component_id"))
    flat = flat.join(lowest, "root", "left").withColumn("component_id", F.coalesce("component_id", "first_id"))
    single = flat.where("weight = 1").select(F.col("first_id").alias("vec_id"), "n_links", "component_id")
    several = flat.where("weight > 1").select("k1", "k2", "weight", "n_links", "component_id")
    repeated = join_counted(usable.select("vec_id", *keys), several, ["k1", "k2"], "weight").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = single.unionByName(repeated).unionByName(alone)
    return linked.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), r(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT c.x AS vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.x = c.component_id AS kept
FROM c LEFT JOIN n ON c.x = n.x
"""
