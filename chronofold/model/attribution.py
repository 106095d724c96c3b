"""Shapley values of a boosted-tree model: what each feature adds to a row's log-odds, exactly and additively.

A feature that isn't known counts as the training rows' share of each branch. A leaf is then a product over the features on
its path, of whether the row takes the leaf's branches (known) or of the share that does (unknown), and its Shapley values
are weighted coefficients of the product of the polynomials share + taken * t of the other features. Trees come from the
model's saved form and are small, so they go to the workers with the task; rows are never gathered.
"""

from __future__ import annotations

from math import factorial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import Feature
from ..session import reach_workers
from .train import matrix

#: Nodes of all trees, at most: they are read to the driver and sent with each task.
NODES = 1 << 20
#: Rows whose paths are held at once.
CHUNK = 8192


def leaves(model, folder: str) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """(value, [(column, above, upto, share)]) by leaf: its part of the log-odds, and for each column on its path the interval
    (above, upto] that leads there and the share of the training rows at these splits that it takes.

    ``folder`` is a new folder that driver and executors share; the trees are saved there and read back.
    """
    trees = model.stages[1]
    trees.write().overwrite().save(folder)
    saved = _nodes(SparkSession.active().read.parquet(f"{folder}/data"))
    out = []
    for tree, weight in enumerate(trees.treeWeights):
        nodes = saved[tree]
        todo = [(nodes[0], {})]
        while todo:
            node, path = todo.pop()
            if node["leftChild"] < 0:
                # the model's probability is that of log-odds of twice its margin
                out.append((2 * weight * node["prediction"], [(c, *p) for c, p in sorted(path.items())]))
                continue
            if node["split"]["numCategories"] != -1:
                raise ValueError("splits by category have no intervals")
            column, at, rows = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0], node["impurityStats"][0]
            above, upto, share = path.get(column, (-np.inf, np.inf, 1.0))
            left, right = nodes[node["leftChild"]], nodes[node["rightChild"]]
            todo.append((left, path | {column: (above, min(upto, at), share * left["impurityStats"][0] / rows)}))
            todo.append((right, path | {column: (max(above, at), upto, share * right["impurityStats"][0] / rows)}))
    return out


def _nodes(saved: DataFrame) -> dict[int, dict[int, dict]]:
    """The saved nodes by tree and id."""
    rows = saved.limit(NODES + 1).collect()
    if len(rows) > NODES:
        raise ValueError(f"more than {NODES} nodes")
    out: dict[int, dict[int, dict]] = {}
    for r in rows:
        out.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"].asDict(recursive=True)
    return out


def base(found: list) -> float:
    """The log-odds of a row of which nothing is known."""
    return float(sum(value * np.prod([p[3] for p in path]) for value, path in found))


def shapley(found: list, x: np.ndarray) -> np.ndarray:
    """Shapley values by row and column of x."""
    out = np.zeros(x.shape)
    for value, path in found:
        m = len(path)
        taken = [((x[:, c] > above) & (x[:, c] <= upto)).astype(float) for c, above, upto, _ in path]
        for i, (column, _, _, own) in enumerate(path):
            # coefficient k: products in which k of the other features are known
            product = np.zeros((m, len(x)))
            product[0] = 1
            for j, (_, _, _, share) in enumerate(path):
                if j != i:
                    product[1:] = share * product[1:] + taken[j] * product[:-1]
                    product[0] *= share
            weights = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
            out[:, column] += value * (taken[i] - own) * (weights @ product)
    return out


def _run(found: list, names: list[str], owner: np.ndarray, features: int, keep: list[str]):
    def run(batches):
        import pyarrow as pa

        start = base(found)
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(i, CHUNK)
                each = shapley(found, np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1))
                by = np.zeros((len(each), features))
                np.add.at(by.T, owner, each.T)
                ends = pa.array(np.arange(len(by) + 1, dtype=np.int32) * features)
                cols = [batch.column(k) for k in keep]
                cols += [pa.array(np.full(len(by), start)), pa.ListArray.from_arrays(ends, pa.array(by.ravel()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "base", "contributions"])

    return run


def contributions(model, df: DataFrame, features: tuple[Feature, ...], keep: list[str], folder: str) -> DataFrame:
    """``keep``, base and contributions, an array in the contract's order: base and its sum are the row's log-odds.

    A feature's contribution includes that of its flag of missing values. No rows give no rows.
    """
    reach_workers(df.sparkSession)
    x, names = matrix(df, features)
    place = {f.name: k for k, f in enumerate(features)}
    owner = np.array([place[n[2:]] for n in names])  # x_ and m_ columns
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "base double", "contributions array<double>"])
    return x.select(*keep, *names).mapInArrow(_run(leaves(model, folder), names, owner, len(features), keep), schema)


def importance(attributed: DataFrame, features: tuple[Feature, ...]) -> DataFrame:
    """(feature, n, mean_abs, mean) of contributions, over all rows; one partial sum a partition is shuffled."""
    c = [F.col("contributions")[k] for k in range(len(features))]
    one = attributed.agg(
        F.count("*").alias("n"), F.array(*[F.avg(F.abs(v)) for v in c]).alias("size"), F.array(*[F.avg(v) for v in c]).alias("mean"),
    )
    rows = F.explode(F.arrays_zip(F.array(*[F.lit(f.name) for f in features]).alias("feature"), "size", "mean")).alias("r")
    return one.select("n", rows).select("r.feature", "n", F.col("r.size").alias("mean_abs"), F.col("r.mean").alias("mean"))
