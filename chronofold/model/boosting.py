"""Gradient-boosted trees whose splits learn a side for missing values.

Features are cut into bins once. A level of a tree is one pass: each task adds up gradients, Hessians and rows by node, feature
and bin, which Spark sums; of two children only the one with fewer rows is counted, the other is what its parent has
beside it. The driver gets these sums, at most nodes x features x bins, and chooses for each node the split, and the side of
missing values, that gain most. Rows stay where they are: what they have of the trees so far is recomputed in the pass, from a stored
sum every ``REFRESH`` trees. Trees end when the held-out loss hasn't fallen for ``patience`` of them, and those after the best are dropped.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.predicates import allow_columns
from ..schemas import Feature
from ..session import reach_workers
from ..sources.publish import stored
from .train import TARGETS

#: Trees after which the rows' sums are stored anew.
REFRESH = 16
_EPSILON = 1e-15


@dataclass(frozen=True)
class Params:
    # Those of the model that this one stands in for.
    trees: int = 600
    depth: int = 6
    rate: float = 0.05
    subsample: float = 0.8
    columns: float = 0.9
    weight: float = 20.0
    alpha: float = 0.1
    lam: float = 2.0
    bins: int = 128
    patience: int = 30
    seed: int = 42


@dataclass
class Tree:
    """Node k goes left where its feature's value is below ``cut`` (its bin at most ``bin``), or is missing and ``null_left``; a leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    bin: list[int] = field(default_factory=lambda: [0])
    null_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def grow(self) -> int:
        for name, v in (("feature", -1), ("cut", 0.0), ("bin", 0), ("null_left", True), ("value", 0.0), ("gain", 0.0)):
            getattr(self, name).append(v)
        self.left.append(len(self.left))
        self.right.append(len(self.right))
        return len(self.left) - 1

    def ends(self, columns, raw: bool = False) -> np.ndarray:
        """The node that each row ends in, of ``columns`` of codes of bins, or of ``raw`` values with NaN: each column is compared whole, once a node."""
        kind = np.min_scalar_type(len(self.left))

        def below(k: int):
            if (f := self.feature[k]) < 0:
                return kind.type(k)
            x, null = columns[f], self.null_left[k]
            if raw:
                low = ~(x >= self.cut[k]) if null else x < self.cut[k]
            else:
                low = x <= self.bin[k] + 1 if null else (x <= self.bin[k] + 1) & (x > 0)
            return np.where(low, below(self.left[k]), below(self.right[k]))

        return np.broadcast_to(below(0), len(columns[0]))

    def leaves(self, x: np.ndarray, missing: np.ndarray, binned: bool) -> np.ndarray:
        """The node that each row of ``x`` ends in."""
        feature, at, null = np.array(self.feature), np.array(self.bin if binned else self.cut), np.array(self.null_left)
        left, right = np.array(self.left), np.array(self.right)
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            f = feature[node]
            if not (f >= 0).any():
                return node
            v = x[rows, np.maximum(f, 0)]
            low = (v <= at[node]) if binned else (v < at[node])
            node = np.where(np.where(missing[rows, np.maximum(f, 0)], null[node], low), left[node], right[node])


@dataclass
class Boosted:
    names: list[str]
    base: float
    trees: list[Tree]
    losses: list[float]  # held-out loss before the first tree and after each

    def document(self) -> dict:
        return asdict(self)

    @staticmethod
    def of(document: dict) -> Boosted:
        return Boosted(**(document | {"trees": [Tree(**t) for t in document["trees"]]}))

    def gains(self) -> dict[str, float]:
        out = dict.fromkeys(self.names, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    out[self.names[f]] += g
        return out


def _values(df: DataFrame, features: tuple[Feature, ...]) -> dict[str, Column]:
    """The features in double precision, by the names that ``_columns`` reads."""
    allow_columns(df, [f.name for f in features], TARGETS)
    one = lambda f: F.col(f.name).cast("int").cast("double") if f.kind == "boolean" else F.col(f.name).cast("double")
    return {f"__x{k}": F.nanvl(one(f), F.lit(None).cast("double")) for k, f in enumerate(features)}


def _columns(batch, count: int) -> list[np.ndarray]:
    """The features of a batch, NaN where they are missing."""
    return [batch.column(f"__x{k}").to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for k in range(count)]


def _binned(cuts: list[np.ndarray], kind: np.dtype):
    """Rows whose bins are one value, so that a pass reads bytes and no lists: a feature's code is its bin plus 1, or 0 where it is missing."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                codes = np.empty((b.num_rows, len(cuts)), dtype=kind)
                for k, (c, x) in enumerate(zip(cuts, _columns(b, len(cuts)), strict=True)):
                    codes[:, k] = np.where(np.isnan(x), 0, np.searchsorted(c, x, side="right") + 1)
                ends = np.arange(0, codes.nbytes + 1, codes.nbytes // len(codes), dtype=np.int32)
                flat = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([flat, b.column("y"), b.column("held"), b.column("margin")], names=["bins", "y", "held", "margin"])

    return run


_ROWS = "bins binary, y int, held boolean, margin double"


def _codes(batch, kind: np.dtype) -> np.ndarray:
    """The codes of a batch, rows by features, as they lie in it."""
    column = batch.column("bins")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def _margins(start: np.ndarray, columns, trees: list[Tree], raw: bool = False) -> np.ndarray:
    margin = start.copy()
    for t in trees:
        margin += np.array(t.value)[t.ends(columns, raw)]
    return margin


def _refreshed(trees: list[Tree], kind: np.dtype):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                margin = _margins(b.column("margin").to_numpy(), np.ascontiguousarray(_codes(b, kind).T), trees)
                yield pa.RecordBatch.from_arrays([b.column("bins"), b.column("y"), b.column("held"), pa.array(margin)], names=["bins", "y", "held", "margin"])

    return run


def _histograms(trees: list[Tree], tree: Tree, wanted: list[int], width: int, share: float, seed: int, kind: np.dtype):
    """(node, feature, bin, g, h, n) of ``wanted`` nodes, bin -1 for missing values; if 0 is one of them, node -1 has the held-out loss and rows.

    The trees so far are applied to the rows that are counted and no others.
    """

    def run(batches):
        import pyarrow as pa

        sums, loss, held_n = None, 0.0, 0
        place = np.full(len(tree.left), -1)
        place[wanted] = np.arange(len(wanted))
        for b in batches:
            if not b.num_rows:
                continue
            codes, start, y = _codes(b, kind), b.column("margin").to_numpy(), b.column("y").to_numpy().astype(np.float64)
            held = b.column("held").to_numpy(zero_copy_only=False).astype(bool)
            f = codes.shape[1]
            if sums is None:
                sums = np.zeros((3, len(wanted), f, width + 1))
            if place[0] >= 0 and held.any():
                out = np.flatnonzero(held)
                q = np.clip(1 / (1 + np.exp(-_margins(start[out], np.ascontiguousarray(codes[out].T), trees))), _EPSILON, 1 - _EPSILON)
                loss -= float((y[out] * np.log(q) + (1 - y[out]) * np.log(1 - q)).sum())
                held_n += len(out)
            at = place[tree.ends(codes.T)]
            use = np.flatnonzero(~held & (at >= 0))
            codes = codes[use]
            if share < 1:  # a row's own hash, so that a task that runs again takes the same rows
                bins = codes.astype(np.float64) - 1  # sums of small whole numbers are exact
                plain, by_place = (bins.sum(axis=1).astype(np.int64).astype(np.uint64), (bins @ np.arange(1.0, f + 1)).astype(np.int64).astype(np.uint64))
                mark = by_place * np.uint64(0x9E3779B97F4A7C15) + plain * np.uint64(2 * seed + 1)
                mark ^= mark >> np.uint64(31)
                some = (mark * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)).astype(np.float64) / 2.0**53 < share
                use, codes = use[some], codes[some]
            columns = np.ascontiguousarray(codes.T)
            p = 1 / (1 + np.exp(-_margins(start[use], columns, trees)))
            g, h, first = p - y[use], p * (1 - p), at[use] * (width + 1)
            for k, codes_k in enumerate(columns):
                cell = first + codes_k
                for s, w in zip(sums, (g, h, None), strict=True):
                    s[:, k] += np.bincount(cell, weights=w, minlength=len(wanted) * (width + 1)).reshape(len(wanted), width + 1)
        if sums is not None:
            node, feature, code = np.nonzero(sums[2])
            cols, found = [np.array(wanted)[node], feature, code - 1], [s[node, feature, code] for s in sums]
            if place[0] >= 0:
                cols, found = [np.append(c, -1) for c in cols], [np.append(s, v) for s, v in zip(found, (loss, 0.0, held_n), strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in cols], *[pa.array(s) for s in found]], names=["node", "feature", "bin", "g", "h", "n"])

    return run


def _score(g, h, p: Params):
    t = np.sign(g) * np.maximum(np.abs(g) - p.alpha, 0)
    return t * t / (h + p.lam)


def best_split(hist: np.ndarray, allowed: np.ndarray, p: Params) -> tuple[float, int, int, bool] | None:
    """(gain, feature, bin, null_left) of a node's sums, features x (missing, bins) x (g, h, n); None if nothing gains."""
    total = hist[0].sum(axis=0)
    below, null = np.cumsum(hist[:, 1:], axis=1)[:, :-1], hist[:, :1]
    best = None
    for null_left in (True, False):
        left = below + null if null_left else below
        right = total - left
        ok = allowed[:, None] & (left[..., 1] >= p.weight) & (right[..., 1] >= p.weight) & (left[..., 2] > 0) & (right[..., 2] > 0)
        gain = np.where(ok, _score(left[..., 0], left[..., 1], p) + _score(right[..., 0], right[..., 1], p) - _score(total[0], total[1], p), -np.inf)
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, b] > 1e-9 and (best is None or gain[f, b] > best[0] + 1e-12):
            best = (float(gain[f, b]), int(f), int(b), null_left)
    return best


def fit(df: DataFrame, features: tuple[Feature, ...], held: str | None = None, params: Params | None = None, **more) -> Boosted:
    """``df`` has the features and ``y``, 0 or 1; ``held`` names a boolean column of rows that are held out and stop the trees."""
    p = replace(params or Params(), **more)
    reach_workers(df.sparkSession)
    values = _values(df, features)
    x = df.select(*[c.alias(k) for k, c in values.items()], F.col("y").cast("int").alias("y"), (F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)).alias("held")).where("y IS NOT NULL")
    train = x.where("NOT held")
    points = F.array(*[F.lit(k / p.bins) for k in range(1, p.bins)])
    found = train.agg(F.avg("y").alias("mean"), *[F.percentile_approx(f"__x{k}", points, F.lit(20 * p.bins)).alias(f"c{k}") for k in range(len(features))]).first()
    names = [f.name for f in features]
    if found["mean"] is None:
        return Boosted(names, 0.0, [], [])
    mean = min(max(found["mean"], 1e-6), 1 - 1e-6)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.array(found[f"c{k}"] or [], dtype=np.float64)) for k in range(len(features))]
    width = max(map(len, cuts)) + 1
    kind = np.min_scalar_type(width)
    rows = stored(x.withColumn("margin", F.lit(base)).mapInArrow(_binned(cuts, kind), _ROWS), "binned")
    rng, model, done = np.random.RandomState(p.seed), Boosted(names, base, [], []), 0

    def sums(tree: Tree, wanted: list[int], number: int) -> dict[int, np.ndarray]:
        got = rows.mapInArrow(_histograms(model.trees[done:], tree, wanted, width, p.subsample, p.seed + number, kind), "node int, feature int, bin int, g double, h double, n double")
        out = {k: np.zeros((len(features), width + 1, 3)) for k in wanted}
        for r in got.groupBy("node", "feature", "bin").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect():
            if r[0] >= 0:
                out[r[0]][r[1], r[2] + 1] = r[3:]
            elif 0 in wanted and held:
                model.losses.append(r[3] / r[5] if r[5] else float("inf"))
        return out

    for number in range(p.trees):
        if number - done == REFRESH:
            rows = stored(rows.mapInArrow(_refreshed(model.trees[done:], kind), _ROWS), "margins")
            done = number
        tree, open_ = Tree(), {}
        open_ = sums(tree, [0], number)
        if held and len(model.losses) - 1 - int(np.argmin(model.losses)) >= p.patience:
            break
        allowed = np.zeros(len(features), dtype=bool)
        allowed[rng.permutation(len(features))[: max(1, round(p.columns * len(features)))]] = True
        for level in range(p.depth + 1):
            pairs = []
            for k, hist in open_.items():
                total = hist[0].sum(axis=0)
                tree.value[k] = float(-p.rate * np.sign(total[0]) * max(abs(total[0]) - p.alpha, 0) / (total[1] + p.lam))
                split = best_split(hist, allowed, p) if level < p.depth else None
                if split:
                    tree.gain[k], f, b, tree.null_left[k] = split
                    tree.feature[k], tree.bin[k], tree.cut[k] = f, b, float(cuts[f][b]) if b < len(cuts[f]) else float("inf")
                    tree.left[k], tree.right[k] = tree.grow(), tree.grow()
                    n = hist[f, 1 : b + 2, 2].sum() + (hist[f, 0, 2] if tree.null_left[k] else 0)
                    pairs.append((k, *((tree.left[k], tree.right[k]) if 2 * n <= total[2] else (tree.right[k], tree.left[k]))))
            if not pairs:
                break
            counted = sums(tree, [small for _, small, _ in pairs], number) if level + 1 <= p.depth else {}
            open_ = {k: v for parent, small, large in pairs for k, v in ((small, counted[small]), (large, open_[parent] - counted[small]))}
        if tree.feature[0] < 0:
            break
        model.trees.append(tree)
    if held and model.losses:
        if len(model.losses) == len(model.trees):  # that after the last tree is still to be counted
            sums(Tree(), [0], p.trees)
        model.trees = model.trees[: int(np.argmin(model.losses))]
    return model


def score(model: Boosted, df: DataFrame, features: tuple[Feature, ...], keep: list[str]) -> DataFrame:
    """``keep`` and p, the probability of the target."""
    reach_workers(df.sparkSession)
    if [f.name for f in features] != model.names:
        raise ValueError("the model has other features")
    rows = df.select(*keep, *[c.alias(k) for k, c in _values(df, features).items()])
    base, trees = model.base, model.trees

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                margin = _margins(np.full(b.num_rows, base), _columns(b, len(features)), trees, raw=True)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(1 / (1 + np.exp(-margin)))], names=[*keep, "p"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "p double"]))
