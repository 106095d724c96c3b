"""Boosted trees with missing values against exhaustive search in plain Python."""

import json
import math
import random

import numpy as np
import pytest

from chronofold.model import boosting
from chronofold.schemas import Feature

FEATURES = tuple(Feature(n, "double", True, "x", 17) for n in ("a", "b", "c"))
KIND = "a double, b double, c double, y int, held boolean"
PLAIN = {"subsample": 1.0, "columns": 1.0, "weight": 3.0, "bins": 400}


def rows(seed, n=500):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = None if r.random() < 0.3 else r.randint(0, 40) / 4
        b = None if r.random() < 0.1 else round(r.gauss(0, 1), 1)
        c = float("nan") if r.random() < 0.05 else float(r.randint(0, 3))
        z = (1.5 if a is None else a / 4 - 1) + (0 if b is None else b)
        out.append((a, b, c, int(r.random() < 1 / (1 + math.exp(-z))), r.random() < 0.3))
    return out


def gone(v):
    return v is None or math.isnan(v)


def plain_split(data, margins, p):
    """(gain, feature, left rows) of the best split over all cuts and both sides for missing values."""
    q = [1 / (1 + math.exp(-m)) for m in margins]
    g, h = [x - r[3] for x, r in zip(q, data, strict=True)], [x * (1 - x) for x in q]

    def part(idx):
        G, H = sum(g[i] for i in idx), sum(h[i] for i in idx)
        t = math.copysign(max(abs(G) - p.alpha, 0), G)
        return t * t / (H + p.lam), H

    best = (0, None, None)
    whole = part(range(len(data)))[0]
    for f in range(3):
        for cut in sorted({r[f] for r in data if not gone(r[f])}):
            for null_left in (True, False):
                left = [i for i, r in enumerate(data) if (null_left if gone(r[f]) else r[f] < cut)]
                right = sorted(set(range(len(data))) - set(left))
                if left and right:
                    (a, ha), (b, hb) = part(left), part(right)
                    if min(ha, hb) >= p.weight and a + b - whole > best[0] + 1e-9:
                        best = (a + b - whole, f, set(left))
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_splits_are_the_best_of_all(spark, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, KIND).repartition(3)
    model = boosting.fit(df, FEATURES, None, trees=1, depth=2, rate=1.0, **PLAIN)
    p = boosting.replace(boosting.Params(), **PLAIN)
    tree = model.trees[0]
    x = np.array([[math.nan if gone(v) else v for v in r[:3]] for r in data])
    ends = tree.leaves(x, np.isnan(x), False)
    below = {0: list(range(len(data)))}
    for k in range(len(tree.feature)):
        if tree.feature[k] >= 0:
            some = below[k]
            gain, f, left = plain_split([data[i] for i in some], [model.base] * len(some), p)
            assert tree.gain[k] == pytest.approx(gain, rel=1e-6)
            one = np.array([[math.nan if gone(v) else v for v in data[i][:3]] for i in some])
            v = one[:, tree.feature[k]]
            mine = {i for i, ok in enumerate(np.where(np.isnan(v), tree.null_left[k], v < tree.cut[k])) if ok}
            assert f == tree.feature[k] and mine == left
            below[tree.left[k]], below[tree.right[k]] = ([some[i] for i in range(len(some)) if (i in mine) == side] for side in (True, False))
        else:
            G = sum(1 / (1 + math.exp(-model.base)) - data[i][3] for i in below[k])
            H = len(below[k]) / (1 + math.exp(-model.base)) * (1 - 1 / (1 + math.exp(-model.base)))
            assert tree.value[k] == pytest.approx(-math.copysign(max(abs(G) - p.alpha, 0), G) / (H + p.lam), rel=1e-6)
            assert set(np.flatnonzero(ends == k)) == set(below[k])
    assert any(tree.feature[k] == 0 for k in range(len(tree.feature)))


def test_scores_and_early_stop(spark):
    data = rows(3)
    df = spark.createDataFrame(data, KIND).repartition(3)
    boosting.REFRESH, held = 2, boosting.REFRESH
    try:
        model = boosting.fit(df, FEATURES, "held", trees=30, depth=3, rate=0.5, patience=2, **PLAIN)
    finally:
        boosting.REFRESH = held
    assert 0 < len(model.trees) < 30 and int(np.argmin(model.losses)) == len(model.trees)
    again = boosting.Boosted.of(json.loads(json.dumps(model.document())))
    got = boosting.score(again, df.selectExpr("*", "a AS p2"), FEATURES, ["y", "held", "p2"]).collect()
    loss = [-math.log(r["p"] if r["y"] else 1 - r["p"]) for r in got if r["held"]]
    assert sum(loss) / len(loss) == pytest.approx(min(model.losses), rel=1e-9)
    assert min(model.losses) < model.losses[0] - 0.05
    assert model.gains()["a"] > model.gains()["c"]
    sampled = boosting.fit(df, FEATURES, "held", trees=3, depth=2, rate=0.5, weight=3.0, bins=16)
    assert min(sampled.losses) < sampled.losses[0]
    with pytest.raises(ValueError):
        boosting.score(model, df, FEATURES[:2], [])


def test_no_rows_one_class_and_targets(spark):
    df = spark.createDataFrame([(1.0, None, 2.0, 1, False)] * 5, KIND)
    assert boosting.fit(df.limit(0), FEATURES).trees == []
    one = boosting.fit(df, FEATURES, trees=2, **PLAIN)
    assert one.trees == [] and boosting.score(one, df, FEATURES, ["y"]).first()["p"] > 0.99
    with pytest.raises(ValueError):
        boosting.fit(df.withColumn("rating", df.a), (Feature("rating", "double", True, "x", 17),))


def test_loss_is_no_worse_than_with_flags(spark):
    """On rows of their own, against as many trees of the same depth that see -1 and a flag. (The labels of the test tables follow
    from no feature, so both learners find next to nothing there.)"""
    from chronofold.model import train
    from chronofold.operators.evaluate import metrics

    df = spark.createDataFrame(rows(5, 3_000), KIND).repartition(3)
    test = spark.createDataFrame(rows(6, 2_000), KIND)
    new = boosting.fit(df, FEATURES, "held", trees=10, depth=3, rate=0.3, patience=3, **PLAIN | {"bins": 128})
    old = train.fit(df, FEATURES, "gbt", trees=10, depth=3, stop="held")
    of = lambda scored: metrics(scored).first()["log_loss"]
    assert of(boosting.score(new, test, FEATURES, ["y"])) <= of(train.score(old, test, FEATURES, ["y"]))


def test_a_pass_applies_trees_to_the_rows_it_counts():
    """Against plain sums, and with how many rows the trees so far are applied to: half of them are in other nodes."""
    import pyarrow as pa

    class Counted(boosting.Tree):
        rows = 0

        def ends(self, columns, raw=False):
            Counted.rows += len(columns[0])
            return super().ends(columns, raw)

    r = np.random.RandomState(1)
    x = np.where(r.rand(400, 2) < 0.1, np.nan, r.randint(0, 8, (400, 2)))
    y, held = r.randint(0, 2, 400).astype(np.int32), r.rand(400) < 0.25
    cuts = [np.arange(1.0, 8.0)] * 2
    old = Counted([0, -1, -1], [3.0, 0.0, 0.0], [2, 0, 0], [True] * 3, [1, 1, 2], [2, 1, 2], [0.0, 0.5, -0.25], [0.0] * 3)
    tree = boosting.Tree([1, -1, -1], [4.0, 0.0, 0.0], [3, 0, 0], [False, True, True], [1, 1, 2], [2, 1, 2], [0.0] * 3, [0.0] * 3)
    raw = pa.RecordBatch.from_pydict({"__x0": pa.array(x[:, 0], from_pandas=True), "__x1": pa.array(x[:, 1], from_pandas=True), "y": y, "held": held, "margin": np.full(400, 0.1)})
    kind = np.min_scalar_type(8)
    (binned,) = boosting._binned(cuts, kind)(iter([raw]))
    assert binned.column("bins")[0].as_py() == bytes(0 if np.isnan(v) else int(v) + 1 for v in x[0])
    found = {}
    for b in boosting._histograms([old], tree, [1], 8, 1.0, 0, kind)(iter([binned.slice(0, 150), binned.slice(150)])):
        found |= {tuple(v[:3]): v[3:] for v in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    here = ~held & (x[:, 1] < 4)
    assert Counted.rows == here.sum()
    assert (tree.ends(list(x.T), True) == tree.leaves(x, np.isnan(x), False)).all() and (old.ends(list(x.T), True) == old.leaves(x, np.isnan(x), False)).all()
    p = 1 / (1 + np.exp(-(0.1 + np.where(np.isnan(x[:, 0]) | (x[:, 0] < 3), 0.5, -0.25))))
    for k in range(2):
        for code in range(-1, 8):
            rows = here & (np.isnan(x[:, k]) if code < 0 else x[:, k] == code)
            if rows.any():
                assert found.pop((1, k, code)) == pytest.approx([(p - y)[rows].sum(), (p * (1 - p))[rows].sum(), rows.sum()])
    assert not found


@pytest.mark.parametrize("kind", ["gbt", "logistic"])
def test_learners_read_small_pieces_and_shuffle_no_rows(spark, tmp_path, kind):
    """Rows were shuffled by all of their columns so that a task of a learner had few of them: 600 rows a shuffle, and three or one of these."""
    from chronofold.model import train
    from chronofold.operators import buckets

    spark.createDataFrame(rows(5, 600), KIND).coalesce(1).write.option("maxRecordsPerFile", 50).parquet(f"{tmp_path}/t")
    table, before, seen = spark.read.parquet(f"{tmp_path}/t"), buckets.TASK, []
    tracker = spark.sparkContext.statusTracker()
    try:
        buckets.TASK = 50
        spark.sparkContext.setJobGroup(f"learn-{kind}", "")
        train.fit(table, FEATURES, kind, trees=1, depth=2, stop="held" if kind == "gbt" else None)
        for job in tracker.getJobIdsForGroup(f"learn-{kind}"):
            seen += [s.numTasks for k in tracker.getJobInfo(job).stageIds if (s := tracker.getStageInfo(k))]
    finally:
        buckets.TASK = before
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(seen) == 12
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    x, names = train.matrix(table, FEATURES)
    plan = x.select(*names)
    with buckets.small_reads(spark, 12 * buckets.TASK):
        assert plan.rdd.getNumPartitions() == 12 and "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_metrics_read_scores_that_are_made_once(spark, sf):
    """Each of the three readings of the scores read all features and applied the trees in Python."""
    import __spark_entry__

    out = __spark_entry__.queries()["boosted_trees_missing"](spark, sf)
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["split"] for r in out.collect()} == {"train", "validation", "test"}
