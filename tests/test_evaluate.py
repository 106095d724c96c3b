import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import evaluate as ev
from chronofold.operators import explore as ex


def brute(ys, ps):
    ys, ps = np.array(ys), np.array(ps)
    pos, neg = ps[ys == 1], ps[ys == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) if len(pos) and len(neg) else None
    ap, last = 0.0, 0.0
    for t in sorted(set(ps), reverse=True):
        hit = ps >= t
        recall, precision = ys[hit].sum() / max(1, ys.sum()), ys[hit].mean()
        ap, last = ap + (recall - last) * precision, recall
    return auc, ap if ys.sum() else 0.0, -np.mean(ys * np.log(ps) + (1 - ys) * np.log(1 - ps)), np.mean((ps - ys) ** 2)


@pytest.mark.parametrize("seed", range(3))
def test_metrics_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(k, int(r.random() < 0.3), r.choice([0.1, 0.25, 0.5, 0.9, r.uniform(0.01, 0.99)])) for k in "aab" for _ in range(60)]
    rows += [("one", 1, 0.5), ("none", 0, 0.5)]
    got = {x["k"]: x for x in ev.metrics(spark.createDataFrame(rows, "k string, y int, p double"), ["k"]).collect()}
    for k in ("a", "b", "one", "none"):
        auc, ap, loss, brier = brute([y for q, y, _ in rows if q == k], [p for q, _, p in rows if q == k])
        x = got[k]
        assert (x["roc_auc"] is None) == (auc is None)
        assert auc is None or x["roc_auc"] == pytest.approx(auc)
        assert (x["average_precision"], x["log_loss"], x["brier"]) == pytest.approx((ap, loss, brier))


def test_bins(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.05, 0.1, 0.2, 0.95, 1.0)], "p double")
    got = df.select(ev.bin_left(F.col("p")), ev.bin_right(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 0), (1, 0), (2, 1), (9, 9), (9, 9)]


def test_buckets_on_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 2.0)], "x double")
    got = df.select(ev.bucket_right(F.col("x"), [0.0, 1.0, 2.0]), ev.bucket_left(F.col("x"), [0.0, 1.0, 2.0])).collect()
    assert [tuple(r) for r in got] == [(1, 1), (1, 2), (2, 2), (2, 2)]
    assert ev.quantile_edges(spark.createDataFrame([(1.0,)] * 5, "x double"), "x", 4) == [1.0]


def test_curves_end_points(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)]
    got = {r["threshold"]: r for r in ev.curves(spark.createDataFrame(rows, "y int, p double")).collect()}
    assert (got[0.1]["tpr"], got[0.1]["fpr"]) == (1.0, 1.0)
    assert (got[0.9]["tpr"], got[0.9]["precision"]) == (0.5, 0.5)


def test_drift_and_ranking(spark):
    rows = [(k, 1, k, 5.0 if k >= 7 else 1.0, k) for k in range(10)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, item_id long, rating double, event_us long")
    d = ex.early_late(e).first()
    assert (d["n_early"], d["n_late"], d["delta"]) == (3, 3, 1.0)
    g = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "name string, gain double")
    assert [r["name"] for r in ex.ranked(g, "gain", "name").orderBy("rank").collect()] == ["c", "a", "b"]
    assert ex.temporal_audit(e.withColumn("ts", F.expr("timestamp_ntz '2020-01-01' + make_interval(0,0,0,0,0,0,event_us)")).limit(0)).first()["row_count"] == 0


def test_quantiles_against_numpy(spark, monkeypatch):
    import numpy as np

    from chronofold.operators import explore

    monkeypatch.setattr(explore, "CUTS", 16)
    rng = np.random.RandomState(3)
    columns = {
        "spread": rng.randn(997), "few": rng.randint(0, 3, 997).astype(float), "one": np.full(997, 2.5), "tail": np.exp(3 * rng.randn(997)),
        "zeros": np.where(rng.rand(997) < 0.9, 0.0, rng.randn(997)),
    }
    rows = [[None if (k + j) % 10 == 0 else float(v[k]) for j, v in enumerate(columns.values())] + [None, k % 3 == 0] for k in range(997)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in columns) + ", nothing double, hit boolean").repartition(5)
    names = [*columns, "nothing"]
    found = {r["feature"]: r for r in explore.feature_summary(df, names).collect()}
    for j, n in enumerate(columns):
        x = np.array([r[j] for r in rows if r[j] is not None])
        assert (found[n]["n"], found[n]["distinct"]) == (len(x), len(np.unique(x)))
        want = [*np.quantile(x, (0.01, 0.05, 0.25, 0.5, 0.75, 0.95)), x.min(), x.max(), x.mean(), x.std(ddof=1)]
        got = [found[n][c] for c in ("p01", "p05", "p25", "p50", "p75", "p95", "min", "max", "mean", "std")]
        assert np.allclose(got, want, rtol=1e-12, atol=1e-12), n
    assert (found["nothing"]["n"], found["nothing"]["distinct"], found["nothing"]["p50"], found["nothing"]["missing_pct"]) == (0, 0, None, 100)
    for r in explore.by_target(df, names, "hit").collect():
        x = [row[names.index(r["feature"])] for row in rows if row[-1] == r["hit"]]
        x = [v for v in x if v is not None]
        assert r["n"] == len(x)
        assert r["median"] is None if not x else abs(r["median"] - np.median(x)) < 1e-12
    empty = explore.feature_summary(df.limit(0), names).collect()
    assert {(r["feature"], r["n"], r["p50"], r["distinct"]) for r in empty} == {(n, 0, None, 0) for n in names}


@pytest.mark.parametrize("rows", [1, 7, 50])
def test_hot_users_are_numbered_by_bucket(spark, rows):
    """One user with most events, many of them at one time, so that buckets are of any size."""
    r = random.Random(rows)
    data = [(k, 1 if r.random() < 0.7 else r.randint(2, 5), r.randint(1, 9), r.randint(1, 10) / 2, r.choice([3, 3, 3, r.randint(0, 200)])) for k in range(500)]
    e = spark.createDataFrame(data, "event_id long, user_id long, item_id long, rating double, event_us long").repartition(3)
    take = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = []
    for user in {x[1] for x in data}:
        mine = sorted((x for x in data if x[1] == user), key=lambda x: (x[4], x[2], x[0]))
        for k, x in enumerate(mine):
            some = [y[3] >= 4 for y in mine[max(0, k - rows + 1) : k + 1]]
            want.append((user, x[0], round(sum(some) / len(some), 12) if len(some) >= max(10, rows // 5) else None))
    for hot in (None, 12, 1):
        got = [(u, i, v if v is None else round(v, 12)) for u, i, v in take(ex.rolling_rate(e, rows, hot))]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert take(ex.early_late(e, hot=hot)) == take(ex.early_late(e))


def test_quantile_edges_are_exact(spark):
    r = random.Random(1)
    x = [round(r.random(), 3) for _ in range(3_000)]
    got = ev.quantile_edges(spark.createDataFrame([(v,) for v in x], "x double"), "x", 20)
    assert got == pytest.approx(sorted(set(np.quantile(x, [k / 20 for k in range(21)]).tolist())), abs=1e-12)
    assert ev.quantile_edges(spark.createDataFrame([], "x double"), "x", 4) == []


def test_rolling_rate_reads_events_once_and_copies_none(spark):
    """What is read several times is stored first; tails of buckets are a row a bucket, not events joined to the others."""
    e = spark.createDataFrame([(k % 3, 1, k, 4.0, k) for k in range(200)], "user_id long, item_id long, event_id long, rating double, event_us long")
    plan = ex.rolling_rate(e, 50, 30)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Union" not in plan and "ExistingRDD" not in plan and "LocalTableScan" not in plan
