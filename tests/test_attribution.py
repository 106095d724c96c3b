from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.model import attribution, manifest, train
from chronofold.schemas import Feature


def _expected(found, x, known):
    """The model's log-odds where only the columns ``known`` of a row are."""
    out = 0.0
    for value, path in found:
        for c, above, upto, share in path:
            value *= float(above < x[c] <= upto) if c in known else share
        out += value
    return out


def test_shapley_against_all_subsets():
    found = [
        (0.7, [(0, -np.inf, 1.0, 0.25), (2, 0.5, np.inf, 0.4)]), (-0.3, [(0, 1.0, 2.0, 0.5), (1, -np.inf, 0.0, 0.3), (2, 0.1, 0.9, 0.6)]),
        (1.1, [(3, 0.0, np.inf, 0.8)]), (0.2, []),
    ]
    x = np.array([[0.5, -1.0, 0.7, 1.0], [1.5, -1.0, 0.2, -1.0], [1.0, 3.0, 0.5, 0.0]])
    got = attribution.shapley(found, x)
    for r, row in enumerate(x):
        for c in range(4):
            rest = [k for k in range(4) if k != c]
            want = sum(
                factorial(m) * factorial(3 - m) / 24 * (_expected(found, row, {*s, c}) - _expected(found, row, set(s)))
                for m in range(4) for s in combinations(rest, m)
            )
            assert abs(got[r, c] - want) < 1e-12
        assert abs(attribution.base(found) + got[r].sum() - _expected(found, row, set(range(4)))) < 1e-12


@pytest.fixture(scope="module")
def fitted(spark):
    features = (Feature("a", "double", False, "x", 17), Feature("b", "double", True, "x", 17), Feature("c", "boolean", False, "x", 17))
    df = spark.range(2000).select(
        "id", (F.col("id") % 13).cast("double").alias("a"), F.when(F.col("id") % 5 != 0, (F.col("id") % 7).cast("double")).alias("b"), (F.col("id") % 2 == 0).alias("c"),
    )
    df = df.withColumn("y", (F.col("a") * 2 + F.coalesce("b", F.lit(9.0)) + F.col("c").cast("int") > 14).cast("int"))
    return features, df, train.fit(df, features, "gbt", trees=6, depth=4)


def test_contributions_add_up_to_log_odds(spark, fitted, tmp_path):
    features, df, model = fitted
    found = attribution.contributions(model, df, features, ["id"], f"file://{tmp_path}/t")
    p = train.score(model, df, features, ["id"])
    sums = found.select("id", (F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda s, v: s + v)).alias("odds"))
    far = sums.join(p, "id").select(F.count("*"), F.max(F.abs(F.col("odds") - F.ln(F.col("p") / (1 - F.col("p")))))).first()
    assert far[0] == 2000
    assert far[1] < 1e-6
    rows = {r["feature"]: r for r in attribution.importance(found, features).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert all(r["n"] == 2000 and abs(r["mean"]) <= r["mean_abs"] for r in rows.values())
    assert rows["a"]["mean_abs"] > rows["c"]["mean_abs"]
    assert attribution.contributions(model, df.limit(0), features, ["id"], f"file://{tmp_path}/u").collect() == []


def test_inputs_may_not_show_the_target(spark):
    df = spark.createDataFrame([(1.0, 4.0, 1)], "a double, rating double, y int")
    for name in ("rating", "y", "absent"):
        with pytest.raises(ValueError, match=name):
            train.matrix(df, (Feature(name, "double", False, "x", 17),))


def test_commands_fit_score_and_explain(spark, sf, tmp_path, capsys):
    from chronofold.__main__ import main

    path, out = f"file://{tmp_path}/m", f"file://{tmp_path}/scores"
    main(["fit", sf, path])
    m = manifest.read(spark, f"{path}.json")
    assert m["promoted"]
    assert m["name"] == "m"
    assert m["status"] == "promoted"
    assert m["learner"]["trees"] >= 1
    assert sum(m["rows"].values()) == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    manifest.validate(spark, m, sf)
    with pytest.raises(ValueError, match="other events"):
        manifest.validate(spark, m | {"source": "0" * 64}, sf)
    with pytest.raises(ValueError, match="splits"):
        manifest.validate(spark, m | {"splits": []}, sf)
    with pytest.raises(FileExistsError):
        manifest.publish_model(spark, sf, path)
    main(["score", sf, path, out])
    scores = spark.read.parquet(out)
    assert scores.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert scores.where("p IS NULL OR p < 0 OR p > 1").isEmpty()
    capsys.readouterr()
    main(["explain", sf, path])
    assert "mean_abs" in capsys.readouterr().out


def test_the_labelled_table_is_made_once(spark, sf):
    """Fitting and scoring read it many times, so it is a stored table without joins or windows."""
    t = train.labelled(spark, sf, 17)
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert "Window" not in plan
    assert t.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert {r["y"] for r in t.select("y").distinct().collect()} == {0, 1}
