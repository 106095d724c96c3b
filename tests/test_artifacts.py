import pytest
from pyspark.sql import functions as F

from chronofold.model import manifest
from chronofold.operators import artifacts
from chronofold.operators.explore import histogram
from chronofold.plans.materialize import materialize
from chronofold.schemas import contract

GOOD = {"roc_auc": 0.8, "average_precision": 0.7, "log_loss": 0.5, "brier": 0.2}
HEX = "a" * 64


def test_manifest(spark, tmp_path):
    m = manifest.build("m", 17, HEX, HEX, [("train", None, "2000-01-01"), ("test", "2000-01-01", None)], {"test": GOOD})
    assert m["promoted"]
    path = f"file://{tmp_path}/m.json"
    manifest.write(spark, m, path)
    manifest.write(spark, m, path)
    assert manifest.read(spark, path) == m
    with pytest.raises(FileExistsError):
        manifest.write(spark, m | {"name": "other"}, path)
    manifest.write(spark, m | {"name": "other"}, path, force=True)
    assert not manifest.build("m", 17, HEX, HEX, [], {"test": GOOD}, {"test": GOOD | {"brier": 0.1}})["promoted"]
    assert manifest.build("m", 17, HEX, HEX, [], {"test": GOOD}, {"test": GOOD | {"brier": 0.20005}})["promoted"]


@pytest.mark.parametrize("change", [{"version": 2}, {"features": []}, {"source": "x"}, {"metrics": {"test": GOOD | {"brier": float("nan")}}}, {"metrics": {"test": {}}}, {"status": "candidate"}, {"target": {}}, {"rows": {"other": 1}}, {"extra": 1}])
def test_manifest_checks(change):
    m = manifest.build("m", 17, HEX, HEX, [], {"test": GOOD})
    with pytest.raises(ValueError):
        manifest.dumps(m | change)


def test_artifact_audit(spark, tmp_path):
    events = spark.createDataFrame([(k, k % 3 + 1, k % 2 + 1, 4.0, 100 - k) for k in range(1, 20)], "event_id long, user_id long, item_id long, rating double, event_us long")
    catalog = spark.createDataFrame([(1, 1999, ["a"])], "item_id long, release_year int, genres array<string>")
    path = f"file://{tmp_path}/f"
    materialize(events, catalog, None, path, 17)
    table = spark.read.parquet(path)
    assert tuple(artifacts.artifact_audit(table, contract(17)).first()) == (19, 19, 81, 99, "", 1, 19, 0, 0, True)
    assert all(r["falls"] == 0 for r in artifacts.unsorted_files(table).collect())
    assert tuple(artifacts.table_difference(table, table.where("event_id > 2").unionByName(table.where("event_id = 3"))).first()) == (2, 1)
    null = table.selectExpr("* EXCEPT (user_mean)", "CAST(NULL AS FLOAT) AS user_mean")
    assert artifacts.artifact_audit(null, contract(17)).first()["broken"] == "user_mean"


def test_histogram_clips(spark):
    df = spark.createDataFrame([(x,) for x in (-5.0, 0.0, 1.0, 9.9, 10.0, 50.0, None)], "x double")
    assert {r["bin"]: r["n"] for r in histogram(df, "x", 0.0, 10.0, 10).collect()} == {1: 2, 2: 1, 10: 3}


def test_command_line(capsys, spark, sf):
    from chronofold.__main__ import main

    main(["audit", sf])
    assert "row_count" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["nothing"])


def test_an_artifact_is_held_against_its_events(spark, tmp_path):
    from chronofold.operators.artifacts import check_artifact
    from chronofold.plans.materialize import materialize
    from chronofold.sources.publish import identity

    e = spark.createDataFrame([(k, k % 3 + 1, k % 4 + 1, 0.5 * (k % 10 + 1), k * 1000) for k in range(1, 40)], "event_id long, user_id long, item_id long, rating double, event_us long")
    c = spark.createDataFrame([(i, 1990, ["a"]) for i in range(1, 5)], "item_id long, release_year int, genres array<string>")
    path = f"file://{tmp_path}/t"
    source = materialize(e, c, None, path, 17)["source"]
    table = spark.read.parquet(path)
    check_artifact(table, e, 17, source)
    assert source == identity(e)
    with pytest.raises(ValueError, match="ids"):
        check_artifact(table.where("event_id > 3"), e, 17)
    with pytest.raises(ValueError, match="other events"):
        check_artifact(table, e.withColumn("rating", F.lit(1.0)), 17, source)
    with pytest.raises(ValueError, match="contract"):
        check_artifact(table.drop("user_mean"), e, 17)


def test_canonical_items_are_checked(spark):
    from chronofold.operators.validate import check_items, item_faults

    good = [(1, "a", 1990, "listed"), (2, "b", None, "missing_in_source")]
    kind = "item_id long, title string, release_year int, genre_status string"
    check_items(spark.createDataFrame(good, kind))
    bad = [(3, None, 0, "odd"), (4, "x", 10_000, "listed"), (None, "x", 1, "listed"), (1, "again", 1, "listed")]
    got = sorted(map(tuple, item_faults(spark.createDataFrame(good + bad, kind)).collect()), key=repr)
    assert got == sorted([(3, "title"), (3, "year"), (3, "status"), (4, "year"), (None, "id"), (1, "repeated")], key=repr)
    with pytest.raises(ValueError, match="missing columns"):
        check_items(spark.createDataFrame(good, kind).drop("title"))


def test_allowed_columns(spark):
    from chronofold.operators.predicates import allow_columns

    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, y int")
    assert allow_columns(df, ["b", "a"], {"y"}).columns == ["b", "a"]
    with pytest.raises(ValueError, match="leaks"):
        allow_columns(df, ["a", "y"], {"y"})
    with pytest.raises(ValueError, match="missing"):
        allow_columns(df, ["a", "z"], {"y"})


def test_ids_as_bitmaps(spark):
    a = spark.createDataFrame([(k,) for k in (1, 2, 2, 32_768, 32_769, 70_000, None)], "event_id long")
    b = spark.createDataFrame([(k,) for k in (2, 3, 32_769, 32_769, 32_769, 10**12)], "event_id long")
    assert tuple(artifacts.id_difference(a, b).first()) == (3, 2, 1, 2)
    assert tuple(artifacts.id_difference(a, a.limit(0)).first()) == (5, 0, 1, 0)
    assert tuple(artifacts.id_difference(a.limit(0), a.limit(0)).first()) == (0, 0, 0, 0)
    audit = lambda ids: artifacts.artifact_audit(spark.createDataFrame([(i, 5) for i in ids], "event_id long, event_us long"), ()).first()[5:]
    assert audit([3, 1, 2]) == (1, 3, 0, 0, True)
    assert audit([1, 2, 2]) == (1, 2, 1, 0, False) and audit([2, 3]) == (2, 3, 0, 0, False) and audit([1, None]) == (1, 1, 0, 1, False)
    assert audit([]) == (None, None, 0, 0, True)


def test_files_of_partitioned_tables(spark, tmp_path):
    """Files of two folders share a name; each is sorted. Files that fall, or that overlap in a folder, are found."""
    rows = spark.range(1000).selectExpr("id AS event_us", "id AS event_id", "id % 2 AS part")
    path = f"file://{tmp_path}/p"
    rows.coalesce(1).write.partitionBy("part").parquet(path)
    table = spark.read.parquet(path)
    assert [r["falls"] for r in artifacts.unsorted_files(table).collect()] == [0, 0]
    assert artifacts.overlapping_files(table).isEmpty()
    for some in ("event_us < 600", "event_us >= 400"):
        rows.where(some).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/o")
    assert artifacts.overlapping_files(spark.read.parquet(f"file://{tmp_path}/o")).count() == 1
    rows.orderBy("event_us").repartition(1).sortWithinPartitions((F.col("event_us") % 10)).write.parquet(f"file://{tmp_path}/f")
    assert artifacts.unsorted_files(spark.read.parquet(f"file://{tmp_path}/f")).first()["falls"] == 9
