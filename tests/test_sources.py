import json

import pytest
from pyspark.sql import functions as F

from chronofold.operators import entities as e
from chronofold.operators import validate as val
from chronofold.plans.materialize import materialize
from chronofold.schemas import DATASETS
from chronofold.sources import publish as pub
from chronofold.sources.scan import read_csv, row_identity

RATINGS = "userId,movieId,rating,timestamp\n"


def csv(tmp_path, text):
    f = tmp_path / "x.csv"
    f.write_text(text)
    return str(f)


def test_typed_csv(spark, tmp_path):
    df = read_csv(spark, csv(tmp_path, "timestamp,rating,movieId,userId\n2020-01-01 00:00:00,4.5,7,1\n"), DATASETS["ratings"])
    assert df.dtypes == [("userId", "bigint"), ("movieId", "bigint"), ("rating", "float"), ("timestamp", "timestamp_ntz")]
    assert df.count() == 1
    tags = read_csv(spark, csv(tmp_path, "userId,movieId,tag,timestamp\n1,2,NA,2020-01-01 00:00:00\n1,2,,2020-01-01 00:00:00\n"), DATASETS["tags"])
    assert sorted(r["tag"] for r in tags.collect()) == ["", "NA"]
    links = read_csv(spark, csv(tmp_path, "movieId,imdbId,tmdbId\n1,2,\n2,3,4\n"), DATASETS["links"])
    assert [r["tmdbId"] for r in links.orderBy("movieId").collect()] == [None, 4]


@pytest.mark.parametrize("name, text", [
    ("ratings", RATINGS + "-1,1,4.0,2020-01-01 00:00:00\n"), ("ratings", RATINGS + "4294967297,1,4.0,2020-01-01 00:00:00\n"),
    ("ratings", RATINGS + "1,1,4.2,2020-01-01 00:00:00\n"), ("ratings", RATINGS + "1,1,5.00000001,2020-01-01 00:00:00\n"),
    ("ratings", RATINGS + "1,1,0.499999999,2020-01-01 00:00:00\n"), ("ratings", RATINGS + "1,1,4.0,yesterday\n"),
    ("ratings", "userId,movieId,rating\n1,1,4.0\n"), ("ratings", "userId,movieId,rating,timestamp,extra\n1,1,4.0,2020-01-01 00:00:00,1\n"),
    ("genome_scores", "movieId,tagId,relevance\n1,1,1.00000001\n"), ("genome_scores", "movieId,tagId,relevance\n1,1,0.5\n1,1,0.6\n"),
    ("genome_scores", "movieId,tagId,relevance\n1,1,NaN\n"),
])
def test_csv_rejections(spark, tmp_path, name, text):
    with pytest.raises(ValueError):
        read_csv(spark, csv(tmp_path, text), DATASETS[name])


def test_zoned_timestamps_are_rejected(spark):
    df = spark.sql("SELECT timestamp '2020-01-01' AS t")
    with pytest.raises(TypeError, match="naive"):
        val.check_types(df, {"t": "timestamp_ntz"})


def test_row_identity(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = row_identity(spark.read.parquet(str(tmp_path / "one")), "k").where("id % 7 = 3")
    assert all(r["k"] == r["id"] + 1 for r in one.collect())
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "three"))
    many = row_identity(spark.read.parquet(str(tmp_path / "three")), "k")
    assert many.select("k").distinct().count() == 100


def test_row_identity_of_a_partitioned_table(spark, tmp_path):
    rows = spark.range(60).selectExpr("id", "concat('a b/', id % 3) AS p").coalesce(1)
    rows.write.partitionBy("p").parquet(str(tmp_path / "parts"))
    df = spark.read.parquet(str(tmp_path / "parts"))
    assert len({f.rsplit("/", 1)[1] for f in df.inputFiles()}) < len(df.inputFiles())
    got = row_identity(df, "k")
    assert got.columns == ["id", "p", "k"]
    assert got.count() == 60
    assert got.select("k").distinct().count() == 60
    assert sorted(r["k"] & (1 << 40) - 1 for r in got.collect()) == sorted(list(range(1, 21)) * 3)


def test_csv_quotes(spark, tmp_path):
    text = 'userId,movieId,tag,timestamp\n1,2,"say ""hi"", now",2020-01-01 00:00:00\n1,2,"two\nlines",2020-01-01 00:00:00\n1,2,back\\slash,2020-01-01 00:00:00\n'
    got = read_csv(spark, csv(tmp_path, text), DATASETS["tags"])
    assert sorted(r["tag"] for r in got.collect()) == ["back\\slash", 'say "hi", now', "two\nlines"]
    one = read_csv(spark, csv(tmp_path, 'userId,movieId,tag,timestamp\n1,2,"a, ""b""",2020-01-01 00:00:00\n'), DATASETS["tags"], multiline=False)
    assert one.first()["tag"] == 'a, "b"'


@pytest.mark.parametrize("value", ["abc", "1.5x", "-"])
def test_malformed_nullable_numbers_are_rejected(spark, tmp_path, value):
    with pytest.raises(ValueError, match="tmdbId"):
        read_csv(spark, csv(tmp_path, f"movieId,imdbId,tmdbId\n1,2,\n2,3,{value}\n"), DATASETS["links"])


def test_convert_keeps_the_old_table_on_failure(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    assert pub.convert(spark, spark.range(3), path)["rows"] == 3
    rename = pub.Files.rename

    def broken(self, a, b):
        if a.endswith(".new"):
            raise OSError("no room")
        rename(self, a, b)

    monkeypatch.setattr(pub.Files, "rename", broken)
    with pytest.raises(OSError):
        pub.convert(spark, spark.range(5), path)
    assert spark.read.parquet(path).count() == 3
    monkeypatch.undo()
    assert pub.convert(spark, spark.range(5), path)["rows"] == 5
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_files_digest_follows_content(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * (20 << 20))
    first = pub.files_digest(spark, f"file://{tmp_path}")
    (tmp_path / "a").write_bytes(b"x" * (20 << 20) + b"y")
    assert pub.files_digest(spark, f"file://{tmp_path}") != first


def test_identity(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 0.5), (2, "y", 0.5)], "a long, b string, c double")
    want = pub.identity(a)
    assert pub.identity(a.orderBy(F.desc("a")).repartition(3).select("c", "a", "b")) == want
    assert pub.identity(a.distinct()) != want
    assert pub.identity(a.fillna("", ["b"]).fillna(0.0, ["c"])) != want
    assert pub.identity(a.limit(0)) != want


def test_publish_pair_rolls_back(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    pub.publish_pair(spark.range(3), path, {"v": 1})

    def refuse(df):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        pub.publish_pair(spark.range(5), path, {"v": 2}, refuse)
    assert spark.read.parquet(path).count() == 3
    assert json.loads((tmp_path / "t.json").read_text()) == {"v": 1}
    pub.publish_pair(spark.range(5), path, {"v": 2})
    assert spark.read.parquet(path).count() == 5
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["t", "t.json"]


def test_publish_pair_restores_when_the_last_rename_fails(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    pub.publish_pair(spark.range(3), path, {"v": 1})
    real = pub.Files.rename

    def fail(self, a, b):
        if b.endswith("t.json") and ".new" in a:
            raise OSError("full")
        real(self, a, b)

    monkeypatch.setattr(pub.Files, "rename", fail)
    with pytest.raises(OSError):
        pub.publish_pair(spark.range(5), path, {"v": 2})
    assert spark.read.parquet(path).count() == 3
    assert json.loads((tmp_path / "t.json").read_text()) == {"v": 1}


def test_convert(spark, tmp_path):
    got = pub.convert_all(spark, {"a": spark.range(4), "b": spark.range(2)}, f"file://{tmp_path}")
    assert [(r["dataset"], r["rows"]) for r in got.collect()] == [("a", 4), ("b", 2)]
    assert all(r["ratio"] is None for r in got.collect())
    spark.range(5).write.csv(f"file://{tmp_path}/c.csv")
    r = pub.convert_all(spark, {"c": spark.read.csv(f"file://{tmp_path}/c.csv")}, f"file://{tmp_path}").first()
    assert (r["source_bytes"], r["ratio"]) == (10, 10 / r["bytes"])
    assert pub.files_digest(spark, f"file://{tmp_path}/a.parquet") == pub.files_digest(spark, f"file://{tmp_path}/a.parquet")


def test_materialize(spark, tmp_path):
    events = spark.createDataFrame([(k, k % 3 + 1, k % 2 + 1, 4.0, k) for k in range(1, 20)], "event_id long, user_id long, item_id long, rating double, event_us long")
    catalog = spark.createDataFrame([(1, 1999, ["a"]), (2, None, [])], "item_id long, release_year int, genres array<string>")
    path = f"file://{tmp_path}/features"
    meta = materialize(events, catalog, None, path, 17)
    assert spark.read.parquet(path).count() == 19
    assert json.loads((tmp_path / "features.json").read_text())["source"] == meta["source"]
    twice = events.unionByName(events)
    with pytest.raises(ValueError):
        materialize(twice, catalog, None, path, 17)
    assert spark.read.parquet(path).count() == 19


def test_entities(spark):
    raw = spark.createDataFrame([(1, "A (1999) ", "x|y"), (2, "B (0000)", "(no genres listed)"), (3, "C (0001)", "x"), (4, "D 1999", "y"), (5, "E (9999)", "x")], "item_id long, title string, genres string")
    links = spark.createDataFrame([(1, 5, None)], "item_id long, imdb_id long, tmdb_id long")
    got = {r["item_id"]: r for r in e.items(raw, links).collect()}
    assert [got[k]["release_year"] for k in range(1, 6)] == [1999, None, 1, None, 9999]
    assert got[2]["genre_status"] == "missing_in_source"
    assert got[3]["imdb_id"] is None
    for bad in ("x||y", "x| y", "x|(no genres listed)", ""):
        with pytest.raises(ValueError):
            e.items(raw.limit(1).withColumn("genres", F.lit(bad)), links)
    with pytest.raises(ValueError, match="repeated"):
        e.items(raw.unionByName(raw), links)
    u = e.users(spark.sql("SELECT 1L AS user_id, 5 AS ts"), spark.sql("SELECT 1L AS user_id, 3 AS ts UNION ALL SELECT 2L, 4"))
    assert sorted(map(tuple, u.collect())) == [(1, 3, 5), (2, 4, None)]


def test_rating_event_checks(spark):
    ok = spark.sql("SELECT 1L AS event_id, 1L AS user_id, 1L AS item_id, 4.0D AS rating, timestamp_ntz '2020-01-01' AS ts")
    ids = spark.sql("SELECT 1L AS user_id, 1L AS item_id")
    assert e.rating_events(ok, ids, ids).first()["high"] is True
    for change in ({"rating": F.lit(4.2)}, {"rating": F.lit(5.5)}, {"event_id": F.lit(0)}, {"user_id": F.lit(2)}, {"item_id": F.lit(2)}):
        with pytest.raises(ValueError):
            e.rating_events(ok.withColumns(change), ids, ids)
    with pytest.raises(ValueError):
        e.rating_events(ok.unionByName(ok), ids, ids)


def counted(spark, rows):
    """``rows`` of (event_id, user_id, item_id, rating, ts), and how often one of them has been made so far."""
    import pyarrow as pa  # noqa: F401

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    kind = "event_id long, user_id long, item_id long, rating double, ts string"
    return spark.createDataFrame(rows, kind).coalesce(1).mapInArrow(count, kind), made


def test_events_are_made_once_for_all_their_checks(spark):
    from chronofold.operators.entities import rating_events

    df, made = counted(spark, [(k, 1, 2, 4.0, "2000-01-01") for k in range(1, 11)])
    out = rating_events(df, spark.createDataFrame([(1,)], "user_id long"), spark.createDataFrame([(2,)], "item_id long"))
    assert out.where("high").count() == 10
    assert made.value == 10


def test_rows_are_compared_as_bags_in_one_pass(spark):
    from chronofold.operators.validate import same_rows

    row = lambda k, x=4.0: (k, 1, None, x, "a")
    a, made = counted(spark, [row(1), row(1), row(2)])
    plain = lambda rows: spark.createDataFrame(rows, a.schema)
    assert same_rows(a, plain([row(2), row(1), row(1)]))
    assert made.value == 3
    for other in ([row(1), row(2), row(2)], [row(1), row(2)], [row(1), row(1), row(2), row(2)], [row(1), row(1), row(2, None)], []):
        assert not same_rows(a, plain(other)) and not same_rows(plain(other), a)


def test_digest_sums_shuffle_few_rows_a_task(spark):
    """A task hands on some hundred rows a bucket, not one for each row of its own."""
    from chronofold.sources.publish import digest_sums

    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s := stages.apply(k)).stageId(): s.shuffleWriteRecords() for k in range(stages.size())}

    before = shuffled()
    assert digest_sums(spark.range(0, 20_000, 1, 2).toDF("event_id")).first()["n"] == 20_000
    assert max(n for k, n in shuffled().items() if k not in before) <= 600
