import json
import random

import pytest
from pyspark.sql import functions as F

from chronofold.functions.scalars import DAY_US
from chronofold.plans.features import blocks
from chronofold.schemas import contract
from chronofold.state import checkpoints as cp
from chronofold.state import tables as st
from chronofold.streaming.replay import LateData, StreamReplay

EVENTS = "event_id long, user_id long, item_id long, rating double, event_us long"
NAMES = ["event_id", *[f.name for f in contract(17)], "item_count_60d", "item_mean_30d", "item_mean_60d"]


def data(seed, n=36):
    r = random.Random(seed)
    return [(k, r.randint(1, 3), r.randint(1, 5), r.randint(1, 10) / 2, r.choice([0, 1, 2, 30, 31, 59, 60, 61, 90]) * DAY_US + r.choice([-1, 0, 0, 1])) for k in range(1, n + 1)]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([(1, 1999, ["a"]), (2, None, ["a", "b"]), (3, 2001, []), (4, 1980, ["b", "c"]), (5, 1970, ["c"])], "item_id long, release_year int, genres array<string>").cache()


def take(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


@pytest.mark.parametrize("seed", [11, 29])
def test_incremental_equals_full(spark, catalog, seed):
    rows = data(seed)
    e = spark.createDataFrame(rows, EVENTS).cache()
    full = {r[0]: r for r in take(blocks(e, catalog))}
    times = sorted({r[4] for r in rows})
    cuts = [times[0] - 1, times[0], times[0] + 1, times[len(times) // 2], times[len(times) // 2] + 1, times[-1], times[-1] + 1]
    for cut in cuts if seed == 11 else cuts[3:5]:
        got = take(st.suffix_features(st.build(e, cp.bridge_of(catalog), cut), e, catalog))
        want = sorted(full[r[0]] for r in rows if r[4] >= cut)
        assert got == want, cut


def test_advance_in_steps_equals_build(spark, catalog):
    e = spark.createDataFrame(data(47), EVENTS)
    b = cp.bridge_of(catalog)
    step = st.advance(st.advance(st.build(e, b, 0), e, b, 31 * DAY_US), e, b, 91 * DAY_US)
    once = st.build(e, b, 91 * DAY_US)
    assert (step.count, step.total) == (once.count, once.total)
    for n in st.NAMES:
        a, c = getattr(step, n), getattr(once, n)
        assert sorted(map(tuple, a.select(*c.columns).collect())) == sorted(map(tuple, c.collect()))
    assert st.conservation(step).first()["ok"]
    with pytest.raises(ValueError):
        st.advance(step, e, b, 0)


def test_document_round_trip(spark, catalog):
    e, b = spark.createDataFrame(data(5), EVENTS), cp.bridge_of(catalog)
    state = st.build(e, b, 60 * DAY_US)
    doc = json.loads(json.dumps(st.to_document(state), sort_keys=True))
    back = st.from_document(spark, doc)
    assert st.to_document(back) == doc
    assert st.to_document(st.build(e.orderBy("rating").repartition(3), b, 60 * DAY_US)) == doc
    assert take(st.suffix_features(back, e, catalog)) == take(st.suffix_features(state, e, catalog))
    empty = st.to_document(st.build(e, b, -(10**15)))
    assert st.from_document(spark, empty).count == 0
    first = doc["user"][0]
    for wrong in (
        doc | {"more": 1}, {k: v for k, v in doc.items() if k != "item"}, doc | {"count": True}, doc | {"total": str(doc["total"])}, doc | {"count": doc["count"] + 1},
        doc | {"user": [first | {"n": float(first["n"])}, *doc["user"][1:]]}, doc | {"user": doc["user"][1:]},
    ):
        with pytest.raises(ValueError, match="."):
            st.from_document(spark, wrong)
    with pytest.raises(ValueError, match="more than 2 rows"):
        st.to_document(state, 2)


def test_checkpoint_round_trip_and_guards(spark, catalog, tmp_path):
    rows = data(83)
    e = spark.createDataFrame(rows, EVENTS)
    cut, path = 31 * DAY_US, f"file://{tmp_path}/c"
    cp.checkpoint(e, catalog, cut, path)
    state = cp.resume(e.orderBy(F.desc("event_id")), catalog, path)
    assert take(cp.replay(state, e, catalog)[0]) == [r for r in take(blocks(e, catalog)) if r[0] in {x[0] for x in rows if x[4] >= cut}]
    later = spark.createDataFrame([*rows, (99, 1, 1, 5.0, 200 * DAY_US)], EVENTS)
    cp.resume(later, catalog, path)
    first = min(rows, key=lambda x: x[4])
    for bad in ([r for r in rows if r != first], [(*r[:3], 0.5 if r == first else r[3], r[4]) for r in rows if r != first or first[3] != 0.5]):
        with pytest.raises(ValueError):
            cp.resume(spark.createDataFrame(bad, EVENTS), catalog, path)
    with pytest.raises(ValueError):
        cp.resume(e, catalog.where("item_id < 5"), path)
    with pytest.raises(Exception):  # noqa: B017  it exists
        cp.checkpoint(e, catalog, cut, path)
    cp.checkpoint(e, catalog, cut, f"{path}-strict", strict=True)
    with pytest.raises(ValueError, match="whole"):
        cp.resume(later, catalog, f"{path}-strict")


@pytest.mark.parametrize("change", [{"version": 2}, {"source": "x"}, {"count": -1}, {"count": True}, {"cutoff_us": 1.5}, {"extra": 1}, {"keep_us": 0}, {"catalog": None}, {"count": 1}])
def test_sidecar_checks(spark, catalog, tmp_path, change):
    path = tmp_path / "c"
    cp.checkpoint(spark.createDataFrame(data(5, 10), EVENTS), catalog, 60 * DAY_US, f"file://{path}")
    side = json.loads((path / "checkpoint.json").read_text())
    (path / ".checkpoint.json.crc").unlink()
    (path / "checkpoint.json").write_text(json.dumps(side | change))
    with pytest.raises(ValueError):
        cp.load(spark, f"file://{path}")


def test_history_checks(spark):
    e = spark.createDataFrame([(1, 1, 1, 1.0, 1), (1, 1, 1, 1.0, 2)], EVENTS)
    with pytest.raises(ValueError, match="repeat"):
        cp.check_history(e)
    with pytest.raises(ValueError, match="missing"):
        cp.check_history(spark.createDataFrame([(1, 1, 1, 1.0, None)], EVENTS))


def test_timestamp_batches(spark):
    e = spark.createDataFrame([(3, 1, 1, 1.0, 5), (1, 1, 1, 1.0, 5), (2, 1, 1, 1.0, 400 * DAY_US)], EVENTS)
    assert sorted(map(tuple, cp.timestamp_batches(e).collect())) == [(0, 5, 2, 1), (1, 400 * DAY_US, 1, 2)]


def test_stream_equals_batch(spark, catalog, tmp_path):
    rows = sorted(data(101), key=lambda x: (x[4], x[0]))
    source = tmp_path / "in"
    import os
    import time

    for k in range(4):  # parts split timestamps
        part = spark.createDataFrame(rows[9 * k : 9 * k + 9], EVENTS).coalesce(1)
        part.write.mode("append").parquet(str(source))
        for f in source.glob("*.parquet"):
            if f.stat().st_mtime > time.time() - 3600:
                os.utime(f, (time.time() - 7200 + 60 * k,) * 2)
    s = StreamReplay(spark, f"file://{tmp_path}/out", catalog)
    s.run(f"file://{source}")
    assert take(s.features()) == take(blocks(spark.createDataFrame(rows, EVENTS), catalog))


def test_stream_late_rows_and_repeats(spark, catalog, tmp_path):
    s = StreamReplay(spark, f"file://{tmp_path}/out", catalog)
    s.process(spark.createDataFrame([(1, 1, 1, 1.0, 10), (2, 1, 1, 1.0, 20)], EVENTS), 0)
    s.process(spark.createDataFrame([(9, 1, 1, 1.0, 5)], EVENTS), 0)  # committed already
    with pytest.raises(LateData):
        s.process(spark.createDataFrame([(3, 1, 1, 1.0, 19)], EVENTS), 1)
    with pytest.raises(ValueError, match="repeat"):
        s.process(spark.createDataFrame([(2, 1, 1, 1.0, 21)], EVENTS), 1)
    s.process(spark.createDataFrame([(3, 1, 1, 2.0, 20)], EVENTS), 1)
    s.flush()
    s.flush()
    assert {r["event_id"]: r["user_count"] for r in s.features().collect()} == {1: 0, 2: 1, 3: 1}


def test_states_without_windows_or_with_unknown_times_make_no_checkpoint(spark, tmp_path):
    e = spark.createDataFrame([(1, 1, 1, 4.0, 10), (2, 1, 2, 3.0, 20), (3, 2, 1, 5.0, 30)], "event_id long, user_id long, item_id long, rating double, event_us long")
    c = spark.createDataFrame([(1, 1990, ["a"]), (2, 1991, ["a", "b"])], "item_id long, release_year int, genres array<string>")
    b = cp.bridge_of(c)
    coarse = st.build(e, b, 25, windows=False)
    assert {r["event_us"] for r in coarse.item.collect()} == {st.OLD}
    later = st.advance(coarse, e, b, 40)
    assert not later.windows and later.count == 3
    with pytest.raises(ValueError, match="windows"):
        st.suffix_features(coarse, e, c)
    more = st.add_untimed(st.build(e, b, 25), spark.createDataFrame([(1, 2, 1.0)], "user_id long, item_id long, rating double"), b)
    assert not more.trusted and st.conservation(more).first()["ok"]
    third = st.suffix_features(more, e, c).collect()[0]
    assert (third["global_count"], third["item_count"], third["item_count_60d"]) == (3, 1, 1)
    for k, state in enumerate((coarse, later, more, st.advance(more, e, b, 40))):
        with pytest.raises(ValueError, match="checkpoint"):
            cp.save(state, f"file://{tmp_path}/{k}", "0" * 64, "0" * 64)


def test_stream_commits_gains_and_compacts(spark, tmp_path, monkeypatch):
    from chronofold.streaming import replay

    monkeypatch.setattr(replay, "COMPACT", 2)
    r = random.Random(8)
    kind = "event_id long, user_id long, item_id long, rating double, event_us long"
    rows = [(k, r.randint(1, 3), r.randint(1, 3), r.randint(1, 10) / 2, (k // 2) * 20 * 86_400_000_000) for k in range(1, 25)]
    c = spark.createDataFrame([(i, 1990, ["a", "b"][: i % 3]) for i in range(1, 4)], "item_id long, release_year int, genres array<string>")
    stream = replay.StreamReplay(spark, f"file://{tmp_path}/s", c)
    for k in range(4):
        stream.process(spark.createDataFrame(rows[6 * k : 6 * k + 6], kind), k)
    stream.flush()
    names = ["event_id", "global_count", "user_count", "item_count_30d", "item_count_60d", "user_genre_count", "item_mean"]
    want = sorted(map(tuple, blocks(spark.createDataFrame(rows, kind), c).select(*names).collect()))
    assert sorted(map(tuple, stream.features().select(*names).collect())) == want
    wholes = [json.loads(stream.files.read(f"{stream.root}/commits/{v}/commit.json"))["whole"] for v in stream.versions()]
    assert wholes == [0, 0, 2, 2, 4]


def test_a_changed_event_is_named_by_its_stretch_and_checkpoints_extend(spark, catalog, tmp_path):
    rows = data(11, 60)
    e = spark.createDataFrame(rows, EVENTS)
    first, second, once = (f"file://{tmp_path}/{n}" for n in ("first", "second", "once"))
    cp.checkpoint(e, catalog, 31 * DAY_US, first)
    cp.extend(e, catalog, first, 61 * DAY_US, second)
    cp.checkpoint(e, catalog, 61 * DAY_US, once)
    a, b = (cp.load(spark, p)[1] for p in (second, once))
    assert a == b
    digests = [sorted(map(tuple, cp.digests_of(spark, p).collect())) for p in (second, once)]
    assert digests[0] == digests[1] and len(digests[0]) >= 3
    names = [*NAMES]
    got = cp.replay(cp.resume(e, catalog, second), e, catalog)[0]
    assert take(got.select(*names)) == [r for r in take(blocks(e, catalog)) if r[0] in {x[0] for x in rows if x[4] >= 61 * DAY_US}]
    changed = next(r for r in rows if 30 * DAY_US < r[4] < 60 * DAY_US)
    other = e.withColumn("rating", F.when(F.col("event_id") == changed[0], 5.5 - F.col("rating")).otherwise(F.col("rating")))
    with pytest.raises(ValueError, match=f"from {changed[4] // cp.BUCKET_US * cp.BUCKET_US}"):
        cp.resume(other, catalog, second)
    cp.resume(e.where(F.col("event_us") < 61 * DAY_US), catalog, second)  # later events may change
    for bad in (lambda: cp.extend(e, catalog, second, DAY_US, f"{first}-x"), lambda: cp.extend(e, catalog.where("item_id > 1"), first, 61 * DAY_US, f"{first}-y")):
        with pytest.raises(ValueError):
            bad()


def test_features_of_a_suffix_shuffle_events_by_item_and_by_user_alone(spark, catalog):
    """Rows of genres stay in the task of their user, as do events on their way back to one row."""
    e = spark.createDataFrame(data(7), EVENTS)
    made = st.build(e, cp.bridge_of(catalog), 31 * DAY_US)
    user, item, group = (spark.createDataFrame(getattr(made, n).collect(), getattr(made, n).schema) for n in st.NAMES)  # as read from a checkpoint
    found = st.suffix_features(st.State(made.cutoff_us, made.count, made.total, user, item, group), e, catalog)
    plan = found._jdf.queryExecution().executedPlan().toString()
    for key in ("genre", "event_id"):
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(user_id" in x and f"{key}#" in x], key


def test_a_stream_shuffles_no_state_to_sum_up_gains(spark, catalog, tmp_path):
    """What a load gives is the rows of the commits as they are."""
    s = StreamReplay(spark, f"file://{tmp_path}/out", catalog)
    rows = sorted(data(3), key=lambda r: r[4])
    for k, part in enumerate((rows[:12], rows[12:24], rows[24:])):
        s.process(spark.createDataFrame([r for r in part if not k or r[4] > rows[12 * k - 1][4]], EVENTS), k)
    state, _, batch = s._load()
    assert batch == 2 and state.count == sum(r["n"] for r in state.user.collect())
    for n in st.NAMES:
        assert "Exchange" not in getattr(state, n)._jdf.queryExecution().executedPlan().toString()
