import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.functions.scalars import DAY_US, check_window_us
from chronofold.operators import buckets
from chronofold.operators import history as h
from chronofold.operators import predicates as p
from chronofold.operators import vectors as v
from chronofold.plans.features import blocks, feature_table
from chronofold.schemas import check_contract, contract

S = 1_000_000
EVENTS = "event_id long, user_id long, item_id long, rating double, event_us long"
CATALOG = "item_id long, release_year int, genres array<string>"


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("event_id").collect()]


def catalog(spark, genres=None, items=range(1, 20)):
    genres = genres or {}
    return spark.createDataFrame([(i, None, genres.get(i, [])) for i in items], CATALOG)


def test_expanding_table(spark):
    e = spark.createDataFrame([(1, 1, 1, 1.0, S), (2, 1, 1, 3.0, 2 * S), (3, 1, 2, 5.0, 3 * S), (4, 2, 1, 5.0, 4 * S)], EVENTS)
    b = blocks(e, catalog(spark))
    assert rows(b, "global_count", "global_mean") == [(0, 3.5), (1, 1.0), (2, 2.0), (3, 3.0)]
    assert rows(b, "user_count", "user_mean", "user_std") == [(0, 3.5, 0.0), (1, 1.0, 0.0), (2, 2.0, 1.0), (0, 3.0, 0.0)]
    assert rows(b, "item_count", "item_mean", "item_std") == [(0, 3.5, 0.0), (1, 1.0, 0.0), (0, 2.0, 0.0), (2, 2.0, 1.0)]
    assert rows(b, "user_recency_s") == [(None,), (1.0,), (1.0,), (None,)]


def test_ties_never_see_each_other(spark):
    e = spark.createDataFrame([(1, 1, 1, 1.0, S), (2, 1, 1, 3.0, 2 * S), (3, 1, 1, 5.0, 2 * S)], EVENTS)
    b = blocks(e, catalog(spark))
    assert rows(b, "global_count", "user_count", "item_count", "item_count_30d") == [(0, 0, 0, 0), (1, 1, 1, 1), (1, 1, 1, 1)]


def test_window_edges(spark):
    d = 30 * DAY_US
    e = spark.createDataFrame([(1, 1, 1, 1.0, 0), (2, 2, 1, 3.0, d), (3, 3, 1, 5.0, d + S), (4, 4, 1, 5.0, 3 * d)], EVENTS)
    x = h.window_ratios(h.item_history(e))
    # the event at t - 30 days counts, one second later it doesn't
    assert rows(x, "item_count_30d", "item_count_60d") == [(0, 0), (1, 1), (1, 2), (0, 2)]
    assert rows(x, "item_mean_30d", "item_mean_ratio", "item_count_ratio")[3] == (None, None, 0.0)
    assert rows(x, "item_mean_60d")[3] == (4.0,)
    assert rows(x, "item_count_ratio")[0] == (None,)


def test_association_weighting(spark):
    g = {1: ["Drama"], 2: ["Drama"], 3: ["Romance"], 4: ["Drama", "Romance", "Western"]}
    e = spark.createDataFrame([(1, 1, 1, 1.0, 1), (2, 1, 2, 3.0, 2), (3, 1, 3, 5.0, 3), (4, 1, 5, 1.0, 4), (5, 1, 4, 2.0, 5)], EVENTS)
    got = rows(blocks(e, catalog(spark, g)), "user_genre_count", "user_genre_mean", "user_genre_delta")[4]
    assert got == (3, 3.0, 0.5)
    assert rows(blocks(e, catalog(spark, g)), "user_genre_count", "user_genre_delta")[3] == (0, 0.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_against_brute_force(spark, seed):
    r = random.Random(seed)
    genres = {i: r.sample("abcd", r.randint(0, 3)) for i in range(1, 8)}
    data = [(k, r.randint(1, 4), r.randint(1, 7), r.randint(1, 10) / 2, r.randint(0, 40) * 3 * DAY_US) for k in range(1, 81)]
    b = blocks(spark.createDataFrame(data, EVENTS), catalog(spark, genres))
    names = ["global_count", "user_count", "user_mean", "item_count_30d", "item_mean_60d", "user_genre_count", "user_genre_mean", "user_std"]
    for (_, u, i, _, t), got in zip(sorted(data), rows(b, *names), strict=True):
        past = [x for x in data if x[4] < t]
        mine = [x[3] for x in past if x[1] == u]
        of = [x for x in past if x[2] == i]
        assoc = [x[3] for x in past if x[1] == u for g in genres[x[2]] if g in genres[i]]
        g_mean = sum(x[3] for x in past) / len(past) if past else 3.5
        mean = sum(mine) / len(mine) if mine else g_mean
        m60 = [x[3] for x in of if x[4] >= t - 60 * DAY_US]
        want = (len(past), len(mine), mean, sum(x[4] >= t - 30 * DAY_US for x in of), sum(m60) / len(m60) if m60 else None, len(assoc), sum(assoc) / len(assoc) if assoc else mean)
        assert got[:7] == pytest.approx(want, abs=1e-9)
        assert got[7] == pytest.approx(np.std(mine) if len(mine) > 1 else 0.0, abs=1e-9)


def test_salted_history_equals_plain(spark):
    r = random.Random(5)
    data = [(k, 1, r.choice([1, 1, 1, 2]), r.randint(1, 10) / 2, r.randint(0, 400) * DAY_US) for k in range(200)]
    e = spark.createDataFrame(data, EVENTS)
    w = h.prior("item_id")
    plain = e.select("event_id", F.count("*").over(w).alias("n"), (F.sum("rating").over(w) / F.count("*").over(w)).alias("s"))
    assert h.hot_keys(e, "item_id") is None
    hot = h.hot_keys(e, "item_id", 60)
    assert [r["item_id"] for r in hot.collect()] == [1]
    assert rows(plain, "n", "s") == rows(h.item_history(e, {}, hot), "item_count", "item_mean")


@pytest.mark.parametrize("span", [400, 30 * 400, 3])
def test_hot_keys_give_the_same_features(spark, span):
    """A third of all events on one item, and half on one user; spans of many buckets a window, and of one timestamp a bucket."""
    r = random.Random(span)
    g = {i: r.sample(["a", "b", "c"], r.randint(0, 3)) for i in range(1, 20)}
    data = [(k, 1 if r.random() < 0.5 else r.randint(2, 9), 1 if r.random() < 0.35 else r.randint(2, 19), r.randint(1, 10) / 2, r.randint(0, span) * DAY_US // 24) for k in range(600)]
    e = spark.createDataFrame(data, EVENTS).repartition(3)
    c = catalog(spark, g)
    names = [f.name for f in contract(17)] + ["item_count_60d", "item_mean_60d"]
    plain, hot = (rows(blocks(e, c, hot=n), "user_id", "item_id", "rating", *names) for n in (None, 40))
    assert plain == hot


def test_a_burst_is_cut_by_rank(spark):
    """10,000 events of an item over 20 years, 9,900 of them in one hour: no bucket has twice the rows asked for."""
    r = random.Random(8)
    hour = 3_600 * S
    times = [10 * 365 * DAY_US + r.randint(0, hour) for _ in range(9_900)] + [r.randint(0, 20 * 365 * DAY_US) for _ in range(100)]
    data = [(k, 1, 1 if k % 100 else 2, 1.0, t) for k, t in enumerate(times)] + [(20_000 + k, 1, 3, 1.0, 77) for k in range(300)]
    e = spark.createDataFrame(data, EVENTS).repartition(3)
    hot = h.hot_keys(e, "item_id", 100)
    assert sorted(x["item_id"] for x in hot.select("item_id").collect()) == [1, 3]
    rows = buckets.bucketed(e, "item_id", hot).collect()
    of = {}
    for x in rows:
        of.setdefault((x["item_id"], x["__b"]), []).append(x["event_us"])
        assert x["__last"] == {1: max(y["__b"] for y in rows if y["item_id"] == 1), 3: 0}.get(x["item_id"])
    assert all(len(t) < 200 or len(set(t)) == 1 for (i, _), t in of.items() if i != 2)
    assert len([1 for i, _ in of if i == 1]) > 70
    mine = sorted((b, min(t), max(t)) for (i, b), t in of.items() if i == 1)
    assert all(a[2] < b[1] for a, b in zip(mine, mine[1:], strict=False))  # in order, and no timestamp is in two
    each = buckets.over_buckets(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item_id long, x string"), "item_id", hot).collect()
    assert sorted((x["item_id"], x["__b"]) for x in each if x["item_id"] != 1) == [(2, 0), (3, 0)]
    assert {(x["item_id"], x["__b"]) for x in each} >= set(of)


def test_hot_keys_of_many_cuts_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(buckets, "BROADCAST", 3)
    data = [(k, k % 4, 1, 1.0 + k % 3, k * DAY_US) for k in range(200)]
    e = spark.createDataFrame(data, EVENTS)
    hot = h.hot_keys(e, "user_id", 10)
    plan = buckets.bucketed(e, "user_id", hot)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()
    assert rows(h.user_history(e, hot), "user_count", "user_mean") == rows(h.user_history(e), "user_count", "user_mean")


def test_stored_tables_have_an_owner(spark):
    import os

    from chronofold.sources.publish import kept, owned, stored

    with owned(spark) as own:
        assert stored(spark.range(3), "a").count() + kept(spark.range(4), "b").count() == 7
        assert len(own) == 2 and all(os.path.isdir(p.removeprefix("file://")) for p in own)
    assert not any(os.path.isdir(p.removeprefix("file://")) for p in own)


def scores(spark, vectors, tags=10):
    return spark.createDataFrame([(i, t + 1, float(x[t]) if t < len(x) else 0.0) for i, x in vectors.items() for t in range(tags)], "item_id long, tag_id int, relevance float")


def test_centroid_cosines(spark):
    s = scores(spark, {1: [1, 0], 2: [0, 1], 3: [1, 1], 4: [0, 0]})
    vec = v.vectors(s)
    assert {r["item_id"] for r in vec.collect()} == {1, 2, 3}
    e = spark.createDataFrame([(1, 1, 1, 5.0, 1), (2, 1, 2, 1.0, 2), (3, 1, 3, 5.0, 3), (4, 1, 1, 4.0, 4), (5, 1, 9, 5.0, 5), (6, 1, 1, 4.0, 4)], EVENTS)
    got = {r["event_id"]: r for r in v.preference_history(e, vec).collect()}
    assert 5 not in got
    assert got[1]["liked_cosine"] is None
    assert (got[3]["liked_cosine"], got[3]["disliked_cosine"]) == pytest.approx((1 / math.sqrt(2), 1 / math.sqrt(2)))
    # ties at 4 see the events at 1 and 3 as liked, and not each other
    for k in (4, 6):
        assert got[k]["liked_cosine"] == pytest.approx(2 / math.sqrt(5), abs=1e-6)
        assert got[k]["disliked_cosine"] == pytest.approx(0.0)
        assert got[k]["nearest_liked"] == pytest.approx(1.0)
        assert got[k]["top5_liked"] == pytest.approx((1 + 1 / math.sqrt(2)) / 2, abs=1e-6)


def test_vectors_come_with_events_when_large(spark, monkeypatch):
    r = np.random.RandomState(0)
    s = scores(spark, {i: r.rand(10) for i in range(1, 9)})
    data = [(k, k % 3, int(r.randint(1, 11)), float(r.randint(1, 11)) / 2, int(r.randint(0, 30))) for k in range(60)]
    e = spark.createDataFrame(data, EVENTS)
    small = v.preference_history(e, v.vectors(s)).toPandas().sort_values("event_id").round(9)
    monkeypatch.setattr(v, "BROADCAST", 0)
    large = v.preference_history(e, v.vectors(s)).toPandas().sort_values("event_id").round(9)
    assert small.reset_index(drop=True).equals(large.reset_index(drop=True))


@pytest.mark.parametrize("large", [False, True])
def test_profiles_of_hot_users_go_by_bucket(spark, monkeypatch, large):
    """One user with most events and one with none hot, an item liked in many buckets, ties over a bucket's end; blocks of a few items."""
    r = np.random.RandomState(4)
    vec = v.vectors(scores(spark, {i: r.rand(10) for i in range(1, 15)}))
    data = [(k, 1 if k % 5 else 2 + k % 3, 3 if r.rand() < 0.3 else int(r.randint(1, 18)), float(r.randint(1, 11)) / 2, int(r.randint(0, 150))) for k in range(400)]
    e = spark.createDataFrame(data, EVENTS).repartition(3)
    order = lambda df: df.toPandas().sort_values("event_id").reset_index(drop=True)
    plain = order(v.preference_history(e, vec))
    monkeypatch.setattr(v, "BLOCK", 4)
    if large:
        monkeypatch.setattr(v, "BROADCAST", 0)
    got = order(v.preference_history(e, vec, h.hot_keys(e, "user_id", 30)))
    assert got.event_id.tolist() == plain.event_id.tolist()
    for c in v.NAMES:
        np.testing.assert_allclose(got[c].to_numpy(), plain[c].to_numpy(), atol=1e-12)
    assert plain.top5_liked.notna().sum() > 250


def test_few_tags_are_rejected(spark):
    with pytest.raises(ValueError, match="tags"):
        v.vectors(scores(spark, {1: [1]}, tags=9))
    assert v.vectors(scores(spark, {})).count() == 0


def test_contracts(spark):
    e = spark.createDataFrame([(1, 1, 1, 5.0, 1)], EVENTS)
    s = scores(spark, {1: [1, 0]})
    for version in (17, 25, 30):
        t = feature_table(e, catalog(spark), s, version)
        check_contract(t.dtypes, version)
        assert len(contract(version)) == version
    with pytest.raises(ValueError):
        check_contract(feature_table(e, catalog(spark), s, 17).dtypes, 30)
    with pytest.raises(ValueError):
        feature_table(e, catalog(spark), None, 30)
    with pytest.raises(ValueError):
        contract(18)


def test_empty_events(spark):
    assert feature_table(spark.createDataFrame([], EVENTS), catalog(spark), scores(spark, {1: [1]}), 30).count() == 0


@pytest.mark.parametrize("bad", [None, 3, 1.5, True, "now", "today", "2020-01-01T00:00:00+00:00", dt.datetime(2020, 1, 1, tzinfo=dt.UTC)])
def test_cutoffs_are_absolute(bad):
    with pytest.raises((TypeError, ValueError)):
        p.check_cutoff(bad)


@pytest.mark.parametrize("bad", [0, -1, 1.5, "30 days", True, None])
def test_windows_are_whole_microseconds(bad):
    with pytest.raises((TypeError, ValueError)):
        check_window_us(bad)


def test_predicates(spark):
    us = p.cutoff_us("2020-01-02")
    e = spark.createDataFrame([(k, 1, 1, 1.0, us + o) for k, o in enumerate((-DAY_US - 1, -DAY_US, -1, 0, 1))], EVENTS)
    assert [r[0] for r in p.historical(e, "2020-01-02").select("event_id").orderBy("event_id").collect()] == [0, 1, 2]
    assert [r[0] for r in e.where(p.in_window("event_us", dt.date(2020, 1, 2), DAY_US)).select("event_id").orderBy("event_id").collect()] == [1, 2]
    with pytest.raises(ValueError):
        p.historical(e, "2020-01-02", {"nothing": 1})


def test_split_rules():
    p.check_splits([("a", None, "2020-01-01"), ("b", "2020-01-01", None)])
    for bad in ([("a", None, "2020-01-02"), ("b", "2020-01-01", None)], [("a", "2020-01-01", "2020-01-01")], [("a", None, None), ("b", "2020-01-01", None)]):
        with pytest.raises(ValueError):
            p.check_splits(bad)


def test_profiles_of_a_long_history_are_bounded(monkeypatch):
    """Against the plain definition, at any size of the pieces."""
    r = np.random.RandomState(6)
    vector = r.rand(9, 12)
    unit = v._unit(vector)
    n = 300
    item, rating, us = r.randint(-1, 9, n), r.randint(1, 11, n) / 2, np.sort(r.randint(0, 120, n))
    want = np.full((n, 4), np.nan)
    for k in range(n):
        if item[k] < 0:
            continue
        past = [j for j in range(n) if us[j] < us[k] and item[j] >= 0]
        for c, some in enumerate(([j for j in past if rating[j] >= 4], [j for j in past if rating[j] < 4])):
            if some:
                s = vector[item[some]].sum(axis=0)
                want[k, c] = unit[item[k]] @ s / np.sqrt(s @ s)
                if c == 0:
                    sims = np.sort(unit[item[some]] @ unit[item[k]])[::-1][:5]
                    want[k, 2:] = sims[0], sims.mean()
    for chunk, numbers in ((1024, 1 << 21), (7, 200)):
        monkeypatch.setattr(v, "CHUNK", chunk)
        monkeypatch.setattr(v, "NUMBERS", numbers)
        np.testing.assert_allclose(v._profile(item, vector, unit, rating, us), want, atol=1e-12)


def test_profile_of_200000_events_within_a_gigabyte():
    import tracemalloc

    r = np.random.RandomState(7)
    n = 200_000
    vector = r.rand(2_000, 64)
    tracemalloc.start()
    out = v._profile(r.randint(0, 2_000, n), vector, v._unit(vector), r.randint(1, 11, n) / 2, np.sort(r.randint(0, 10**9, n)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(out[-1]).all()
    assert peak < 300 << 20


def test_hot_events_go_the_way_of_all_others(spark):
    """Events aren't split into hot and other ones, each of which would shuffle its inputs anew."""
    r = random.Random(3)
    data = [(k, r.randint(1, 4), r.randint(1, 4), r.randint(1, 10) / 2, k * DAY_US) for k in range(400)]
    e, c = spark.createDataFrame(data, EVENTS), catalog(spark, {1: ["a", "b"], 2: ["b"]})
    b = blocks(e, c, hot=40)
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == plan.count("LeftSemi") == 0  # hot events don't go another way


def test_wide_rows_are_shuffled_once(spark):
    """What comes by timestamp is broadcast, and the rows of genres are grouped without a sort."""
    e = spark.createDataFrame([(k, k % 3, k % 4, 0.5 + k % 9 / 2, k * DAY_US) for k in range(1, 40)], EVENTS)
    c = spark.createDataFrame([(k, 1990, ["a", "b"][: k % 3]) for k in range(4)], "item_id long, release_year int, genres array<string>")
    scores = spark.createDataFrame([(i, t, (i + t) % 7 / 7) for i in range(4) for t in range(12)], "item_id long, tag_id int, relevance float")
    plan = blocks(e, c, scores)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(event_us" not in plan and "SortAggregate(key=[user_id" not in plan


def test_tasks_of_a_pass_by_user_grow_in_number(spark):
    from chronofold.operators import buckets

    df = spark.range(100).selectExpr("id AS user_id")
    buckets.TASK, held = 10, buckets.TASK
    try:
        assert buckets.spread(df, 100, "user_id").rdd.getNumPartitions() == 10
        assert buckets.spread(df, 30, "user_id") is df
    finally:
        buckets.TASK = held


def test_small_buckets_are_added_up_in_one_part(spark, monkeypatch):
    """Buckets of a few rows were cut into eight parts, each a call of Python."""
    from chronofold.operators import vectors

    df = spark.createDataFrame([(1, k // 30, 2) for k in range(90)], "user_id long, __b long, __last long")
    assert vectors._parts(df) == 1 and vectors._parts(df.limit(0)) == 1
    monkeypatch.setattr(vectors, "BLOCK", 10)
    assert vectors._parts(df) == 3
    monkeypatch.setattr(vectors, "BLOCK", 1)
    assert vectors._parts(df) == vectors.PARTS
