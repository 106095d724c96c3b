"""State documents of four older shapes, and what is refused."""

import copy
import math

import pytest

from chronofold.functions.scalars import DAY_US
from chronofold.plans.features import blocks
from chronofold.state import checkpoints, older, tables

from .test_state import EVENTS, catalog, data  # noqa: F401

CUT = 60 * DAY_US


def moments(ratings):
    n, mean = len(ratings), 0.0
    m2 = 0.0
    for k, r in enumerate(ratings, 1):  # as running moments are kept
        d = r - mean
        mean += d / k
        m2 += d * (r - mean)
    return {"count": n, "mean": mean, "M2": m2}


def iso(us):
    import datetime as dt

    return (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)).strftime("%Y-%m-%dT%H:%M:%S.%f") + "000"


def document(rows, genres, shape):
    past = [r for r in sorted(rows, key=lambda r: r[4]) if r[4] < CUT]
    by = lambda k: sorted({r[k] for r in past})
    doc = {
        "global": moments([r[3] for r in past]), "users": [{"userId": u} | moments([r[3] for r in past if r[1] == u]) for u in by(1)],
        "movies": [{"movieId": i} | moments([r[3] for r in past if r[2] == i]) for i in by(2)],
    }
    times = sorted({r[4] for r in past if r[4] >= CUT - 30 * DAY_US})
    if shape != "moments":
        doc["lastUserRatings"] = [{"userId": u, "timestamp": iso(max(r[4] for r in past if r[1] == u))} for u in by(1)]
        count = lambda t, i: sum(r[4] == t and r[2] == i for r in past)
        doc["movieRatingBatches30d"] = [{"timestamp": iso(t), "movies": [{"movieId": i, "count": count(t, i)} for i in by(2) if count(t, i)]} for t in times]
    if shape in ("grouped", "tracked"):
        pairs = sorted({(r[1], g) for r in past for g in genres[r[2]]})
        doc["userGenres"] = [{"userId": u, "genreId": g} | moments([r[3] for r in past if r[1] == u and g in genres[r[2]]]) for u, g in pairs]
    if shape == "tracked":
        doc["movieRatingCounts30d"] = [{"movieId": i, "count": c} for i in by(2) if (c := sum(r[2] == i and r[4] in times for r in past))]
        doc |= {"latestAppliedTimestamp": iso(past[-1][4]), "timestampTrackingComplete": True, "genreTrackingComplete": True, "activityExpirationWatermark": None, "activityExpiredCount": 0}
    return doc


@pytest.fixture(scope="module")
def source(catalog):  # noqa: F811
    return data(11, 50), {r["item_id"]: r["genres"] for r in catalog.collect()}


@pytest.mark.parametrize("shape", ["moments", "timed", "grouped", "tracked"])
def test_features_after_an_older_document(spark, catalog, source, shape):  # noqa: F811
    rows, genres = source
    doc = document(rows, genres, shape)
    assert older.shape_of(doc) == shape
    state = older.from_older(spark, doc, CUT)
    e = spark.createDataFrame(rows, EVENTS)
    built = tables.build(e, checkpoints.bridge_of(catalog), CUT, windows=False)
    assert (state.count, state.total) == (built.count, built.total)
    for name in ("item", *(["group"] if shape in ("grouped", "tracked") else [])):
        a, b = getattr(state, name), getattr(built, name)
        assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
    with pytest.raises(ValueError, match="windows"):
        tables.suffix_features(state, e, catalog)
    names = ["event_id", "global_count", "global_mean", "user_count", "user_mean", "user_std", "item_count", "item_mean", "item_std"]
    names += ["user_recency_s"] if shape != "moments" else []
    names += ["user_genre_count", "user_genre_mean"] if shape in ("grouped", "tracked") else []
    take = lambda df: sorted(map(tuple, df.where(f"event_us >= {CUT}").select(*names).collect()))
    got = tables.suffix_features(state, e, catalog, windows=False)
    assert take(got) == take(blocks(e, catalog))
    assert got.where("item_count_30d IS NOT NULL OR item_mean_ratio IS NOT NULL").isEmpty()
    if shape == "moments":
        first = min(r[4] for r in rows if r[4] >= CUT)
        assert all(r["user_recency_s"] is None for r in got.where(f"event_us = {first}").collect())
    assert state.trusted == (shape == "tracked") and not state.windows


def test_refusals(spark, source):
    rows, genres = source
    good = document(rows, genres, "tracked")

    def bad(change, **more):
        doc = copy.deepcopy(good)
        change(doc)
        with pytest.raises(ValueError):
            older.from_older(spark, doc, **more)

    bad(lambda d: d.pop("userGenres"))
    bad(lambda d: d.update(extra=1))
    bad(lambda d: d["users"].append(d["users"][0]))
    bad(lambda d: d["users"][0].update(userId=1.0))
    bad(lambda d: d["users"][0].update(count=True))
    bad(lambda d: d["users"][0].update(M2=-1.0))
    bad(lambda d: d["users"][0].update(mean=math.nan))
    bad(lambda d: d["movies"][0].update(mean=d["movies"][0]["mean"] + 0.1))
    bad(lambda d: d["movies"].pop())
    bad(lambda d: d["userGenres"][0].update(genreId=" a"))
    bad(lambda d: d["lastUserRatings"][0].update(timestamp="yesterday"))
    bad(lambda d: d["lastUserRatings"][0].update(timestamp="2000-01-01T00:00:00.000000001"))
    bad(lambda d: d["lastUserRatings"].append({"userId": 99, "timestamp": iso(0)}))
    bad(lambda d: d["movieRatingBatches30d"].reverse())
    bad(lambda d: d["movieRatingBatches30d"][0].update(movies=[]))
    bad(lambda d: d["movieRatingCounts30d"][0].update(count=99))
    bad(lambda d: d.update(genreTrackingComplete=1))
    bad(lambda d: d.update(activityExpiredCount=-1))
    bad(lambda d: None, cutoff_us=5)
    with pytest.raises(ValueError, match="cutoff"):
        older.from_older(spark, document(rows, genres, "moments"))
    assert older.from_older(spark, good).cutoff_us == max(r[4] for r in rows if r[4] < CUT) + 1
    for other in (None, [], {"global": {}}):
        with pytest.raises(ValueError):
            older.shape_of(other)
