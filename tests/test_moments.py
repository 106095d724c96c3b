"""Exact sums and stable moments against fractions and plain definitions."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from chronofold.operators import moments


def sums(df, by=("g",)):
    return {r[0] if by else None: (r["n"], r["total"]) for r in moments.exact_sums(df, list(by), "x").collect()}


def test_sums_are_exact_in_any_order(spark):
    r = random.Random(2)
    rows = [(g, r.choice([-1, 1]) * math.ldexp(r.random(), r.randint(-300, 300) if g == "wide" else r.randint(-60, 60))) for g in ("wide", "near") for _ in range(400)]
    rows += [("cancel", x) for x in (1e16, 1.0, -1e16, 1e-16, 3e300, -3e300)] + [("powers", math.ldexp(s, k)) for k in range(-1074, 1023, 37) for s in (1, -1)] + [("powers", 2.0**24), ("powers", 2.0**-1074)]
    rows += [("null", None), ("zero", 0.0), ("zero", -0.0), (None, 1.5), ("inf", float("inf")), ("inf", 1.0), ("nan", float("nan")), ("both", float("inf")), ("both", float("-inf"))]
    want = {}
    for g in {g for g, _ in rows}:
        x = [v for h, v in rows if h == g and v is not None]
        want[g] = (len(x), math.fsum(x) if x and all(map(math.isfinite, x)) else sum(x) if x else None)
    df = spark.createDataFrame(rows, "g string, x double")
    for part in (df, df.orderBy(F.rand(1)).repartition(7), df.coalesce(1)):
        got = sums(part)
        assert set(got) == set(want)
        assert all(got[g] == want[g] or math.isnan(got[g][1]) and math.isnan(want[g][1]) for g in want)
    assert moments.exact_sums(df.where("g = 'cancel'"), [], "x").first()["total"] == math.fsum([1e16, 1.0, -1e16, 1e-16, 3e300, -3e300]) == 1.0000000000000002 - 2.220446049250313e-16 + 0
    assert moments.exact_sums(df.limit(0), ["g"], "x").count() == 0
    with pytest.raises(ValueError):
        moments.exact_sums(df, [], "y")


def test_overflow(spark):
    df = spark.createDataFrame([("a", 1.7e308), ("a", 1.7e308), ("b", 1.7e308), ("b", 1.7e308), ("b", -1.7e308)], "g string, x double")
    assert sums(df) == {"a": (2, float("inf")), "b": (3, 1.7e308)}


def test_deviation_of_large_close_values(spark):
    df = spark.createDataFrame([(k, 1, 1e9 + k, k) for k in range(4)], "event_id long, key long, x double, event_us long")
    for hot in (None, 1):
        last = moments.prior_moments(df, "key", "x", hot).where("event_us = 3").first()
        assert (last["prior_n"], last["prior_mean"]) == (3, 1e9 + 1)
        assert last["prior_std"] == pytest.approx(math.sqrt(2 / 3), abs=1e-9)


@pytest.mark.parametrize("hot", [None, 15])
def test_prior_moments(spark, hot):
    r = random.Random(5)
    data = [(k, 1 if r.random() < 0.6 else r.randint(2, 4), None if r.random() < 0.1 else 1e9 + r.random(), r.randint(0, 60)) for k in range(300)]
    df = spark.createDataFrame(data, "event_id long, key long, x double, event_us long").repartition(3)
    got = {x["event_id"]: x for x in moments.prior_moments(df, "key", "x", hot).collect()}
    assert len(got) == len(data)
    for i, key, _, t in data:
        past = [v for _, k, v, u in data if k == key and u < t and v is not None]
        assert got[i]["prior_n"] == len(past)
        if past:
            assert got[i]["prior_mean"] == pytest.approx(statistics.fmean(past), abs=1e-6)
            assert got[i]["prior_std"] == pytest.approx(statistics.pstdev([v - 1e9 for v in past]), abs=1e-6)
        else:
            assert got[i]["prior_mean"] is None and got[i]["prior_std"] is None


def test_limbs_are_the_double_itself():
    """Cut by whole numbers of a batch, not by nested expressions a row, which took most of a minute on 600,000 rows."""
    from fractions import Fraction

    import numpy as np

    r = random.Random(4)
    x = np.array([0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, 2.0**53 - 1, -1.0, *[r.choice([-1, 1]) * math.ldexp(r.random(), r.randint(-1080, 1023)) for _ in range(2000)]])
    place, found = moments.limbs(x)
    for k, v in enumerate(x.tolist()):
        assert all(abs(int(limb[k])) < 1 << moments.BITS for limb in found)
        assert sum(int(limb[k]) * Fraction(2) ** (moments.BITS * (int(place[k]) + j)) for j, limb in enumerate(found)) == Fraction(v)
