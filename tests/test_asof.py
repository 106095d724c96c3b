"""As-of joins against the plain definition."""

import random

import pytest

from chronofold.operators.asof import asof_join

LEFT = "id long, k long, t long, x string"
RIGHT = "k long, at long, v long, w string, t string"


def tables(seed, keys=3, n=80, span=60):
    r = random.Random(seed)
    some = lambda x, p=0.1: None if r.random() < p else x
    # the first key has half of all rows
    key = lambda: 0 if r.random() < 0.5 else r.randint(1, keys)
    left = [(i, some(key(), 0.05), some(r.randint(0, span), 0.05), "x") for i in range(n)]
    right = [(some(key(), 0.05), some(r.randint(0, span), 0.05), some(r.randint(0, 5)), some(r.choice("abc"), 0.4), "t") for _ in range(n)]
    return left, right


def low(v):
    return (v is not None, v if v is not None else 0)


def plain(left, right, direction, strict, tolerance, ties, carry):
    cols = {"v": 2, "w": 3}
    order = lambda r: tuple((r[cols[c]] is not None, r[cols[c]] if r[cols[c]] is not None else "") for c in ties)
    out = []
    for i, k, t, x in left:
        def find(ok, side, k=k, t=t):
            found = [r for r in right if r[0] is not None and r[0] == k and r[1] is not None and t is not None and ok(r)]
            found = [r for r in found if (r[1] < t if strict else r[1] <= t)] if side == "backward" else [r for r in found if (r[1] > t if strict else r[1] >= t)]
            best = max(found, key=lambda r: ((r[1] if side == "backward" else -r[1]), order(r)), default=None)
            return best if best is None or tolerance is None or abs(best[1] - t) <= tolerance else None

        def pick(ok, t=t, find=find):
            if direction != "nearest":
                return find(ok, direction)
            a, b = find(ok, "backward"), find(ok, "forward")
            return a if b is None or (a is not None and t - a[1] <= b[1] - t) else b

        if carry:
            got = [pick(lambda r, c=c: r[cols[c]] is not None) for c in "vw"]
            out.append((i, k, t, x, *[g and g[cols[c]] for g, c in zip(got, "vw", strict=True)], *[g and g[1] for g in got]))
        else:
            g = pick(lambda r: True)
            out.append((i, k, t, x, *((g[2], g[3], g[1]) if g else (None, None, None))))
    return out


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("strict, tolerance, carry", [(False, None, False), (True, 5, False), (True, None, True), (False, 8, True)])
def test_all_rules(spark, direction, strict, tolerance, carry):
    left, right = tables(len(direction) + strict)
    want = plain(left, right, direction, strict, tolerance, ["v", "w"], carry)
    a, b = spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT).repartition(2)
    for hot in (None, 9):
        got = asof_join(a, b, "k", "t", "at", ["v", "w"], direction=direction, strict=strict, tolerance=tolerance, carry=carry, hot=hot)
        assert got.columns[:4] == a.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_one_key_holds_half_of_all_rows_and_stays_apart_in_buckets(spark):
    left, right = tables(9, n=2_000, span=100_000)
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    got = asof_join(a, b, "k", "t", "at", ["v"], ties=["v"], hot=50)
    assert "__b" in got._jdf.queryExecution().optimizedPlan().toString()
    want = [(*r[:5], r[6]) for r in plain(left, right, "backward", False, None, ["v"], False)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_several_keys_extra_columns_and_empty_tables(spark):
    a = spark.createDataFrame([(1, "p", 5, 9), (2, "q", 5, 9)], "k long, j string, t long, `a.b` long")
    b = spark.createDataFrame([(1, "p", 3, 7), (1, "q", 4, 8), (2, "q", 6, 8)], "k long, j string, t long, v long")
    assert sorted(map(tuple, asof_join(a, b, ["k", "j"], "t").collect())) == [(1, "p", 5, 9, 7, 3), (2, "q", 5, 9, None, None)]
    assert asof_join(a.limit(0), b, ["k", "j"], "t").count() == 0
    assert [r.matched for r in asof_join(a, b.limit(0), ["k", "j"], "t").collect()] == [None, None]
    with pytest.raises(ValueError, match="prefix"):
        asof_join(a.withColumnRenamed("a.b", "V"), b, ["k", "j"], "t")
    for bad in ({"direction": "sideways"}, {"tolerance": -1}, {"tolerance": 1.5}):
        with pytest.raises(ValueError):
            asof_join(a, b, ["k", "j"], "t", **bad)
