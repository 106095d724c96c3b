"""Keyed state against the features of the whole history."""

import random

import pytest

from chronofold.functions.scalars import DAY_US
from chronofold.plans.features import blocks
from chronofold.streaming.keyed import KeyedReplay
from chronofold.streaming.replay import LateData

from .test_state import EVENTS, catalog, data, take  # noqa: F401


def stream_of(spark, tmp_path, catalog):  # noqa: F811
    return KeyedReplay(spark, f"file://{tmp_path}/out", catalog), f"file://{tmp_path}/in"


def write(spark, rows, folder):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_equals_the_whole_history(spark, catalog, tmp_path):  # noqa: F811
    """Three batches, a timestamp split between two of them, ties, an item without a catalogue row."""
    r = random.Random(3)
    rows = sorted([*data(11, 60), *[(100 + k, r.randint(1, 3), 9, 2.5, r.choice([1, 5, 40]) * DAY_US) for k in range(6)]], key=lambda x: x[4])
    stream, folder = stream_of(spark, tmp_path, catalog)
    cut = next(k for k in range(20, len(rows)) if rows[k][4] == rows[k - 1][4])
    for part in (rows[:10], rows[10:cut], rows[cut:]):
        write(spark, part, folder)
        stream.run(folder)
    stream.run(folder)  # nothing new
    assert take(stream.features()) == take(blocks(spark.createDataFrame(rows, EVENTS), catalog))


def test_timers_empty_the_lists_of_idle_items(spark, catalog, tmp_path):  # noqa: F811
    stream, folder = stream_of(spark, tmp_path, catalog)
    held = lambda: {(r["key"]["item_id"], r["list_element"]["t"]) for r in stream.state("item", "recent").collect()}
    write(spark, [(1, 1, 1, 4.0, 0), (2, 1, 1, 3.0, DAY_US), (3, 1, 1, 2.0, 2 * DAY_US), (4, 1, 2, 5.0, 2 * DAY_US)], folder)
    stream.run(folder)
    assert held() == {(1, 0), (1, DAY_US)}
    write(spark, [(5, 2, 2, 1.0, 35 * DAY_US)], folder)
    stream.run(folder)
    sums = lambda: {r["key"]["item_id"]: r["value"] for r in stream.state("item", "sums").collect()}
    assert (sums()[1]["n"], sums()[1]["n30"], sums()[1]["n60"]) == (2, 0, 2)  # item 1 had no row; a timer took both out of 30 days
    write(spark, [(6, 2, 2, 1.0, 70 * DAY_US)], folder)
    stream.run(folder)
    assert (sums()[1]["n30"], sums()[1]["n60"]) == (0, 0)
    assert held() == {(2, 35 * DAY_US)}
    write(spark, [(7, 2, 1, 1.0, 71 * DAY_US)], folder)
    stream.run(folder)
    rows = [(1, 1, 1, 4.0, 0), (2, 1, 1, 3.0, DAY_US), (3, 1, 1, 2.0, 2 * DAY_US), (4, 1, 2, 5.0, 2 * DAY_US), (5, 2, 2, 1.0, 35 * DAY_US), (6, 2, 2, 1.0, 70 * DAY_US), (7, 2, 1, 1.0, 71 * DAY_US)]
    assert take(stream.features()) == take(blocks(spark.createDataFrame(rows, EVENTS), catalog))


@pytest.mark.parametrize("late", [(3, 1, 1, 1.0, 5 * DAY_US), (3, 2, 2, 1.0, 5 * DAY_US)])
def test_late_rows_raise(spark, catalog, tmp_path, late):  # noqa: F811
    stream, folder = stream_of(spark, tmp_path, catalog)
    write(spark, [(1, 1, 1, 4.0, DAY_US), (2, 1, 1, 4.0, 10 * DAY_US)], folder)
    stream.run(folder)
    write(spark, [late], folder)
    with pytest.raises(LateData):
        stream.run(folder)


def test_late_rows_of_one_batch_and_no_rows(spark, catalog, tmp_path):  # noqa: F811
    from chronofold.streaming.keyed import _in_order

    import pandas as pd

    frame = pd.DataFrame({"event_id": [2, 1], "event_us": [5, 3]})
    assert _in_order([frame], 3)["event_id"].tolist() == [1, 2]
    with pytest.raises(LateData):
        _in_order([frame], 4)
    stream, folder = stream_of(spark, tmp_path, catalog)
    write(spark, [], folder)
    stream.run(folder)


class Calls:
    """A state handle that counts its round trips."""

    def __init__(self):
        self.n, self.values = 0, {}

    def getValueState(self, name, schema):
        return Held(self, name)

    getListState = getMapState = getValueState

    def registerTimer(self, at):
        self.n += 1


class Held:
    def __init__(self, calls, name):
        self.calls, self.name = calls, name

    def get(self):
        self.calls.n += 1
        return self.calls.values.get(self.name)

    def update(self, value):
        self.calls.n += 1
        self.calls.values[self.name] = value

    put = update


def test_round_trips_of_a_key_do_not_grow_with_its_rows_and_groups():
    """Each group of a user was written by a call of its own, and every value was asked for twice."""
    from chronofold.streaming.keyed import ItemState, UserState

    for processor, most in ((UserState(), 2), (ItemState(), 5)):
        calls = Calls()
        processor.init(calls)
        for first in (0, 100):
            before = calls.n
            rows = [{"event_id": first + k, "event_us": (first + k) * DAY_US // 50, "rating": 1.0, "genres": [f"g{k}", f"g{k + 1}"]} for k in range(50)]
            assert len(list(processor.handleInputRows((7,), iter(rows), None))) == 50
            assert calls.n - before <= most


def test_neighbouring_keys_share_the_calls_of_the_state():
    """Each key had calls of its own, and each event a row of its own back: 64 items were 256 calls and 128 rows."""
    import json

    from chronofold.streaming.keyed import _ITEM, Grouped, ItemState, _fields

    calls = Calls()
    names = ["item_id", *[c for c, _ in _fields(_ITEM)]]
    grouped = Grouped(ItemState(), names)
    grouped.init(calls)
    for first in (0, 2):
        rows = [{"row": json.dumps({"id": k, "event_id": 64 * t + k, "event_us": t * DAY_US, "rating": 1.5})} for k in range(64) for t in (first, first + 1)]
        before = calls.n
        (out,) = grouped.handleInputRows((0,), iter(rows), None)
        assert calls.n - before <= 3
        found = json.loads(out["found"])
        assert sorted(found["event_id"]) == list(range(64 * first, 64 * first + 128))
        assert {(i, e) for i, e in zip(found["item_id"], found["event_id"], strict=True)} == {(e % 64, e) for e in found["event_id"]}
        assert set(zip(found["event_us"], found["item_count"], found["n60"], strict=True)) == {(t * DAY_US, t, t) for t in (first, first + 1)}


def test_items_that_share_a_state_and_negative_ids(spark, catalog, tmp_path):  # noqa: F811
    """Timers of items of one group are at different times; keys below zero have groups too."""
    stream, folder = stream_of(spark, tmp_path, catalog)
    rows = [(k, 1 + k % 3, item, 1.0 + k % 4, day * DAY_US) for k, (item, day) in enumerate([(1, 0), (2, 3), (-1, 5), (70, 6), (1, 31), (2, 34), (-1, 40), (70, 64), (1, 66), (2, 80)])]
    for part in (rows[:4], rows[4:7], rows[7:]):
        write(spark, part, folder)
        stream.run(folder)
    assert take(stream.features()) == take(blocks(spark.createDataFrame(rows, EVENTS), catalog))
    assert {r["key"]["item_id"] for r in stream.state("item", "sums").collect()} == {1, 2, -1, 70}
    assert {(r["key"]["item_id"], r["list_element"]["t"] // DAY_US) for r in stream.state("item", "recent").collect()} == {(1, 31), (2, 34)}
    assert {r["key"]["user_id"]: r["value"]["n"] + r["value"]["tn"] for r in stream.state("user", "sums").collect()} == {1: 4, 2: 3, 3: 3}
