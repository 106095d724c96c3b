"""Features of an event stream from keyed state: what a batch reads of the state is that of its own users and items.

Two stateful queries read the same source. By user there is a value (sums, the last time, and sums by group); by
item a value (sums, and those of the last 30 and 60 days) and the list of what these windows hold, by timestamp. Each also holds
apart the sums of the key's newest timestamp, which rows of that timestamp don't see, so a timestamp may be split over
batches. An event-time timer an item takes out of the windows, 30 and 60 days on, what no row has taken out by then, so that
items that are rated no more keep no list.

Rows come in order of time. One that is older than its user's or item's newest, or older than the watermark, raises
``LateData``; none is dropped in silence. Each query writes its part of the features exactly once, by the file sink and the
stream's checkpoint; ``features`` joins the parts and adds the global history, from sums by timestamp.

A call of the state costs more than a row, and a row costs by column on its way to Python and back. So neighbouring keys (``GROUP``) are one key of
Spark's state and share its calls (``Grouped``), a row goes to Python as one text, and a group's results come back as one.
"""

from __future__ import annotations

import json
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import DAY_US, age_years, pop_std, safe_ratio
from ..operators.history import global_history, window_ratios
from ..session import reach_workers
from .replay import SCHEMA, LateData

LATE = "a row comes after its time was closed"
#: Rows of one millisecond, the grain of watermarks, may be split over batches.
DELAY = "1 millisecond"
WINDOWS_US = {"30d": 30 * DAY_US, "60d": 60 * DAY_US}
#: Added to times for the watermark, which begins at 1970 (pandas ends at 2262): times from 1899 to 2190 can be taken in.
SHIFT_US = 2**51
#: Bits of a key by which neighbours share a key of the state: fewer where what is held of one is larger.
GROUP = {"user": 4, "item": 6}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sorted(rows, newest: int | None, *columns: str) -> list[tuple]:
    """The values of ``columns``, the first two of them event_id and event_us, of a key's rows of a batch in order of time."""
    found = sorted(map(itemgetter(*columns), rows), key=itemgetter(1, 0))
    if newest is not None and found and found[0][1] < newest:
        raise LateData(f"{LATE}: {found[0][1]} after {newest}")
    return found


def _in_order(frames, newest: int | None):
    """The ids and times of frames of a key's rows, as ``_sorted`` has them."""
    import pandas as pd

    rows = (r for f in frames for r in f[["event_id", "event_us"]].to_dict("records"))
    return pd.DataFrame(_sorted(rows, newest, "event_id", "event_us"), columns=["event_id", "event_us"])


class UserState(StatefulProcessor):
    """(event_id, user_count, user_s, user_ss, user_last, group_n, group_s) of a user's events, as ``_USER`` has them.

    Every call of the state is a round trip, so the sums by group, a list for each of their columns, are in the one value.
    """

    # before the newest timestamp: n, s, ss, last; at it: t, tn, ts, tss; and the same by group
    SUMS = "n long, s double, ss double, last long, t long, tn long, ts double, tss double, genre array<string>, gn array<long>, gs array<double>, gt array<long>, gtn array<long>, gts array<double>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", self.SUMS)

    def handleInputRows(self, key, rows, timerValues):
        held = self.sums.get()
        n, s, ss, last, t, tn, ts, tss = tuple(held[:8]) if held is not None else (0, 0.0, 0.0, None, None, 0, 0.0, 0.0)
        groups = {g[0]: tuple(g[1:]) for g in zip(*held[8:], strict=True)} if held is not None else {}
        for event, us, rating, genres in _sorted(rows, t, "event_id", "event_us", "rating", "genres"):
            if us != t:
                n, s, ss, last, t, tn, ts, tss = n + tn, s + ts, ss + tss, last if t is None else t, us, 0, 0.0, 0.0
            gn, gs = 0, 0.0
            genres = genres or []
            for g in genres:
                a, b, at, an, as_ = groups.get(g, (0, 0.0, us, 0, 0.0))
                if at != us:
                    a, b, at, an, as_ = a + an, b + as_, us, 0, 0.0
                gn, gs = gn + a, gs + b
                groups[g] = (a, b, at, an, as_)
            yield event, n, s, ss, last, gn, gs
            for g in genres:
                a, b, at, an, as_ = groups[g]
                groups[g] = (a, b, at, an + 1, as_ + rating)
            tn, ts, tss = tn + 1, ts + rating, tss + rating * rating
        columns = [list(c) for c in zip(*((g, *v) for g, v in groups.items()), strict=True)] or [[] for _ in range(6)]
        self.sums.update((n, s, ss, last, t, tn, ts, tss, *columns))

    def close(self) -> None:
        pass


class ItemState(StatefulProcessor):
    """(event_id, event_us, rating, item_count, item_s, item_ss, and n and s of the windows) of an item's events, as ``_ITEM`` has them."""

    SUMS = "n long, s double, ss double, n30 long, s30 double, n60 long, s60 double, t long, tn long, ts double, tss double, due long"
    RECENT = "t long, n long, s double, young boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums, self.recent = handle.getValueState("sums", self.SUMS), handle.getListState("recent", self.RECENT)

    def _read(self):
        held = self.sums.get()
        sums = list(held) if held is not None else [0, 0.0, 0.0, 0, 0.0, 0, 0.0, None, 0, 0.0, 0.0, None]
        return sums, [tuple(r) for r in self.recent.get()] if sums[5] else []  # the list has what is in 60 days

    def _write(self, sums, recent, before) -> None:
        if recent and recent != before:
            self.recent.put(recent)
        elif before and not recent:
            self.recent.clear()
        # the timer of what leaves a window next, if it isn't there already; what isn't folded yet leaves later than that
        due = min([t + WINDOWS_US["30d" if young else "60d"] for t, _, _, young in recent[:1]] + [t + WINDOWS_US["30d"] for t, _, _, young in recent if young][:1], default=None)
        due = None if due is None else (due + SHIFT_US) // 1000 + 1
        if due is not None and due != sums[11]:
            self.handle.registerTimer(due)
        sums[11] = due
        self.sums.update(tuple(sums))

    @staticmethod
    def _evict(sums, recent, before: int):
        """Takes out of the windows what is older than they are at the time ``before``; a row at the edge stays."""
        kept = []
        for t, n, s, young in recent:
            if young and t < before - WINDOWS_US["30d"]:
                sums[3], sums[4], young = sums[3] - n, sums[4] - s, False
            if t < before - WINDOWS_US["60d"]:
                sums[5], sums[6] = sums[5] - n, sums[6] - s
            else:
                kept.append((t, n, s, young))
        return kept

    def handleInputRows(self, key, rows, timerValues):
        sums, recent = self._read()
        before = list(recent)
        for event, us, rating in _sorted(rows, sums[7], "event_id", "event_us", "rating"):
            if us != sums[7]:
                t, tn, ts, tss = sums[7:11]
                if tn:
                    sums[0], sums[1], sums[2] = sums[0] + tn, sums[1] + ts, sums[2] + tss
                    sums[3], sums[4], sums[5], sums[6] = sums[3] + tn, sums[4] + ts, sums[5] + tn, sums[6] + ts
                    recent.append((t, tn, ts, True))
                sums[7:11] = us, 0, 0.0, 0.0
                recent = self._evict(sums, recent, us)
            yield event, us, rating, *sums[:7]
            sums[8], sums[9], sums[10] = sums[8] + 1, sums[9] + rating, sums[10] + rating * rating
        self._write(sums, recent, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        sums, before = self._read()
        if sums[11] != expiredTimerInfo.getExpiryTimeInMs():
            return iter(())  # another timer has taken its place
        recent = self._evict(sums, before, timerValues.getCurrentWatermarkInMs() * 1000 - SHIFT_US)  # no row to come is older
        sums[11] = None
        self._write(sums, recent, before)
        return iter(())

    def close(self) -> None:
        pass


class _Held:
    """A state variable of the key whose turn it is in a group, in memory."""

    def __init__(self, group: Grouped, name: str, empty):
        self.group, self.name, self.empty = group, name, empty

    def get(self):
        return self.group.now.get(self.name, self.empty)

    def update(self, value) -> None:
        self.group.now[self.name] = value

    put = update

    def clear(self) -> None:
        self.group.now.pop(self.name, None)


class Grouped(StatefulProcessor):
    """A processor of keys over groups of them: what is held of a group's keys is one value, a JSON list of objects of ``key`` and the variables, read and
    written once a batch.

    Rows come as a JSON text each, ``row``, with ``id`` for the key; results go as one JSON text a group and batch, of a list for each of ``columns``. A group has a
    timer at the earliest time of those of its keys.
    """

    def __init__(self, of: StatefulProcessor, columns: list[str]):
        self.of, self.columns = of, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.now = handle, {}
        self.held = handle.getValueState("held", "held string, due long")
        self.of.init(self)

    # what the processor of keys asks of its handle
    def getValueState(self, name: str, schema: str) -> _Held:
        return _Held(self, name, None)

    def getListState(self, name: str, schema: str) -> _Held:
        return _Held(self, name, ())

    def registerTimer(self, at: int) -> None:
        self.now["due"] = at

    def _read(self) -> tuple[dict, int | None]:
        held = self.held.get()
        return ({}, None) if held is None else ({v["key"]: v for v in json.loads(held[0])}, held[1])

    def _write(self, keys: dict, before: int | None) -> None:
        due = min((v["due"] for v in keys.values() if "due" in v), default=None)
        if due is not None and due != before:
            self.handle.registerTimer(due)
        self.held.update((json.dumps(list(keys.values())), due))

    def handleInputRows(self, key, rows, timerValues):
        keys, due = self._read()
        of: dict = {}
        for r in rows:
            row = json.loads(r["row"])
            of.setdefault(row["id"], []).append(row)
        found = []
        for k, some in of.items():
            self.now = keys.setdefault(k, {"key": k})
            found += [(k, *x) for x in self.of.handleInputRows((k,), some, timerValues)]
        self._write(keys, due)
        yield Row(found=json.dumps(dict(zip(self.columns, zip(*found, strict=True), strict=True))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        keys, due = self._read()
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return iter(())  # another timer has taken its place
        until = timerValues.getCurrentWatermarkInMs()
        for k, self.now in keys.items():
            if self.now.get("due", until + 1) <= until:
                for _ in self.of.handleExpiredTimer((k,), timerValues, ExpiredTimerInfo(self.now.pop("due"))):
                    raise NotImplementedError("results of timers")
        self._write(keys, None)
        return iter(())

    def close(self) -> None:
        self.of.close()


_USER = "event_id long, user_count long, user_s double, user_ss double, user_last long, group_n long, group_s double"
_ITEM = "event_id long, event_us long, rating double, item_count long, item_s double, item_ss double, n30 long, s30 double, n60 long, s60 double"


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ")) for c in schema.split(", ")]


class KeyedReplay:
    """``run`` takes in what is new in a folder of Parquet files; ``features`` are those of all events taken in so far."""

    def __init__(self, spark: SparkSession, root: str, catalog: DataFrame):
        self.spark, self.root, self.catalog = spark, root, catalog

    def _query(self, name: str, source: str, processor: StatefulProcessor, schema: str, files_a_batch: int | None) -> None:
        stream, key = self.spark.readStream.schema(SCHEMA), F.col(f"{name}_id")
        if files_a_batch:
            stream = stream.option("maxFilesPerTrigger", files_a_batch)
        rows, columns = stream.parquet(source), ["event_id", "event_us", "rating"]
        if timed := name == "item":
            rows = rows.withColumn("at", F.timestamp_micros(F.col("event_us") + F.lit(SHIFT_US))).withWatermark("at", DELAY)
        else:  # has no timers, and rows before the watermark have raised in the query by item
            rows, columns = rows.join(self.catalog.select("item_id", "genres"), "item_id", "left"), [*columns, "genres"]
        row = F.to_json(F.struct(key.alias("id"), *columns), {"ignoreNullFields": "false"}).alias("row")
        rows = rows.select(F.shiftright(key, GROUP[name]).alias("of"), *["at"][:timed], row)
        fields = [(f"{name}_id", "long"), *_fields(schema)]
        out = rows.groupBy("of").transformWithState(Grouped(processor, [c for c, _ in fields]), "found string", "Append", "EventTime" if timed else "None")
        out = out.select(F.from_json("found", ", ".join(f"{c} array<{kind}>" for c, kind in fields)).alias("f"))
        out = out.select(F.inline(F.arrays_zip(*[F.col(f"f.{c}") for c, _ in fields])))
        q = out.writeStream.format("parquet").option("path", f"{self.root}/{name}").option("checkpointLocation", f"{self.root}/stream-{name}").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception as e:
            if LATE in str(e):
                raise LateData(LATE) from e
            raise
        if any(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators):
            raise LateData(f"{LATE}, before the watermark")

    def run(self, source: str, files_a_batch: int | None = 1) -> None:
        """Reads the files of ``source`` that are new to the stream until none is left, oldest first."""
        reach_workers(self.spark)
        before = self.spark.conf.get(_PROVIDER, None)
        self.spark.conf.set(_PROVIDER, _ROCKS)
        try:
            self._query("item", source, ItemState(), _ITEM, files_a_batch)
            self._query("user", source, UserState(), _USER, files_a_batch)
        finally:
            self.spark.conf.set(_PROVIDER, before) if before else self.spark.conf.unset(_PROVIDER)

    def state(self, name: str, variable: str) -> DataFrame:
        """The rows of a state variable of the ``user`` or ``item`` query, as they are now: key and value, or list_element of ``recent``."""
        listed, of = variable == "recent", {"user": UserState, "item": ItemState}[name]

        @F.udf(f"array<struct<key struct<{name}_id long>, {'list_element' if listed else 'value'} struct<{getattr(of, variable.upper())}>>>")
        def rows(held):
            return [((v["key"],), tuple(x)) for v in json.loads(held) for x in (v.get(variable, ()) if listed else [v[variable]])]

        held = self.spark.read.format("statestore").option("stateVarName", "held").load(f"{self.root}/stream-{name}")
        return held.select(F.inline(rows("value.held")))

    def features(self) -> DataFrame:
        """Features of the 22 columns that need no vectors, in double precision."""
        e = self.spark.read.parquet(f"{self.root}/item").join(self.spark.read.parquet(f"{self.root}/user"), "event_id")
        e = global_history(e).join(self.catalog.select("item_id", "release_year", "genres"), "item_id", "left")
        user, item = F.col("user_count").cast("double"), F.col("item_count").cast("double")
        e = e.withColumns({
            "user_mean": F.coalesce(safe_ratio(F.col("user_s"), user), "global_mean"), "user_std": pop_std(user, F.col("user_s"), F.col("user_ss")),
            "user_recency_s": (F.col("event_us") - F.col("user_last")) / F.lit(1e6),
            "item_mean": F.coalesce(safe_ratio(F.col("item_s"), item), "global_mean"), "item_std": pop_std(item, F.col("item_s"), F.col("item_ss")),
            "item_count_30d": F.col("n30"), "item_mean_30d": safe_ratio(F.col("s30"), F.col("n30").cast("double")),
            "item_count_60d": F.col("n60"), "item_mean_60d": safe_ratio(F.col("s60"), F.col("n60").cast("double")), "user_genre_count": F.col("group_n"),
            "item_genres": F.coalesce(F.size("genres"), F.lit(0)), "item_year": F.col("release_year"), "item_year_missing": F.col("release_year").isNull(),
            "item_age_years": age_years(F.col("event_us"), F.col("release_year")),
        })
        mean = F.coalesce(safe_ratio(F.col("group_s"), F.col("group_n").cast("double")), "user_mean")
        e = window_ratios(e).withColumns({"user_genre_mean": mean, "user_genre_delta": mean - F.col("user_mean")})
        return e.drop("user_s", "user_ss", "user_last", "group_n", "group_s", "item_s", "item_ss", "n30", "s30", "n60", "s60")
