"""Checkpoints of state: versioned folders of tables with a JSON sidecar, bound to the history they come from.

The sidecar names the exclusive cutoff, the digest of exactly the events before it, the digest of the catalogue, and counts.
A resume checks both against what it is given, so an edited past is refused while later events may come and change;
``strict`` binds to the whole history as well.

The digest of the history is that of its stretches of ``BUCKET_US`` of time together. Theirs are stored beside the state, so a resume that is
refused names the first stretch that differs, and a checkpoint at a later cutoff adds those of the events since (``extend``) without a look at the rest.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import DAY_US
from ..sources.publish import SUMS, Files, digest_sums, identity, identity_of, stored, to_json, write_parquet
from .tables import KEEP_US, NAMES, State, advance, build, conservation, suffix_features

VERSION = 1
#: Stretches of time whose digests are kept apart.
BUCKET_US = 30 * DAY_US
FIELDS = {"version", "cutoff_us", "keep_us", "count", "total", "source", "catalog", "whole"}
EVENT = ["event_id", "user_id", "item_id", "rating", "event_us"]


def source_id(events: DataFrame, before_us: int | None = None) -> str:
    e = events if before_us is None else events.where(F.col("event_us") < before_us)
    return identity(e.select(*EVENT))


def history_sums(events: DataFrame, from_us: int | None, before_us: int) -> DataFrame:
    """``digest_sums`` of the events in [from, before) by stretch of time, stored."""
    e = events.where(F.col("event_us") < before_us)
    e = e if from_us is None else e.where(F.col("event_us") >= from_us)
    return stored(digest_sums(e, EVENT, F.floor(F.col("event_us") / BUCKET_US)), "digests")


def first_difference(old: DataFrame, new: DataFrame) -> int | None:
    """The start of the first stretch of time whose digests differ, in microseconds."""
    j = old.alias("a").join(new.alias("b"), "bucket", "full")
    same = F.lit(True)
    for c in SUMS:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    low = j.where(~same).agg(F.min("bucket")).first()[0]
    return None if low is None else low * BUCKET_US


def catalog_id(catalog: DataFrame) -> str:
    return identity(catalog.select("item_id", "release_year", F.array_join(F.array_sort("genres"), "|").alias("genres")))


def bridge_of(catalog: DataFrame) -> DataFrame:
    return catalog.select("item_id", F.explode("genres").alias("genre"))


def check_history(events: DataFrame) -> None:
    missing = F.col("event_us").isNull() | F.col("event_id").isNull() | F.col("rating").isNull()
    seen = events.groupBy("event_id").agg(F.count("*").alias("n"), F.count_if(missing).alias("bad"))
    most, bad = seen.agg(F.max("n"), F.sum("bad")).first()
    if bad:
        raise ValueError("events with missing ids, times or ratings")
    if (most or 0) > 1:
        raise ValueError("event ids repeat")


def _together(*jobs: Callable):
    """What the jobs give, run at once, as none of them fills a cluster; the first one's error in the order given counts."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def save(state: State, path: str, source: str, catalog: str, whole: str | None = None, digests: DataFrame | None = None) -> None:
    """Publishes a checkpoint under ``path``, which must not exist: staged beside it, verified there and renamed."""
    if not (state.windows and state.trusted):
        raise ValueError("a state without windows, or with ratings of unknown times, makes no checkpoint")
    spark = state.user.sparkSession
    files, stage = Files(spark, path), f"{path}.{uuid.uuid4().hex}.new"
    try:
        tables = {name: getattr(state, name) for name in NAMES} | ({} if digests is None else {"digests": digests})
        _together(*[partial(write_parquet, t, f"{stage}/{name}") for name, t in tables.items()])
        written = State(state.cutoff_us, state.count, state.total, *[spark.read.parquet(f"{stage}/{n}") for n in NAMES])
        if not conservation(written).first()["ok"]:
            raise ValueError("the state's sums disagree")
        side = {"version": VERSION, "cutoff_us": state.cutoff_us, "keep_us": KEEP_US, "count": state.count, "total": state.total, "source": source, "catalog": catalog, "whole": whole}
        files.write(f"{stage}/checkpoint.json", to_json(side))
        files.rename(stage, path)
    except BaseException:
        files.delete(stage)
        raise


def load(spark: SparkSession, path: str) -> tuple[State, dict]:
    """A checkpoint and its sidecar; unknown or missing fields, another version or a malformed digest raise ValueError."""
    try:
        side = json.loads(Files(spark, path).read(f"{path}/checkpoint.json"))
    except json.JSONDecodeError as e:
        raise ValueError("the sidecar isn't JSON") from e
    if not isinstance(side, dict) or set(side) != FIELDS:
        raise ValueError("the sidecar's fields differ")
    if side["version"] != VERSION or side["keep_us"] != KEEP_US:
        raise ValueError(f"version {side['version']} isn't {VERSION}")
    for k in ("source", "catalog"):
        if not isinstance(side[k], str) or not re.fullmatch(r"[0-9a-f]{64}", side[k]):
            raise ValueError(f"{k} is no digest")
    for k in ("cutoff_us", "count"):
        if isinstance(side[k], bool) or not isinstance(side[k], int):
            raise ValueError(f"{k} is no whole number")
    if side["count"] < 0:
        raise ValueError("count is negative")
    state = State(side["cutoff_us"], side["count"], float(side["total"]), *[spark.read.parquet(f"{path}/{n}") for n in NAMES])
    if not conservation(state).first()["ok"]:
        raise ValueError("the state's sums disagree")
    return state, side


def checkpoint(events: DataFrame, catalog: DataFrame, cutoff_us: int, path: str, strict: bool = False) -> None:
    """State and sidecar of the events before the cutoff."""
    _, sums, items, whole, state = _together(
        lambda: check_history(events), lambda: history_sums(events, None, cutoff_us), lambda: catalog_id(catalog), lambda: source_id(events) if strict else None,
        lambda: build(events, bridge_of(catalog), cutoff_us),
    )
    save(state, path, identity_of(sums, EVENT), items, whole, sums)


def extend(events: DataFrame, catalog: DataFrame, path: str, cutoff_us: int, to: str) -> None:
    """The checkpoint at a later cutoff under ``to``, from that under ``path`` and the events between, which alone are read.

    Events before the first cutoff are taken to be those that the checkpoint is bound to; a resume looks at all of them. A checkpoint that is bound
    to a whole history can't be extended.
    """
    state, side = load(events.sparkSession, path)
    if side["whole"] is not None or cutoff_us < state.cutoff_us:
        raise ValueError("the checkpoint is bound to a whole history" if side["whole"] is not None else "the cutoff is before the checkpoint's")
    new = events.where((F.col("event_us") >= state.cutoff_us) & (F.col("event_us") < cutoff_us))
    _, sums, items = _together(lambda: check_history(new), lambda: history_sums(new, state.cutoff_us, cutoff_us), lambda: catalog_id(catalog))
    if side["catalog"] != items:
        raise ValueError("the catalogue differs")
    old = digests_of(events.sparkSession, path)
    if old is None:
        raise ValueError("the checkpoint has no digests by stretch of time")
    both = old.unionByName(sums).groupBy("bucket").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in SUMS])
    save(advance(state, new, bridge_of(catalog), cutoff_us), to, identity_of(both, EVENT), items, None, both)


def digests_of(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored digests by stretch of time; None in checkpoints of before they were kept."""
    return spark.read.parquet(f"{path}/digests") if Files(spark, path).exists(f"{path}/digests") else None


def resume(events: DataFrame, catalog: DataFrame, path: str) -> State:
    """The checkpoint's state, once its digests match the history before its cutoff and the catalogue."""
    state, side = load(events.sparkSession, path)
    _, sums, items, whole = _together(
        lambda: check_history(events), lambda: history_sums(events, None, state.cutoff_us), lambda: catalog_id(catalog), lambda: None if side["whole"] is None else source_id(events),
    )
    if side["source"] != identity_of(sums, EVENT):
        old = digests_of(events.sparkSession, path)
        at = None if old is None else first_difference(old, sums)
        raise ValueError("the history before the cutoff differs" + ("" if at is None else f", first in the stretch from {at}"))
    if side["catalog"] != items:
        raise ValueError("the catalogue differs")
    if side["whole"] != whole:
        raise ValueError("the whole history differs")
    return state


def replay(state: State, events: DataFrame, catalog: DataFrame, to_us: int | None = None) -> tuple[DataFrame, State | None]:
    """Features of the events in [state's cutoff, to), and the state there; with ``to`` open, features alone."""
    e = events if to_us is None else events.where(F.col("event_us") < to_us)
    found = suffix_features(state, e, catalog)
    return found, None if to_us is None else advance(state, events, bridge_of(catalog), to_us)


def timestamp_batches(events: DataFrame) -> DataFrame:
    """(ordinal, event_us, n, first_id): the batches of equal timestamps, numbered from 0 in order of time.

    A row a timestamp; numbers run through time buckets, whose sizes are a small table.
    """
    from pyspark.sql import Window as W

    from ..functions.scalars import DAY_US

    t = events.groupBy("event_us").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).withColumn("__b", F.floor(F.col("event_us") / (30 * DAY_US)))
    sizes = t.groupBy("__b").agg(F.count("*").alias("k"))
    sizes = sizes.select("__b", F.coalesce(F.sum("k").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("k0"))
    t = t.withColumn("k1", F.row_number().over(W.partitionBy("__b").orderBy("event_us")) - 1)
    return t.join(sizes, "__b").select((F.col("k0") + F.col("k1")).cast("long").alias("ordinal"), "event_us", "n", "first_id")
