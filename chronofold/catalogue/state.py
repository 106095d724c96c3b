"""Queries of state, replay and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..plans.features import blocks
from ..schemas import contract
from ..sources.publish import scratch
from ..state import checkpoints, tables
from ..views import with_views
from . import query
from .history import _BASE, _COLUMNS17, _JOINS, _as_double

CUT = "1999-03-01"
CUT_US = 920_246_400_000_000


@query(with_views("re", """
, t AS (SELECT event_us, count(*) AS n, min(event_id) AS first_id FROM re GROUP BY event_us) SELECT row_number() OVER (ORDER BY event_us) - 1 AS ordinal, event_us, n, first_id FROM t"""))  # fmt: skip
def timestamp_batches(spark, sf):
    return checkpoints.timestamp_batches(views.events(spark, sf))


@query(with_views("re br", f"""
, p AS (SELECT * FROM re WHERE ts < TIMESTAMP '{CUT}')
SELECT 'user' AS kind, CAST(user_id AS VARCHAR) AS key, count(*) AS n, sum(rating) AS s, max(event_us) AS last_us FROM p GROUP BY user_id
UNION ALL SELECT 'item', CAST(item_id AS VARCHAR), count(*), sum(rating), NULL FROM p GROUP BY item_id
UNION ALL SELECT 'group', user_id || '/' || genre, count(*), sum(rating), NULL FROM p JOIN br USING (item_id) GROUP BY user_id, genre
UNION ALL SELECT 'recent', item_id || '/' || event_us, count(*), sum(rating), event_us FROM p WHERE ts >= TIMESTAMP '{CUT}' - INTERVAL 60 DAY GROUP BY item_id, event_us
UNION ALL SELECT 'all', '', count(*), sum(rating), NULL FROM p"""))  # fmt: skip
def state_snapshot_asof(spark, sf):
    s = tables.build(views.events(spark, sf), views.bridge(spark, sf), CUT_US)
    none = F.lit(None).cast("long").alias("last_us")
    text = lambda c: F.col(c).cast("string").alias("key")
    out = s.user.select(F.lit("user").alias("kind"), text("user_id"), "n", "s", F.col("event_us").alias("last_us"))
    out = out.unionByName(s.item.groupBy("item_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select(F.lit("item").alias("kind"), text("item_id"), "n", "s", none))
    out = out.unionByName(s.group.select(F.lit("group").alias("kind"), F.concat_ws("/", F.col("user_id").cast("string"), "genre").alias("key"), "n", "s", none))
    recent = s.item.where(F.col("event_us") != tables.OLD)
    out = out.unionByName(recent.select(F.lit("recent").alias("kind"), F.concat_ws("/", F.col("item_id").cast("string"), F.col("event_us").cast("string")).alias("key"), "n", "s", F.col("event_us").alias("last_us")))
    whole = spark.createDataFrame([("all", "", s.count, s.total, None)], "kind string, key string, n long, s double, last_us long")
    return out.unionByName(whole)


@query(with_views("re", f"""
SELECT count(*) AS user_n, sum(rating) AS user_s, count(*) AS item_n, sum(rating) AS item_s, count(*) FILTER (ts >= TIMESTAMP '{CUT}' - INTERVAL 60 DAY) AS recent_n, CAST(0 AS BIGINT) AS groups_over_user,
  count(*) AS n, sum(rating) AS s, true AS ok FROM re WHERE ts < TIMESTAMP '{CUT}'"""))  # fmt: skip
def state_conservation(spark, sf):
    """The state built in two steps."""
    e, b = views.events(spark, sf), views.bridge(spark, sf)
    half = tables.build(e, b, CUT_US - 400 * 86_400_000_000)
    return tables.conservation(tables.advance(half, e, b, CUT_US))


def _kept(spark, sf, root: str):
    """The events, written once: a checkpoint passes over them several times."""
    views.events(spark, sf).drop("ts").write.parquet(f"{root}/events")
    return spark.read.parquet(f"{root}/events")


def _columns():
    return ["event_id", "user_id", "item_id", "event_us", *[F.col(f.name).cast(f.kind).alias(f.name) for f in contract(17)]]


@query(with_views("re yr br", _BASE + f"SELECT {_COLUMNS17} {_JOINS} WHERE b.event_us >= {CUT_US}"))
def checkpoint_resume(spark, sf):
    """Features from the cutoff on, from a checkpoint that is saved, loaded, bound to its history and resumed."""
    root = scratch(spark)
    e, c, path = _kept(spark, sf, root), views.catalog(spark, sf), f"{root}/checkpoint"
    checkpoints.checkpoint(e, c, CUT_US, path)
    found, _ = checkpoints.replay(checkpoints.resume(e, c, path), e, c)
    return _as_double(found.select(*_columns()))


@query(with_views("re yr br", _BASE + f""", w AS (SELECT {_COLUMNS17} {_JOINS} WHERE b.event_us >= {CUT_US})
SELECT CAST(0 AS BIGINT) AS only_full, CAST(0 AS BIGINT) AS only_incremental, count(*) AS n, CAST(sum(user_count) AS BIGINT) AS user_counts,
  CAST(sum(user_genre_count) AS BIGINT) AS group_counts, CAST(sum(global_count) AS BIGINT) AS global_counts, round(sum(item_mean), 3) AS item_means FROM w"""))  # fmt: skip
def incremental_equals_full(spark, sf):
    """Rows that only the full plan, or only the resumed one, gives (none of either), and sums of the resumed one."""
    e, c = _kept(spark, sf, scratch(spark)), views.catalog(spark, sf)
    full = blocks(e, c).where(F.col("event_us") >= CUT_US).select(*_columns())
    some = tables.suffix_features(tables.build(e, checkpoints.bridge_of(c), CUT_US), e, c).select(*_columns())
    # both plans are run once: equal rows meet in one grouping, which has how many of them each plan gives
    n = lambda a, b: {"__a": F.lit(a), "__b": F.lit(b)}
    rows = full.withColumns(n(1, 0)).unionByName(some.withColumns(n(0, 1))).groupBy(*full.columns).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    zero, b = F.lit(0).cast("long"), F.col("__b")
    total = lambda c: F.sum(F.when(b > 0, F.col(c) * b)).cast("long")
    return rows.agg(
        F.coalesce(F.sum(F.greatest(F.col("__a") - b, zero)), zero).alias("only_full"), F.coalesce(F.sum(F.greatest(b - F.col("__a"), zero)), zero).alias("only_incremental"),
        F.coalesce(F.sum(b), zero).alias("n"), total("user_count").alias("user_counts"), total("user_genre_count").alias("group_counts"), total("global_count").alias("global_counts"),
        F.round(F.sum(F.when(b > 0, F.col("item_mean").cast("double") * b)), 3).alias("item_means"),
    )


@query(with_views("re yr br", _BASE + f"SELECT {_COLUMNS17} {_JOINS}"))
def stream_replay(spark, sf):
    """All events as a stream of files in order of time, some files splitting a timestamp."""
    from ..streaming.replay import StreamReplay

    root = scratch(spark)
    e = views.events(spark, sf).select("event_id", "user_id", "item_id", "rating", "event_us")
    stream = StreamReplay(spark, f"{root}/out", views.catalog(spark, sf))
    for part in _thirds(e):  # what has arrived is one micro-batch; the stream's own checkpoint says what is new
        part.write.mode("append").parquet(f"{root}/in")
        stream.run(f"{root}/in", files_a_batch=None, flush=False)
    stream.flush()
    return _as_double(stream.features().select(*_columns()))


@query(with_views("re yr br", _BASE + f"SELECT {_COLUMNS17} {_JOINS}"))
def stream_keyed_state(spark, sf):
    """All events as such a stream, with keyed state and timers."""
    from ..streaming.keyed import KeyedReplay

    root = scratch(spark)
    e = views.events(spark, sf).select("event_id", "user_id", "item_id", "rating", "event_us")
    stream = KeyedReplay(spark, f"{root}/out", views.catalog(spark, sf))
    for part in _thirds(e):
        part.write.mode("append").parquet(f"{root}/in")
        stream.run(f"{root}/in", files_a_batch=None)
    return _as_double(stream.features().select(*_columns()))


def _thirds(e):
    a, b = 883_612_800_000_000, 978_307_200_000_000  # two days inside the span; the second splits its own day
    return e.where(F.col("event_us") < a), e.where(f"event_us >= {a} AND (event_us < {b} OR event_us = {b} AND event_id % 2 = 0)"), e.where(f"event_us > {b} OR event_us = {b} AND event_id % 2 = 1")


@query(with_views("re", """
SELECT count(*) AS "rows", count(DISTINCT event_id) AS ids, min(event_us) AS first_us, max(event_us) AS last_us, '' AS broken, min(event_id) AS first_id, max(event_id) AS last_id,
  count(event_id) - count(DISTINCT event_id) AS repeats, count(*) - count(event_id) AS without_id,
  count(DISTINCT event_id) = count(*) AND min(event_id) = 1 AND max(event_id) = count(*) AS complete FROM re"""))  # fmt: skip
def artifact_audit(spark, sf):
    from ..operators.artifacts import artifact_audit as audit
    from ..plans.features import feature_table

    return audit(feature_table(views.events(spark, sf), views.catalog(spark, sf), version=17), contract(17))


@query(with_views("re", "SELECT count(*) FILTER (rating < 2) AS only_a, count(*) FILTER (rating >= 4) AS only_b FROM re"))
def artifact_difference(spark, sf):
    """All events but the best against all events but the worst."""
    from ..operators.artifacts import table_difference

    e = views.events(spark, sf)
    return table_difference(e.where("rating < 4"), e.where("rating >= 2"))


@query(with_views("re", "SELECT count(*) FILTER (rating < 2) AS only_a, count(*) FILTER (rating >= 4) AS only_b, CAST(0 AS BIGINT) AS repeats_a, count(*) FILTER (rating = 3) AS repeats_b FROM re"))
def artifact_id_difference(spark, sf):
    """The ids of all events but the best, and those of all but the worst with some twice, as bitmaps."""
    from ..operators.artifacts import id_difference

    e = views.events(spark, sf)
    return id_difference(e.where("rating < 4"), e.where("rating >= 2").unionByName(e.where("rating = 3")))
