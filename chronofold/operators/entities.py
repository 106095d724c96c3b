"""Canonical entities: users, items, groups, their bridge, and rating events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import release_year
from ..sources.publish import stored
from .validate import NO_GENRE, check_references, duplicate_keys, genre_faults


def users(ratings: DataFrame, activity: DataFrame) -> DataFrame:
    """(user_id, ts) of ratings and of other activity to user_id, first_observed, first_rating (NULL without a rating)."""
    first = ratings.groupBy("user_id").agg(F.min("ts").alias("first_rating"))
    other = activity.groupBy("user_id").agg(F.min("ts").alias("first_rating"))
    # each side is aggregated before the union, so the union holds a row a user and side
    seen = first.unionByName(other).groupBy("user_id").agg(F.min("first_rating").alias("first_observed"))
    return seen.join(first, "user_id", "left").select("user_id", "first_observed", "first_rating")


def items(raw: DataFrame, links: DataFrame, check: bool = True) -> DataFrame:
    """raw (item_id, title, genres) and links (item_id, imdb_id, tmdb_id) to canonical items, one row an item."""
    if check:
        for what, df in (("items", raw), ("links", links)):
            if some := duplicate_keys(df, ["item_id"]).limit(5).collect():
                raise ValueError(f"{what}: repeated item_id {[r[0] for r in some]}")
        if bad := genre_faults(raw).limit(5).collect():
            raise ValueError(f"items: malformed genres {[tuple(r) for r in bad]}")
    status = F.when(F.col("genres") == NO_GENRE, "missing_in_source").otherwise("listed")
    base = raw.select("item_id", "title", release_year("title").alias("release_year"), status.alias("genre_status"))
    return base.join(links.select("item_id", "imdb_id", "tmdb_id"), "item_id", "left")


def bridge(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("genres") != NO_GENRE).select("item_id", F.explode(F.split("genres", r"\|")).alias("genre")).distinct()


def groups(bridge: DataFrame) -> DataFrame:
    return bridge.select(F.col("genre").alias("genre_id"), F.col("genre").alias("genre_name")).distinct()


def rating_events(events: DataFrame, known_users: DataFrame, known_items: DataFrame) -> DataFrame:
    """Events with the target ``high`` (rating of 4 or more), after unique ids, domain and references are checked.

    The events are stored first: five jobs read them, and each would do anew what makes them.
    """
    events = stored(events, "events")
    bad = events.agg(
        F.count_if(F.col("event_id").isNull() | (F.col("event_id") < 1)).alias("ids"),
        F.count_if(~F.coalesce((F.col("rating") * 2).between(1, 10) & (F.col("rating") * 2 == F.floor(F.col("rating") * 2)), F.lit(False))).alias("ratings"),
        F.count_if(F.col("ts").isNull()).alias("times"),
    ).first()
    if any(bad):
        raise ValueError(f"rating events: {bad.asDict()}")
    if some := duplicate_keys(events, ["event_id"]).limit(5).collect():
        raise ValueError(f"rating events: repeated ids {[r[0] for r in some]}")
    check_references(events, known_users, "user_id", "rating events")
    check_references(events, known_items, "item_id", "rating events")
    return events.withColumn("high", target(F.col("rating")))


def target(rating):
    return rating >= 4.0
