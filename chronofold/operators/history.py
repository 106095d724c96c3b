"""Strict-prior history by windows.

All frames order by whole microseconds and end one before the row's own time, so equal timestamps never see each other.
A rolling count over [t - w, t) is the difference of two growing frames, one up to t - 1 and one up to t - w - 1: each row
enters each frame once, where a bounded frame would add its rows up anew for each. Sums of half stars are exact, so the
difference is too.

Every function adds columns to the events it gets, so what is partitioned by a key stays so for the next block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import DAY_US, check_window_us, pop_std, safe_ratio
from ..sources.publish import stored
from .buckets import BUCKET, bucketed, carried, hot_keys, over_buckets, small

__all__ = ["BUCKET", "hot_keys", "over_buckets"]

# Fixed value: the global mean where there is no history.
COLD_START = 3.5
#: Width of the time buckets of the global history, an hour: 20 years are 175,320 of them, whatever the number of events.
BUCKET_US = DAY_US // 24
#: Rolling windows of an item.
WINDOWS = {"30d": 30 * DAY_US, "60d": 60 * DAY_US}


def prior(*key: str, upto: int = -1):
    return W.partitionBy(*key).orderBy("event_us").rangeBetween(W.unboundedPreceding, upto)


def global_times(events: DataFrame, bucket_us: int = BUCKET_US, count: int = 0, total: float = 0.0) -> tuple[DataFrame, bool]:
    """(__t, global_count, global_mean) by timestamp, stored, and whether they are few enough to be broadcast, which they then are.

    Events are summed by timestamp before any shuffle; a timestamp sees the totals of the earlier buckets of time (a row a
    bucket) and of the earlier timestamps of its own, so no task sees all events. ``count`` and ``total`` are of ratings before all events.
    """
    t = events.groupBy("event_us").agg(F.count("*").alias("__n"), F.sum("rating").alias("__s")).withColumn("__b", F.floor(F.col("event_us") / bucket_us))
    totals = t.groupBy("__b").agg(F.sum("__n").alias("n"), F.sum("__s").alias("s"))
    before, zero = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1), F.lit(0.0)
    totals = totals.select("__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("s").over(before), zero).alias("__s0"))
    w = prior("__b")
    t = t.select("event_us", "__b", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__n1"), F.coalesce(F.sum("__s").over(w), zero).alias("__s1")).join(totals, "__b")
    n, s = F.col("__n0") + F.col("__n1") + F.lit(count), F.col("__s0") + F.col("__s1") + F.lit(float(total))
    t = stored(t.select(F.col("event_us").alias("__t"), n.alias("global_count"), F.coalesce(safe_ratio(s, n.cast("double")), F.lit(COLD_START)).alias("global_mean")), "global-history")
    found = small(t)
    return found, found is not t


def at_times(events: DataFrame, times: DataFrame) -> DataFrame:
    """Adds what ``global_times`` has."""
    return events.join(times, F.col("event_us").eqNullSafe(F.col("__t")), "left").drop("__t")


def global_history(events: DataFrame, bucket_us: int = BUCKET_US, count: int = 0, total: float = 0.0) -> DataFrame:
    """Adds global_count and global_mean; ``count`` and ``total`` are of ratings before all events."""
    return at_times(events, global_times(events, bucket_us, count, total)[0])


def _plus(before: str, own):
    return F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0))


def user_history(events: DataFrame, hot: DataFrame | None = None, buckets: bool = False) -> DataFrame:
    """Adds user_count, user_mean (NULL when empty), user_std and user_recency_s; ``hot`` as from ``hot_keys``, and with
    ``buckets`` the columns ``BUCKET`` stay."""
    if hot is not None:
        e, r = bucketed(events, "user_id", hot), F.col("rating")
        before = carried(e, ["user_id"], {"n": F.count("*"), "s": F.sum(r), "ss": F.sum(r * r), "last": F.max("event_us")})
        w = prior("user_id", "__b")
        e = e.withColumns({"__n1": F.count("*").over(w), "__s1": F.sum(r).over(w), "__ss1": F.sum(r * r).over(w), "__last1": F.max("event_us").over(w)})
        e = e.join(before, ["user_id", "__b"], "left").withColumns({
            "user_count": _plus("__0n", "__n1"), "__s": _plus("__0s", "__s1"), "__ss": _plus("__0ss", "__ss1"), "__top": F.greatest("__0last", "__last1"),
        })
        return _user_columns(e.select(*events.columns, *(BUCKET if buckets else []), "user_count", "__s", "__ss", F.col("__top").alias("__last_us")))
    return _user_columns(_user_sums(events))


def _user_sums(events: DataFrame) -> DataFrame:
    w = prior("user_id")
    return events.withColumns({
        "user_count": F.count("*").over(w), "__s": F.sum("rating").over(w), "__ss": F.sum(F.col("rating") * F.col("rating")).over(w), "__last_us": F.max("event_us").over(w),
    })


def _user_columns(e: DataFrame) -> DataFrame:
    n = F.col("user_count").cast("double")
    return e.withColumns({
        "user_mean": safe_ratio(F.col("__s"), n), "user_std": pop_std(n, F.col("__s"), F.col("__ss")),
        "user_recency_s": (F.col("event_us") - F.col("__last_us")) / F.lit(1e6),
    }).drop("__s", "__ss", "__last_us")


def item_history(events: DataFrame, windows: dict[str, int] | None = None, hot: DataFrame | None = None, buckets: bool = False) -> DataFrame:
    """Adds item_count, item_mean, item_std, and item_count_{w}, item_mean_{w} of rolling windows, all in one pass by item;
    ``hot`` as from ``hot_keys``, and with ``buckets`` the columns ``BUCKET`` stay."""
    windows = WINDOWS if windows is None else windows
    return item_columns(item_sums(events, windows, hot, buckets), windows)


def item_sums(events: DataFrame, windows: dict[str, int] | None = None, hot: DataFrame | None = None, buckets: bool = False) -> DataFrame:
    """Adds the counts and sums that ``item_columns`` makes ``item_history`` of: small whole and half numbers, which a shuffle packs better than means."""
    windows = WINDOWS if windows is None else windows
    if hot is not None:
        kept = [*events.columns, *(BUCKET if buckets else [])]
        gone = {f"__gone_{k}": F.col("event_us") + F.lit(check_window_us(n)) for k, n in windows.items()}
        return _item_buckets(bucketed(events, "item_id", hot, **gone), windows, kept)
    return _item_sums(events, windows)


def _item_buckets(e: DataFrame, windows: dict[str, int], kept: list[str]) -> DataFrame:
    """``kept`` and what ``_item_sums`` adds, of events with their buckets of time, in one shuffle of them.

    An event leaves a window of length w after event_us + w. Where that lies in a later bucket (__gone_{window}), a row that says so
    goes there: one an event and window at most, whatever the width of a bucket.
    """
    us, name = F.col("event_us"), F.col("__x.name")
    gone = {k: F.col(f"__gone_{k}") for k in windows}
    rows = [F.struct(F.lit(None).cast("string").alias("name"), F.col("__b").alias("b"), us.alias("at"))]
    rows += [
        F.when((b > F.col("__b")) & (b <= F.col("__last")), F.struct(F.lit(k).alias("name"), b.alias("b"), (us + F.lit(windows[k])).alias("at")))
        for k, b in gone.items()
    ]
    x = e.withColumn("__x", F.explode(F.array_compact(F.array(*rows))))
    # a row of its own, or one of leaving a window later on; __here_{k}: leaves window k in this very bucket
    here = {f"__here_{k}": F.when(name.isNull(), b == F.col("__b")).otherwise(name == k) for k, b in gone.items()}
    wide = [F.when(name.isNull(), F.col(c)).alias(c) for c in kept if c not in ("item_id", "rating", "__b", "__last")]
    x = x.select("item_id", "rating", "__last", *wide, F.col("__x.b").alias("__b"), F.col("__x.at").alias("__at"), name.alias("__name"), *[c.alias(k) for k, c in here.items()])
    own, r = F.col("__name").isNull(), F.col("rating")
    n, s, ss = own.cast("long"), F.when(own, r).otherwise(0.0), F.when(own, r * r).otherwise(0.0)
    sums = {"n": F.sum(n), "s": F.sum(s), "ss": F.sum(ss)}
    for k in windows:
        leaves = F.coalesce(F.col(f"__here_{k}"), F.lit(False))
        sums |= {f"n_{k}": F.sum(leaves.cast("long")), f"s_{k}": F.sum(F.when(leaves, r).otherwise(0.0))}
    before_b = carried(x, ["item_id"], sums)
    w = W.partitionBy("item_id", "__b").orderBy("__at")
    before = w.rangeBetween(W.unboundedPreceding, -1)
    new = {"__1n": F.sum(n).over(before), "__1s": F.sum(s).over(before), "__1ss": F.sum(ss).over(before)}
    for k, width in windows.items():
        out, other = w.rangeBetween(W.unboundedPreceding, -width - 1), F.col("__name") == k
        new[f"__1n_{k}"] = F.coalesce(F.sum(n).over(out), F.lit(0)) + F.coalesce(F.sum(F.when(other, 1)).over(before), F.lit(0))
        new[f"__1s_{k}"] = F.coalesce(F.sum(s).over(out), F.lit(0.0)) + F.coalesce(F.sum(F.when(other, r)).over(before), F.lit(0.0))
    x = x.withColumns(new).where(own).join(before_b, ["item_id", "__b"], "left")
    return x.select(*kept, *[_plus(f"__0{k}", f"__1{k}").alias("item_count" if k == "n" else f"__{k}") for k in sums])


def _item_sums(events: DataFrame, windows: dict[str, int]) -> DataFrame:
    w = prior("item_id")
    new = {"item_count": F.count("*").over(w), "__s": F.sum("rating").over(w), "__ss": F.sum(F.col("rating") * F.col("rating")).over(w)}
    for name, us in windows.items():
        out = prior("item_id", upto=-check_window_us(us) - 1)
        new |= {f"__n_{name}": F.count("*").over(out), f"__s_{name}": F.coalesce(F.sum("rating").over(out), F.lit(0.0))}
    return events.withColumns(new)


def item_columns(e: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    windows = WINDOWS if windows is None else windows
    n = F.col("item_count").cast("double")
    more = {"item_mean": safe_ratio(F.col("__s"), n), "item_std": pop_std(n, F.col("__s"), F.col("__ss"))}
    for name in windows:
        count = F.col("item_count") - F.col(f"__n_{name}")
        total = F.coalesce("__s", F.lit(0.0)) - F.col(f"__s_{name}")
        more |= {f"item_count_{name}": count, f"item_mean_{name}": safe_ratio(total, count.cast("double"))}
    return e.withColumns(more).drop("__s", "__ss", *[f"__{k}_{name}" for name in windows for k in ("n", "s")])


def window_ratios(events: DataFrame, short: str = "30d", long: str = "60d") -> DataFrame:
    """Adds item_mean_ratio, of means rounded to 32 bits first, and item_count_ratio."""
    a, b = F.col(f"item_mean_{short}").cast("float"), F.col(f"item_mean_{long}").cast("float")
    ratio = (a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))).cast("float")
    n = safe_ratio(F.col(f"item_count_{short}").cast("double"), F.col(f"item_count_{long}").cast("double")).cast("float")
    return events.withColumns({"item_mean_ratio": ratio, "item_count_ratio": n})


def group_affinity(events: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Adds user_genre_count and user_genre_mean: the user's earlier ratings of the target's genres, a row an association.

    ``events`` has ``genres`` (array), which goes, event_id and user_mean, as ``user_history`` gives it. The shuffle by user that its window
    made serves the exploded windows by (user, genre), and the grouping by (user, event) back to one row an event; ``hot``
    as from ``hot_keys`` of the users.
    """
    by = ["user_id"]
    if hot is not None:
        by = ["user_id", "__b"]
        events = events if "__b" in events.columns else bucketed(events, "user_id", hot)
        x = events.select("user_id", "__b", "__last", "rating", F.explode("genres").alias("__g"))
        before = carried(x, ["user_id", "__g"], {"n": F.count("*"), "s": F.sum("rating")})
        # a row a user and bucket, so that events stay where they are
        before = before.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__g", F.struct(F.col("__0n").alias("n"), F.col("__0s").alias("s"))))).alias("__of"))
        events = events.join(before, by, "left")
        summed = lambda k, zero: F.coalesce(F.aggregate("genres", zero, lambda a, g: a + F.coalesce(F.col("__of")[g][k], zero)), zero)
        events = events.withColumns({"__0n": summed("n", F.lit(0).cast("long")), "__0s": summed("s", F.lit(0.0))}).drop("__of", "__last")
    # plain columns alone, as an array would have each row of a genre sorted for the grouping
    others = [c for c in events.columns if c not in (*by, "event_id", "genres")]
    e = events.select(*by, "event_id", *others, F.explode_outer("genres").alias("__g"))
    w = prior(*by, "__g")
    e = e.withColumns({"__n": F.when(F.col("__g").isNotNull(), F.count("*").over(w)), "__s": F.when(F.col("__g").isNotNull(), F.sum("rating").over(w))})
    back = e.groupBy(*by, "event_id").agg(*[F.first(c).alias(c) for c in others], F.coalesce(F.sum("__n"), F.lit(0)).alias("user_genre_count"), F.sum("__s").alias("__s"))
    if hot is not None:
        back = back.withColumns({"user_genre_count": F.col("user_genre_count") + F.col("__0n"), "__s": F.col("__0s") + F.coalesce("__s", F.lit(0.0))}).drop("__0n", "__0s", "__b")
    mean = safe_ratio(F.col("__s"), F.col("user_genre_count").cast("double"))
    return back.withColumn("user_genre_mean", F.coalesce(mean, "user_mean")).drop("__s")
