"""Exploratory aggregates over events and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import safe_ratio
from ..sources.publish import stored
from .buckets import bucketed, hot_keys

#: Parts that the values of a feature are cut into for exact quantiles; a power of two.
CUTS = 256


def temporal_audit(events: DataFrame) -> DataFrame:
    """One row of the event log's size, span, ties and repetitions. Events: user_id, item_id, rating, ts.

    Equal rows are counted once; all other groupings are rolled up from those counts, whose shuffle they share.
    """
    rows = events.groupBy("user_id", "item_id", "rating", "ts").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    whole = rows.agg(
        F.coalesce(F.sum("n"), zero).alias("row_count"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
        F.coalesce(F.bool_and(F.date_trunc("second", F.col("ts")) == F.col("ts")), F.lit(True)).alias("whole_seconds"), F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicate_rows"),
    )
    by = lambda *keys: rows.groupBy(*keys).agg(F.sum("n").alias("n"))
    pairs = by("user_id", "item_id").agg(F.count_if(F.col("n") > 1).alias("repeated_pairs"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), zero).alias("rows_in_repeated_pairs"))
    times = by("ts").agg(F.count_if(F.col("n") > 1).alias("shared_timestamps"), F.max("n").alias("most_at_one_timestamp"))
    ties = by("user_id", "ts").groupBy("user_id").agg(F.max("n").alias("n")).agg(F.count("*").alias("users"), F.count_if(F.col("n") > 1).alias("users_with_ties"))
    kinds = by("item_id").agg(F.count("*").alias("items"))
    out = whole
    for part in (pairs, times, ties, kinds):  # one row each
        out = out.crossJoin(part)
    return out


def rate_by(events: DataFrame, label: Column, name: str) -> DataFrame:
    """Events, high ratings and their share by a label."""
    high = (F.col("rating") >= 4.0).cast("int")
    return events.groupBy(label.alias(name)).agg(F.count("*").alias("n"), F.sum(high).alias("high"), (F.sum(high) / F.count("*")).alias("rate"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """value, n and share of all."""
    g = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.crossJoin(total).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def activity_quantiles(events: DataFrame, key: str, qs: tuple[float, ...] = (0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1)) -> DataFrame:
    """(q, value) of events a key, and their mean as q NULL."""
    n = events.groupBy(key).agg(F.count("*").alias("n"))
    found = quantiles_of(n, "n", tuple(map(float, qs))).crossJoin(n.agg(F.avg("n").alias("mean")))  # a row each
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col("v")[k].alias("value")) for k, q in enumerate(qs)], F.struct(F.lit(None).cast("double").alias("q"), F.col("mean").alias("value")))
    return found.select(F.explode(pairs).alias("x")).select("x.q", "x.value")


def quantiles_of(df: DataFrame, column: str, q: tuple[float, ...]) -> DataFrame:
    """One row: v, the exact interpolated quantiles of a column, NULL without values; no task holds all values."""
    found = exact_quantiles(value_counts(df, [], [column]), ["feature"], q)
    return found.agg(F.max("quantiles").alias("v"))


def positions(events: DataFrame, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Events with their place among their user's, k from 0 in order of time, item and id, and the user's n; and (user_id, __b, start, end) of buckets.

    Users with over ``hot`` events (``buckets.HOT``) are numbered by bucket of time, from the number of events in earlier ones.
    """
    users = hot_keys(events, "user_id", hot)
    e = events.withColumn("__b", F.lit(0).cast("long")) if users is None else bucketed(events, "user_id", users).drop("__last")
    counts, all_ = e.groupBy("user_id", "__b").agg(F.count("*").alias("c")), W.partitionBy("user_id")
    start = F.coalesce(F.sum("c").over(all_.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = counts.select("user_id", "__b", start.alias("start"), F.sum("c").over(all_).alias("n"), (start + F.col("c")).alias("end"))
    k = F.row_number().over(W.partitionBy("user_id", "__b").orderBy("event_us", "item_id", "event_id")) - 1
    e = e.withColumn("k", k).join(spans.select("user_id", "__b", "start", "n"), ["user_id", "__b"])
    return e.withColumn("k", F.col("k") + F.col("start")).drop("start"), spans


def early_late(events: DataFrame, early: float = 0.3, late: float = 0.7, hot: int | None = None) -> DataFrame:
    """By user: n, early and late counts and high rates, delta. Rank by time, then item, from 0, over the number of events.

    This is analysis: the tie-break by item must not enter a feature.
    """
    ranked, _ = positions(events.select("user_id", "item_id", "event_id", "event_us", "rating"), hot)
    at, high = F.col("k") / F.col("n"), (F.col("rating") >= 4.0).cast("double")
    g = ranked.groupBy("user_id").agg(
        F.max("n").alias("n"), F.count_if(at < early).alias("n_early"), F.count_if(at >= late).alias("n_late"),
        F.avg(F.when(at < early, high)).alias("early_rate"), F.avg(F.when(at >= late, high)).alias("late_rate"),
    )
    return g.withColumn("delta", F.col("late_rate") - F.col("early_rate"))


def drift_summary(drift: DataFrame, rules: tuple[tuple[int, int], ...] = ((20, 5), (50, 10), (100, 15))) -> DataFrame:
    """For each (least events, least of a segment): users and moments, quantiles and large shares of the delta."""
    x = F.col("delta")
    one = drift.where("delta IS NOT NULL").select("n", "n_early", "n_late", "delta", F.explode(F.array(*[F.struct(F.lit(a).alias("least"), F.lit(b).alias("segment")) for a, b in rules])).alias("r"))
    one = one.select("*", "r.least", "r.segment").where("n >= least AND n_early >= segment AND n_late >= segment")
    share = lambda t: 100 * F.avg((F.abs(x) >= t).cast("double"))
    found = one.groupBy("least", "segment").agg(
        F.count("*").alias("users"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        share(0.05).alias("pct_over_05"), share(0.1).alias("pct_over_10"), share(0.2).alias("pct_over_20"),
    )
    by, q = ["least", "segment"], {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9}
    at = exact_quantiles(one.groupBy(*by, x.alias("x")).agg(F.count("*").alias("c")), by, tuple(q.values()))
    found = found.join(at.select(*by, *[F.col("quantiles")[k].alias(n) for k, n in enumerate(q)]), by)
    return found.select(*by, "users", "mean", "median", "std", "p10", "p25", "p75", "p90", "pct_over_05", "pct_over_10", "pct_over_20")


ACTIVITY = (0, 20, 50, 100, 200, 500)


def activity_bin(n: Column, edges: tuple[int, ...] = ACTIVITY) -> Column:
    """Left-closed bins [a, b), the last one open; named by their lower edge."""
    out = F.lit(edges[0])
    for e in edges[1:]:
        out = F.when(n >= e, F.lit(e)).otherwise(out)
    return out


def drift_by_activity(drift: DataFrame) -> DataFrame:
    d = drift.where("delta IS NOT NULL").withColumn("from_n", activity_bin(F.col("n")))
    medians = exact_quantiles(d.groupBy("from_n", F.abs("delta").alias("x")).agg(F.count("*").alias("c")), ["from_n"], (0.5,))
    found = d.groupBy("from_n").agg(F.count("*").alias("users"), F.avg("delta").alias("mean"))
    return found.join(medians.select("from_n", F.col("quantiles")[0].alias("median_abs")), "from_n")


def rolling_rate(events: DataFrame, rows: int = 50, hot: int | None = None) -> DataFrame:
    """Mean high rate of the last ``rows`` events of a user, the current one included; NULL below max(10, rows / 5).

    Users with over ``hot`` events (``buckets.HOT``) are cut into buckets of time. A bucket gets the last ``rows`` - 1 values before it in one
    row, so events are shuffled once by user and bucket. They are stored first, as they are read several times.
    """
    e = stored(events.select("user_id", "item_id", "event_id", "event_us", (F.col("rating") >= 4.0).alias("high")), "events")
    users = hot_keys(e, "user_id", hot)
    e = e.withColumn("__b", F.lit(0).cast("long")) if users is None else bucketed(e, "user_id", users).drop("__last")
    e, by, order = e.repartition("user_id", "__b"), W.partitionBy("user_id", "__b"), ["event_us", "item_id", "event_id"]
    before = None
    if users is not None and rows > 1:
        # from the latest on; as no bucket is empty, rows - 1 earlier ones have all that is asked for
        last = e.withColumn("__d", F.row_number().over(by.orderBy(*[F.desc(c) for c in order]))).where(F.col("__d") < rows)
        # keys as aggregates, lest the join's filter of NULL keys go below the shuffle, which then couldn't serve both sides
        last = last.groupBy("user_id", "__b").agg(F.max("user_id").alias("__user"), F.max("__b").alias("__to"), F.sort_array(F.collect_list(F.struct("__d", "high"))).alias("__last"))
        earlier = F.flatten(F.collect_list("__last").over(W.partitionBy("__user").orderBy(F.desc("__to")).rowsBetween(1, rows - 1)))
        before = last.select(F.col("__user").alias("user_id"), F.col("__to").alias("__b"), F.transform(F.slice(earlier, 1, rows - 1), lambda x: x["high"]).alias("__before"))
    w, k = by.orderBy(*order), F.col("__k")
    e = e.withColumns({"__k": F.row_number().over(w), "__n": F.count("high").over(w.rowsBetween(1 - rows, 0)), "__s": F.coalesce(F.sum(F.col("high").cast("long")).over(w.rowsBetween(1 - rows, 0)), F.lit(0))})
    all_, n, s = F.least(k, F.lit(rows)), F.col("__n"), F.col("__s")
    if before is not None:
        taken = F.slice(F.coalesce("__before", F.array().cast("array<boolean>")), F.lit(1), F.greatest(F.lit(rows) - k, F.lit(0)))
        e = e.join(before, ["user_id", "__b"], "left").withColumn("__taken", taken)
        all_, n, s = all_ + F.size("__taken"), n + F.size(F.filter("__taken", lambda x: x.isNotNull())), s + F.size(F.filter("__taken", lambda x: x))
    rate = F.when(all_ >= max(10, rows // 5), safe_ratio(s.cast("double"), n.cast("double")))
    return e.select("user_id", "event_id", rate.alias("rate"))


def examples(drift: DataFrame, least: int = 20) -> DataFrame:
    """The users of the largest fall, the largest rise and the smallest change; ties go to the smaller id."""
    d = drift.where((F.col("n") >= least) & F.col("delta").isNotNull())
    return d.agg(
        F.min_by("user_id", F.struct("delta", "user_id")).alias("fall"), F.min_by("user_id", F.struct(-F.col("delta"), F.col("user_id"))).alias("rise"),
        F.min_by("user_id", F.struct(F.abs("delta"), F.col("user_id"))).alias("stable"),
    )


def nearest_to_median(n: DataFrame, key: str, column: str) -> DataFrame:
    """The row whose value is nearest the median; ties go to the smaller key."""
    m = quantiles_of(n, column, (0.5,)).select(F.col("v")[0].alias("__m"))
    return n.crossJoin(m).orderBy(F.abs(F.col(column) - F.col("__m")), key).limit(1).drop("__m")


def item_stats(events: DataFrame) -> DataFrame:
    high = (F.col("rating") >= 4.0).cast("int")
    return events.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("rating").alias("total"), F.sum(high).alias("high"), F.avg("rating").alias("mean"), F.avg(high).alias("rate"))


def group_structure(catalog: DataFrame) -> DataFrame:
    """How many items have one, several and no groups."""
    k = F.size("genres")
    label = F.when(k == 0, "none").when(k == 1, "single").otherwise("multi")
    g = catalog.groupBy(label.alias("structure")).agg(F.count("*").alias("items"))
    return g.crossJoin(g.agg(F.sum("items").alias("total"))).select("structure", "items", (100 * F.col("items") / F.col("total")).alias("pct"))


def group_coverage(bridge: DataFrame, catalog: DataFrame) -> DataFrame:
    total = catalog.agg(F.count("*").alias("total"))
    g = bridge.groupBy("genre").agg(F.count_distinct("item_id").alias("items"))
    return g.crossJoin(total).select("genre", "items", (100 * F.col("items") / F.col("total")).alias("pct"))


def group_summary(events: DataFrame, bridge: DataFrame, catalog: DataFrame) -> DataFrame:
    """By group: items, rated items, ratings, weighted mean and rate, median of item means. Items are aggregated before
    the bridge multiplies them."""
    s = bridge.join(item_stats(events), "item_id", "left")
    g = s.groupBy("genre").agg(
        F.count("*").alias("items"), F.count("n").alias("rated_items"), F.coalesce(F.sum("n"), F.lit(0)).alias("ratings"),
        (F.sum("total") / F.sum("n")).alias("mean"), (F.sum("high") / F.sum("n")).alias("rate"),
    )
    medians = exact_quantiles(s.where("mean IS NOT NULL").groupBy("genre", F.col("mean").alias("x")).agg(F.count("*").alias("c")), ["genre"], (0.5,))
    g = g.join(medians.select("genre", F.col("quantiles")[0].alias("median_item_mean")), "genre", "left")
    return g.crossJoin(catalog.agg(F.count("*").alias("total"))).withColumn("coverage_pct", 100 * F.col("items") / F.col("total")).drop("total")


def _moments(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """by, feature, n, missing_pct, mean, std, min, max: one aggregate of all columns, nothing is stacked before it."""
    one = df.groupBy(*by).agg(*[
        F.struct(
            F.count(x).alias("n"), (100 * F.avg(x.isNull().cast("double"))).alias("missing_pct"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        ).alias(n) for n, x in ((n, F.col(n).cast("double")) for n in names)
    ])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in names])).alias("r")
    return one.select(*by, rows).select(*by, "r.feature", "r.v.*")


def value_counts(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """by, feature, x, c: how often each value of each column is there, NULL left out; summed before the shuffle."""
    stacked = df.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names])).alias("s"))
    return stacked.select(*by, "s.feature", "s.x").where("x IS NOT NULL").groupBy(*by, "feature", "x").agg(F.count("*").alias("c"))


def exact_quantiles(counts: DataFrame, by: list[str], q: tuple[float, ...]) -> DataFrame:
    """by, quantiles, distinct: exact interpolated quantiles of x with counts c, and how many values there are. ``by`` has few
    groups, features or classes, whose cuts are broadcast.

    Values are cut at ``CUTS`` approximate quantiles; the parts' sums say in which of them the wanted ranks lie, and only
    these are ordered, each in a task of its own. So no task holds the values of a group.
    """
    points = F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)])
    cuts = counts.groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile_approx("x", points, F.lit(20 * CUTS)))).alias("cuts"), F.sum("c").alias("n"), F.count("*").alias("distinct"))
    # the number of cuts at or below x, by halving
    low = F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in range(CUTS.bit_length() - 1, -1, -1)])
    at = lambda i, step: F.when(F.coalesce(F.get(F.col("cuts"), i + step - 1) <= F.col("x"), F.lit(False)), i + step).otherwise(i)
    parts = counts.join(F.broadcast(cuts.select(*by, "cuts")), by).withColumn("part", F.aggregate(steps, low, at)).drop("cuts")
    sums = parts.groupBy(*by, "part").agg(F.sum("c").alias("k"))
    before = W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("below", F.coalesce(F.sum("k").over(before), F.lit(0))).join(cuts.select(*by, "n", "distinct"), by)
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(v) * (F.col("n") - 1)).alias("at")) for i, v in enumerate(q)])).alias("w")
    wanted = sums.select(*by, "part", "k", "below", "n", "distinct", place).select("*", "w.*").drop("w")
    # a rank's part holds the value at floor(at), that at ceil(at), or both
    has = (F.col("below") <= F.ceil("at")) & (F.floor("at") < F.col("below") + F.col("k"))
    some = wanted.where(has).groupBy(*by, "part", "below").agg(F.collect_list(F.struct("i", "at")).alias("ws"))
    inside = W.partitionBy(*by, "part").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    ranked = parts.join(F.broadcast(some), [*by, "part"]).withColumn("first", F.col("below") + F.coalesce(F.sum("c").over(inside), F.lit(0)))
    hit = ranked.select(*by, "x", "c", "first", F.explode("ws").alias("w")).select(*by, "x", "w.i", "w.at", "first", (F.col("first") + F.col("c") - 1).alias("last"))
    lower = F.max(F.when((F.col("first") <= F.floor("at")) & (F.floor("at") <= F.col("last")), F.col("x")))
    upper = F.max(F.when((F.col("first") <= F.ceil("at")) & (F.ceil("at") <= F.col("last")), F.col("x")))
    share = F.max(F.col("at") - F.floor("at"))
    found = hit.groupBy(*by, "i").agg(lower.alias("l"), upper.alias("u"), share.alias("f"))
    found = found.withColumn("v", F.when(F.col("l") == F.col("u"), F.col("l")).otherwise(F.col("l") * (1 - F.col("f")) + F.col("u") * F.col("f")))
    value = [F.max(F.when(F.col("i") == i, F.col("v"))) for i in range(len(q))]
    return found.groupBy(*by).agg(F.array(*value).alias("quantiles")).join(cuts.select(*by, "distinct"), by)


def feature_summary(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, n, missing_pct, mean, std, min, p01 to p95, max, distinct)."""
    q = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95)
    found = _moments(df, [], names).join(exact_quantiles(value_counts(df, [], names), ["feature"], q), "feature", "left")
    at = [F.col("quantiles")[k].alias(f"p{int(v * 100):02d}") for k, v in enumerate(q)]
    return found.select("feature", "n", "missing_pct", "mean", "std", "min", *at, "max", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def by_target(df: DataFrame, names: list[str], target: str) -> DataFrame:
    """(feature, target, n, mean, std, median); rows without a target aren't counted."""
    some = df.where(F.col(target).isNotNull())
    medians = exact_quantiles(value_counts(some, [target], names), [target, "feature"], (0.5,)).select(target, "feature", F.col("quantiles")[0].alias("median"))
    return _moments(some, [target], names).select("feature", target, "n", "mean", "std").join(medians, [target, "feature"], "left").select("feature", target, "n", "mean", "std", "median")


def null_rates(df: DataFrame, names: list[str]) -> DataFrame:
    one = df.agg(*[F.avg(F.col(n).isNull().cast("double")).alias(n) for n in names])
    return one.unpivot([], names, "feature", "null_rate")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 40, by: list[str] | None = None, scale: str | None = None) -> DataFrame:
    """by, bin, n: equal bins from 1; values outside are clipped to the range, as for display.

    ``scale``: ``log`` makes the bins equal in the logarithm, with low above 0; ``log1p`` in the logarithm of 1 + x.
    """
    move = {None: lambda c: c, "log": F.ln, "log1p": F.log1p}[scale]
    x = F.least(F.greatest(F.col(column).cast("double"), F.lit(low).cast("double")), F.lit(high).cast("double"))
    b = F.least(F.width_bucket(move(x), move(F.lit(low).cast("double")), move(F.lit(high).cast("double")), F.lit(bins)), F.lit(bins))
    return df.where(F.col(column).isNotNull()).groupBy(*(by or []), b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def collapse_timestamps(df: DataFrame, column: str) -> DataFrame:
    """(event_us, value, n): one value a timestamp; it is equal within a tie, so the smallest is it."""
    return df.groupBy("event_us").agg(F.min(column).alias("value"), F.count("*").alias("n"))


def falls(df: DataFrame, order: str, column: str) -> DataFrame:
    """One row: how often a column falls from a row to the next. For tables of a few rows, such as buckets."""
    w = W.orderBy(order)
    return df.select((F.col(column) - F.lag(column).over(w)).alias("d")).agg(F.count_if(F.col("d") < 0).alias("falls"))


def ranked(df: DataFrame, value: str, name: str, k: int | None = None) -> DataFrame:
    """Rank from 1 by falling value, then name; for small tables such as importances."""
    out = df.withColumn("rank", F.row_number().over(W.orderBy(F.col(value).desc(), name)))
    return out.where(F.col("rank") <= k) if k else out
