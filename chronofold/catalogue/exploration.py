"""Exploratory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions.scalars import quarter_label
from ..operators import explore as ex
from ..operators import history as h
from ..views import with_views
from . import query, rounded


@query(with_views("re", """
, r AS (SELECT count(*) AS n FROM re GROUP BY user_id, item_id, rating, ts), p AS (SELECT count(*) AS n FROM re GROUP BY user_id, item_id),
t AS (SELECT count(*) AS n FROM re GROUP BY ts), u AS (SELECT user_id, max(n) AS n FROM (SELECT user_id, count(*) AS n FROM re GROUP BY user_id, ts) GROUP BY user_id)
SELECT (SELECT count(*) FROM re) AS row_count, (SELECT min(ts) FROM re) AS min_ts, (SELECT max(ts) FROM re) AS max_ts, (SELECT bool_and(date_trunc('second', ts) = ts) FROM re) AS whole_seconds,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM r) AS duplicate_rows, (SELECT count(*) FROM p WHERE n > 1) AS repeated_pairs, (SELECT CAST(sum(n) AS BIGINT) FROM p WHERE n > 1) AS rows_in_repeated_pairs,
  (SELECT count(*) FROM t WHERE n > 1) AS shared_timestamps, (SELECT max(n) FROM t) AS most_at_one_timestamp, (SELECT count(*) FROM u) AS users, (SELECT count(*) FROM u WHERE n > 1) AS users_with_ties,
  (SELECT count(DISTINCT item_id) FROM re) AS items"""))  # fmt: skip
def temporal_audit(spark, sf):
    return ex.temporal_audit(views.events(spark, sf))


_RATE = "count(*) AS n, count(*) FILTER (rating >= 4) AS high, round(count(*) FILTER (rating >= 4) / CAST(count(*) AS DOUBLE), 6) AS rate FROM re GROUP BY 1"


@query(with_views("re", f"SELECT CAST(year(ts) AS BIGINT) AS year, {_RATE}"))
def yearly_rate(spark, sf):
    return rounded(ex.rate_by(views.events(spark, sf), F.year("ts"), "year"))


@query(with_views("re", f"SELECT year(ts) || 'Q' || quarter(ts) AS quarter, {_RATE}"))
def quarterly_rate(spark, sf):
    return rounded(ex.rate_by(views.events(spark, sf), quarter_label("ts"), "quarter"))


@query(with_views("re", ", y AS (SELECT avg(CASE WHEN rating >= 4 THEN 1e0 ELSE 0e0 END) AS r FROM re GROUP BY year(ts)) SELECT round(max(r) - min(r), 6) AS range, round(stddev_samp(r), 6) AS std FROM y"))
def yearly_rate_spread(spark, sf):
    y = ex.rate_by(views.events(spark, sf), F.year("ts"), "year")
    return rounded(y.agg((F.max("rate") - F.min("rate")).alias("range"), F.stddev_samp("rate").alias("std")))


@query(with_views("re", "SELECT rating AS value, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM re) AS DOUBLE), 6) AS share FROM re GROUP BY rating"))
def rating_distribution(spark, sf):
    return rounded(ex.distribution(views.events(spark, sf), "rating"))


@query(with_views("re", """
, n AS (SELECT count(*) AS n FROM re GROUP BY user_id), q AS (SELECT unnest([0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1]::DOUBLE[]) AS q, unnest(quantile_cont(n, [0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1])) AS value FROM n)
SELECT q, round(CAST(value AS DOUBLE), 6) AS value FROM q UNION ALL SELECT NULL, round(avg(n), 6) FROM n"""))  # fmt: skip
def activity_quantiles(spark, sf):
    return rounded(ex.activity_quantiles(views.events(spark, sf), "user_id"))


_DRIFT = """
, k AS (SELECT user_id, CASE WHEN rating >= 4 THEN 1e0 ELSE 0e0 END AS high, (row_number() OVER (PARTITION BY user_id ORDER BY event_us, item_id, event_id) - 1) / CAST(count(*) OVER (PARTITION BY user_id) AS DOUBLE) AS place FROM re),
d AS (SELECT user_id, count(*) AS n, count(*) FILTER (place < 0.3) AS n_early, count(*) FILTER (place >= 0.7) AS n_late, avg(high) FILTER (place < 0.3) AS early_rate, avg(high) FILTER (place >= 0.7) AS late_rate,
  avg(high) FILTER (place >= 0.7) - avg(high) FILTER (place < 0.3) AS delta FROM k GROUP BY user_id)
"""


@query(with_views("re", _DRIFT + "SELECT user_id, n, n_early, n_late, round(early_rate, 6) AS early_rate, round(late_rate, 6) AS late_rate, round(delta, 6) AS delta FROM d"))
def early_late_drift(spark, sf):
    """Users with over 30 events are hot."""
    return rounded(ex.early_late(views.events(spark, sf), hot=30))


@query(with_views("re", _DRIFT + """
, r AS (SELECT * FROM (VALUES (20, 5), (50, 10), (100, 15)) v(least, segment)), x AS (SELECT least, segment, delta FROM d, r WHERE n >= least AND n_early >= segment AND n_late >= segment AND delta IS NOT NULL)
SELECT CAST(least AS BIGINT) AS least, CAST(segment AS BIGINT) AS segment, count(*) AS users, round(avg(delta), 6) AS mean, round(median(delta), 6) AS median, round(stddev_samp(delta), 6) AS std,
  round(quantile_cont(delta, 0.1), 6) AS p10, round(quantile_cont(delta, 0.25), 6) AS p25, round(quantile_cont(delta, 0.75), 6) AS p75, round(quantile_cont(delta, 0.9), 6) AS p90,
  round(100 * avg(CASE WHEN abs(delta) >= 0.05 THEN 1e0 ELSE 0e0 END), 6) AS pct_over_05, round(100 * avg(CASE WHEN abs(delta) >= 0.1 THEN 1e0 ELSE 0e0 END), 6) AS pct_over_10,
  round(100 * avg(CASE WHEN abs(delta) >= 0.2 THEN 1e0 ELSE 0e0 END), 6) AS pct_over_20 FROM x GROUP BY ALL"""))  # fmt: skip
def drift_by_min_history(spark, sf):
    return rounded(ex.drift_summary(ex.early_late(views.events(spark, sf))))


_BIN = "CASE WHEN n >= 500 THEN 500 WHEN n >= 200 THEN 200 WHEN n >= 100 THEN 100 WHEN n >= 50 THEN 50 WHEN n >= 20 THEN 20 ELSE 0 END"


@query(with_views("re", _DRIFT + f"SELECT CAST({_BIN} AS BIGINT) AS from_n, count(*) AS users, round(avg(delta), 6) AS mean, round(median(abs(delta)), 6) AS median_abs FROM d WHERE delta IS NOT NULL GROUP BY 1"))
def drift_by_activity_bin(spark, sf):
    return rounded(ex.drift_by_activity(ex.early_late(views.events(spark, sf))))


@query(with_views("re", """
, x AS (SELECT user_id, event_id, count(*) OVER w AS n, avg(CASE WHEN rating >= 4 THEN 1e0 ELSE 0e0 END) OVER w AS rate FROM re WINDOW w AS (PARTITION BY user_id ORDER BY event_us, item_id, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, CASE WHEN n >= 10 THEN round(rate, 6) END AS rate FROM x"""))  # fmt: skip
def rolling_rate_50(spark, sf):
    """Users with over 30 events are hot."""
    return rounded(ex.rolling_rate(views.events(spark, sf), hot=30))


@query(with_views("re", _DRIFT + """
, x AS (SELECT user_id, delta FROM d WHERE n >= 20 AND delta IS NOT NULL)
SELECT (SELECT user_id FROM x ORDER BY delta, user_id LIMIT 1) AS fall, (SELECT user_id FROM x ORDER BY delta DESC, user_id LIMIT 1) AS rise, (SELECT user_id FROM x ORDER BY abs(delta), user_id LIMIT 1) AS stable"""))  # fmt: skip
def example_users_argminmax(spark, sf):
    return ex.examples(ex.early_late(views.events(spark, sf)))


@query(with_views("re", ", n AS (SELECT user_id, count(*) AS n FROM re GROUP BY user_id) SELECT user_id, n FROM n ORDER BY abs(n - (SELECT median(n) FROM n)), user_id LIMIT 1"))
def median_user(spark, sf):
    n = views.events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    return ex.nearest_to_median(n, "user_id", "n")


@query(with_views("yr", """
, c AS (SELECT CASE WHEN genres = '(no genres listed)' THEN 'none' WHEN len(list_distinct(string_split(genres, '|'))) = 1 THEN 'single' ELSE 'multi' END AS structure FROM yr)
SELECT structure, count(*) AS items, round(100 * count(*) / CAST((SELECT count(*) FROM c) AS DOUBLE), 6) AS pct FROM c GROUP BY structure"""))  # fmt: skip
def group_structure(spark, sf):
    return rounded(ex.group_structure(views.catalog(spark, sf)))


@query(with_views("br", "SELECT genre, count(DISTINCT item_id) AS items, round(100 * count(DISTINCT item_id) / CAST((SELECT count(*) FROM it) AS DOUBLE), 6) AS pct FROM br GROUP BY genre"))
def group_coverage(spark, sf):
    return rounded(ex.group_coverage(views.bridge(spark, sf), views.catalog(spark, sf)))


@query(with_views("re br", """
, s AS (SELECT item_id, count(*) AS n, sum(rating) AS total, count(*) FILTER (rating >= 4) AS high, avg(rating) AS mean FROM re GROUP BY item_id)
SELECT genre, count(*) AS items, count(n) AS rated_items, CAST(coalesce(sum(n), 0) AS BIGINT) AS ratings, round(sum(total) / sum(n), 6) AS mean, round(sum(high) / CAST(sum(n) AS DOUBLE), 6) AS rate,
  round(median(mean), 6) AS median_item_mean, round(100 * count(*) / CAST((SELECT count(*) FROM it) AS DOUBLE), 6) AS coverage_pct FROM br LEFT JOIN s ON br.item_id = s.item_id GROUP BY genre"""))  # fmt: skip
def group_rating_summary(spark, sf):
    return rounded(ex.group_summary(views.events(spark, sf), views.bridge(spark, sf), views.catalog(spark, sf)))


@query(with_views("re", "SELECT item_id, count(*) AS n, sum(rating) AS total, count(*) FILTER (rating >= 4) AS high, round(avg(rating), 6) AS mean, round(count(*) FILTER (rating >= 4) / CAST(count(*) AS DOUBLE), 6) AS rate FROM re GROUP BY item_id"))
def item_rating_stats(spark, sf):
    return rounded(ex.item_stats(views.events(spark, sf)))


_NAMES = ("user_count", "user_mean", "user_std", "user_recency_s")
_PRIOR = "PARTITION BY user_id ORDER BY event_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_FEATS = f"""
, h AS (SELECT *, count(*) OVER w AS n, sum(rating) OVER w AS s, sum(rating * rating) OVER w AS ss, max(event_us) OVER w AS last FROM re WINDOW w AS ({_PRIOR})),
f AS (SELECT CASE WHEN rating >= 4 THEN 1 ELSE 0 END AS high, CAST(n AS DOUBLE) AS user_count, s / nullif(n, 0) AS user_mean, CASE WHEN n > 1 THEN sqrt((n * ss - s * s) / (CAST(n AS DOUBLE) * n)) ELSE 0 END AS user_std,
  (event_us - last) / CAST(1e6 AS DOUBLE) AS user_recency_s FROM h),
l AS (SELECT high, unnest(['user_count', 'user_mean', 'user_std', 'user_recency_s']) AS feature, unnest([user_count, user_mean, user_std, user_recency_s]) AS x FROM f)
"""


def _features(spark, sf):
    e = h.user_history(views.events(spark, sf))
    return e.withColumns({"user_count": F.col("user_count").cast("double"), "high": (F.col("rating") >= 4).cast("long")})


@query(with_views("re", _FEATS + """
SELECT feature, count(x) AS n, round(100 * avg(CASE WHEN x IS NULL THEN 1e0 ELSE 0e0 END), 6) AS missing_pct, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min,
  round(quantile_cont(x, 0.01), 6) AS p01, round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75,
  round(quantile_cont(x, 0.95), 6) AS p95, round(max(x), 6) AS max, count(DISTINCT x) AS distinct FROM l GROUP BY feature""".replace("AS distinct", 'AS "distinct"')))  # fmt: skip
def feature_summary(spark, sf):
    return rounded(ex.feature_summary(_features(spark, sf), list(_NAMES)))


@query(with_views("re", _FEATS + "SELECT feature, CAST(high AS BIGINT) AS high, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(median(x), 6) AS median FROM l GROUP BY feature, high"))
def target_conditioned_summary(spark, sf):
    return rounded(ex.by_target(_features(spark, sf), list(_NAMES), "high"))


@query(with_views("re", _FEATS + "SELECT feature, round(avg(CASE WHEN x IS NULL THEN 1e0 ELSE 0e0 END), 6) AS null_rate FROM l GROUP BY feature"))
def null_rates(spark, sf):
    return rounded(ex.null_rates(_features(spark, sf), list(_NAMES)))


@query(with_views("re", _FEATS + """
SELECT CAST(least(floor(least(greatest(user_count, 0), 80) / 2) + 1, 40) AS BIGINT) AS bin, count(*) AS n FROM f GROUP BY 1"""))  # fmt: skip
def activity_histogram(spark, sf):
    return rounded(ex.histogram(_features(spark, sf), "user_count", 0.0, 80.0))


@query(with_views("re", _FEATS + """
SELECT CAST(least(floor(ln(1 + least(greatest(user_count, 0), 200)) / ln(CAST(201 AS DOUBLE)) * 40 + 1e-12) + 1, 40) AS BIGINT) AS bin, count(*) AS n FROM f GROUP BY 1"""))  # fmt: skip
def activity_histogram_log1p(spark, sf):
    return rounded(ex.histogram(_features(spark, sf), "user_count", 0.0, 200.0, scale="log1p"))


@query("""
SELECT CAST(least(floor(ln(least(greatest(o_totalprice, 1000), 500000) / 1000) / ln(CAST(500 AS DOUBLE)) * 20) + 1, 20) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1""")  # fmt: skip
def price_histogram_log(spark, sf):
    return rounded(ex.histogram(views.table(spark, sf, "orders"), "o_totalprice", 1000.0, 500_000.0, 20, scale="log"))


@query(with_views("re", ", h AS (SELECT event_us, count(*) OVER (ORDER BY event_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS value FROM re) SELECT event_us, min(value) AS value, count(*) AS n FROM h GROUP BY event_us"))
def timestamp_collapse(spark, sf):
    return ex.collapse_timestamps(h.global_history(views.events(spark, sf)), "global_count")


@query(with_views("re", ", x AS (SELECT item_id, sum(rating) AS gain FROM re GROUP BY item_id) SELECT item_id, gain, rank FROM (SELECT *, row_number() OVER (ORDER BY gain DESC, item_id) AS rank FROM x) WHERE rank <= 25"))
def gain_ranking(spark, sf):
    g = views.events(spark, sf).groupBy("item_id").agg(F.sum("rating").alias("gain")).orderBy(F.desc("gain"), "item_id").limit(25)
    return ex.ranked(g, "gain", "item_id").select("item_id", "gain", F.col("rank").cast("long").alias("rank"))
