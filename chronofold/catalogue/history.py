"""Queries of strict-prior history, vectors and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions.scalars import DAY_US, age_years, iso_nanos, micros
from ..operators import history as h
from ..operators import predicates as p
from ..operators import vectors as v
from ..operators.buckets import spread
from ..plans.features import feature_table
from ..sources.publish import stored
from ..views import with_views
from . import query, rounded

KEYS = ["event_id", "user_id", "item_id", "event_us"]
PRIOR = "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(with_views("re", f"""
, h AS (SELECT *, count(*) OVER w AS n, sum(rating) OVER w AS s FROM re WINDOW w AS (ORDER BY event_us {PRIOR}))
SELECT event_id, user_id, item_id, event_us, n AS global_count, round(coalesce(s / n, 3.5), 6) AS global_mean FROM h"""))  # fmt: skip
def global_history(spark, sf):
    return rounded(h.global_history(views.events(spark, sf)).select(*KEYS, "global_count", "global_mean"))


_USER = f"""
, h AS (SELECT *, count(*) OVER w AS n, sum(rating) OVER w AS s, sum(rating * rating) OVER w AS ss, max(event_us) OVER w AS last
  FROM re WINDOW w AS (PARTITION BY user_id ORDER BY event_us {PRIOR}))
"""


@query(with_views("re", _USER + """
SELECT event_id, user_id, item_id, event_us, n AS user_count, s / nullif(n, 0) AS user_mean,
  CASE WHEN n > 1 THEN sqrt((n * ss - s * s) / (CAST(n AS DOUBLE) * n)) ELSE 0 END AS user_std FROM h"""))  # fmt: skip
def user_history(spark, sf):
    return h.user_history(views.events(spark, sf)).select(*KEYS, "user_count", "user_mean", "user_std")


@query(with_views("re", _USER + "SELECT event_id, user_id, item_id, event_us, (event_us - last) / CAST(1e6 AS DOUBLE) AS user_recency_s FROM h"))
def user_recency(spark, sf):
    return h.user_history(views.events(spark, sf)).select(*KEYS, "user_recency_s")


@query(with_views("re", _USER.replace("PARTITION BY user_id", "PARTITION BY item_id") + """
SELECT event_id, user_id, item_id, event_us, n AS item_count, s / nullif(n, 0) AS item_mean,
  CASE WHEN n > 1 THEN sqrt((n * ss - s * s) / (CAST(n AS DOUBLE) * n)) ELSE 0 END AS item_std FROM h"""))  # fmt: skip
def item_history(spark, sf):
    return h.item_history(views.events(spark, sf), {}).select(*KEYS, "item_count", "item_mean", "item_std")


@query(with_views("re", f"""
, h AS (SELECT *, count(*) OVER w AS n, sum(rating) OVER w AS s FROM re WINDOW w AS (PARTITION BY item_id ORDER BY event_us {PRIOR}))
SELECT event_id, user_id, item_id, event_us, n AS item_id_n, coalesce(s, 0) AS item_id_s FROM h"""))  # fmt: skip
def salted_item_history(spark, sf):
    """Items with over 20 events go through buckets of time."""
    e = stored(views.events(spark, sf).drop("ts"), "events")  # looking for hot items and cutting their time read it too
    e = h.item_history(e, {}, h.hot_keys(e, "item_id", 20))
    total = F.coalesce(F.round(F.col("item_mean") * F.col("item_count") * 2) / 2, F.lit(0.0))  # sums of half stars
    return e.select(*KEYS, F.col("item_count").alias("item_id_n"), total.alias("item_id_s"))


def _rolling(days: int) -> str:
    return f"count(*) OVER w{days} AS n{days}, sum(rating) OVER w{days} AS s{days}"


_WINDOWS = ", ".join(f"w{d} AS (PARTITION BY item_id ORDER BY event_us RANGE BETWEEN {d * DAY_US} PRECEDING AND 1 PRECEDING)" for d in (30, 60))
_ROLL = f"\n, h AS (SELECT *, {_rolling(30)}, {_rolling(60)} FROM re WINDOW {_WINDOWS})\n"


@query(with_views("re", _ROLL + "SELECT event_id, user_id, item_id, event_us, n30 AS item_count_30d, s30 / nullif(n30, 0) AS item_mean_30d FROM h"))
def item_activity_30d(spark, sf):
    return h.item_history(views.events(spark, sf), {"30d": 30 * DAY_US}).select(*KEYS, "item_count_30d", "item_mean_30d")


@query(with_views("re", _ROLL + "SELECT event_id, user_id, item_id, event_us, n60 AS item_count_60d, s60 / nullif(n60, 0) AS item_mean_60d FROM h"))
def item_activity_60d(spark, sf):
    return h.item_history(views.events(spark, sf), {"60d": 60 * DAY_US}).select(*KEYS, "item_count_60d", "item_mean_60d")


_RATIOS = """CAST(CAST(CAST(CAST(s30 / nullif(n30, 0) AS FLOAT) AS DOUBLE) / nullif(CAST(CAST(s60 / nullif(n60, 0) AS FLOAT) AS DOUBLE), 0) AS FLOAT) AS DOUBLE) AS item_mean_ratio,
  CAST(CAST(CAST(n30 AS DOUBLE) / nullif(n60, 0) AS FLOAT) AS DOUBLE) AS item_count_ratio"""


@query(with_views("re", _ROLL + f"SELECT event_id, user_id, item_id, event_us, {_RATIOS} FROM h"))
def item_window_ratios(spark, sf):
    e = h.window_ratios(h.item_history(views.events(spark, sf)))
    return e.select(*KEYS, F.col("item_mean_ratio").cast("double").alias("item_mean_ratio"), F.col("item_count_ratio").cast("double").alias("item_count_ratio"))


@query(f"""
WITH e AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item_id, epoch_us(ts) AS event_us, ts, value FROM events)
SELECT event_id, user_id, item_id, event_us, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000' AS iso, count(*) OVER w7 AS n7, count(*) OVER w14 AS n14
FROM e WINDOW w7 AS (PARTITION BY item_id ORDER BY event_us RANGE BETWEEN {7 * DAY_US} PRECEDING AND 1 PRECEDING),
  w14 AS (PARTITION BY item_id ORDER BY event_us RANGE BETWEEN {14 * DAY_US} PRECEDING AND 1 PRECEDING)""")  # fmt: skip
def json_event_items(spark, sf):
    e = views.table(spark, sf, "events")
    e = e.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("item_id"), micros("ts").alias("event_us"), "ts", F.lit(1.0).alias("rating"))
    e = h.item_history(e, {"7d": 7 * DAY_US, "14d": 14 * DAY_US})
    return e.select("event_id", "user_id", F.col("item_id"), "event_us", iso_nanos("ts").alias("iso"), F.col("item_count_7d").alias("n7"), F.col("item_count_14d").alias("n14"))


_AFFINITY = f"""
, a AS (SELECT event_id, user_id, item_id, event_us, sum(rating) OVER w / nullif(count(*) OVER w, 0) AS um FROM re WINDOW w AS (PARTITION BY user_id ORDER BY event_us {PRIOR})),
x AS (SELECT re.event_id, count(*) OVER w AS n, sum(rating) OVER w AS s FROM re JOIN br USING (item_id) WINDOW w AS (PARTITION BY user_id, genre ORDER BY event_us {PRIOR})),
g AS (SELECT event_id, CAST(sum(n) AS BIGINT) AS n, sum(s) AS s FROM x GROUP BY event_id)
"""


@query(with_views("re br", _AFFINITY + """
SELECT a.event_id, user_id, item_id, event_us, coalesce(g.n, 0) AS user_genre_count, coalesce(g.s / nullif(g.n, 0), um) AS user_genre_mean,
  coalesce(g.s / nullif(g.n, 0), um) - um AS user_genre_delta
FROM a LEFT JOIN g ON a.event_id = g.event_id"""))  # fmt: skip
def user_group_affinity(spark, sf):
    e = stored(views.events(spark, sf).drop("ts"), "events")  # counted, so that a task's sorts stay of one size
    e = spread(e.join(views.catalog(spark, sf).select("item_id", "genres"), "item_id", "left"), e.count(), "user_id")
    e = h.group_affinity(h.user_history(e))
    return e.select(*KEYS, "user_genre_count", "user_genre_mean", (F.col("user_genre_mean") - F.col("user_mean")).alias("user_genre_delta"))


_YEARS = "(event_us - epoch_us(make_timestamp(release_year, 1, 1, 0, 0, 0))) / CAST(1e6 AS DOUBLE) / CAST(31556952 AS DOUBLE)"


@query(with_views("re yr", f"SELECT event_id, user_id, re.item_id, event_us, release_year, round({_YEARS}, 9) AS item_age_years FROM re LEFT JOIN yr ON re.item_id = yr.item_id"))
def item_age_years(spark, sf):
    e = views.events(spark, sf).join(views.catalog(spark, sf).select("item_id", "release_year"), "item_id", "left")
    return e.select(*KEYS, "release_year", F.round(age_years(F.col("event_us"), F.col("release_year")), 9).alias("item_age_years"))


@query(with_views("vec", """
SELECT item_id, round(list_avg(v), 6) AS vector_mean, round(list_stddev_pop(v), 6) AS vector_std, round(list_avg(list_sort(v, 'DESC')[1:10]), 6) AS vector_top10 FROM vec"""))  # fmt: skip
def vector_static_stats(spark, sf):
    return rounded(v.statistics(v.vectors(views.scores(spark, sf))))


_VECTORS = f"""
, u AS (SELECT item_id, v, list_transform(v, lambda x: CAST(CAST(x / size AS FLOAT) AS DOUBLE)) AS u FROM vec),
ev AS (SELECT event_id, user_id, re.item_id, rating, event_us, u, v FROM re JOIN u ON re.item_id = u.item_id),
pr AS (SELECT a.event_id, list_dot_product(a.u, b.u) AS sim FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.event_us < a.event_us WHERE b.rating >= 4),
nn AS (SELECT event_id, max(sim) AS nearest_liked, list_avg(list_sort(list(sim), 'DESC')[1:5]) AS top5_liked FROM pr GROUP BY event_id),
tg AS (SELECT event_id, user_id, event_us, rating >= 4 AS liked, unnest(v) AS x, unnest(u) AS ux, unnest(range(len(v))) AS pos FROM ev),
cs AS (SELECT event_id, ux, sum(x) FILTER (liked) OVER w AS sp, sum(x) FILTER (NOT liked) OVER w AS sn FROM tg WINDOW w AS (PARTITION BY user_id, pos ORDER BY event_us {PRIOR})),
cc AS (SELECT event_id, sum(ux * sp) / nullif(sqrt(sum(sp * sp)), 0) AS liked_cosine, sum(ux * sn) / nullif(sqrt(sum(sn * sn)), 0) AS disliked_cosine FROM cs GROUP BY event_id)
"""


def _preferences(spark, sf):
    return v.preference_history(views.events(spark, sf), v.vectors(views.scores(spark, sf)))


@query(with_views("re vec", _VECTORS + "SELECT ev.event_id, ev.user_id, round(liked_cosine, 6) AS liked_cosine, round(disliked_cosine, 6) AS disliked_cosine FROM ev LEFT JOIN cc ON ev.event_id = cc.event_id"))
def vector_centroid_cosine(spark, sf):
    return rounded(_preferences(spark, sf).select("event_id", "user_id", "liked_cosine", "disliked_cosine"))


@query(with_views("re vec", _VECTORS + "SELECT ev.event_id, ev.user_id, round(nearest_liked, 6) AS nearest_liked, round(top5_liked, 6) AS top5_liked FROM ev LEFT JOIN nn ON ev.event_id = nn.event_id"))
def vector_nearest_top5(spark, sf):
    return rounded(_preferences(spark, sf).select("event_id", "user_id", "nearest_liked", "top5_liked"))


@query(with_views("re vec", _VECTORS + "SELECT ev.event_id, round(liked_cosine - disliked_cosine, 6) + 0e0 AS preference_margin FROM ev LEFT JOIN cc ON ev.event_id = cc.event_id"))
def preference_margin(spark, sf):
    return rounded(_preferences(spark, sf).select("event_id", (F.col("liked_cosine") - F.col("disliked_cosine")).alias("preference_margin")))


@query(with_views("vec", """
, u AS (SELECT item_id, unnest(v) / size AS x, unnest(range(1, len(v) + 1)) AS tag_id FROM vec WHERE item_id IN (1, 2))
SELECT a.tag_id, round(a.x, 6) AS a, round(b.x, 6) AS b, round(a.x - b.x, 6) AS difference
FROM u a JOIN u b ON a.tag_id = b.tag_id AND a.item_id = 1 AND b.item_id = 2 ORDER BY abs(a.x - b.x) DESC, a.tag_id LIMIT 10"""))  # fmt: skip
def tag_attribution(spark, sf):
    return rounded(v.attribution(v.vectors(views.scores(spark, sf)), 1, 2))


@query(with_views("vec", """
, u AS (SELECT unnest(v) / size AS x, unnest(range(1, len(v) + 1)) AS tag_id FROM vec WHERE item_id = 1)
SELECT tag_id, round(x, 6) AS weight FROM u ORDER BY x DESC, tag_id LIMIT 10"""))  # fmt: skip
def tag_attribution_top(spark, sf):
    return rounded(v.top_tags(v.vectors(views.scores(spark, sf)), 1))


@query(with_views("vec", """
, u AS (SELECT item_id, unnest(v) / size AS x, unnest(range(1, len(v) + 1)) AS tag_id FROM vec WHERE item_id IN (1, 2))
SELECT a.tag_id, round(a.x * b.x, 6) AS contribution
FROM u a JOIN u b ON a.tag_id = b.tag_id AND a.item_id = 1 AND b.item_id = 2 ORDER BY a.x * b.x DESC, a.tag_id LIMIT 8"""))  # fmt: skip
def tag_attribution_contributions(spark, sf):
    return rounded(v.contributions(v.vectors(views.scores(spark, sf)), 1, 2))


_F = lambda x: f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"
_W = "OVER (PARTITION BY {} ORDER BY event_us " + PRIOR + ")"
_U, _I = _W.format("user_id"), _W.format("item_id")
_BASE = f"""
, a AS (SELECT re.*, count(*) OVER gw AS gn, sum(rating) OVER gw AS gs,
  count(*) {_U} AS un, sum(rating) {_U} AS us, sum(rating * rating) {_U} AS uss, max(event_us) {_U} AS ul,
  count(*) {_I} AS n, sum(rating) {_I} AS s, sum(rating * rating) {_I} AS ss,
  {_rolling(30)}, {_rolling(60)} FROM re WINDOW gw AS (ORDER BY event_us {PRIOR}), {_WINDOWS}),
b AS (SELECT *, coalesce(gs / gn, 3.5) AS gm, coalesce(us / nullif(un, 0), gs / gn, 3.5) AS um FROM a),
x AS (SELECT re.event_id, count(*) {_W.format("user_id, genre")} AS n, sum(rating) {_W.format("user_id, genre")} AS s FROM re JOIN br USING (item_id)),
g AS (SELECT event_id, CAST(sum(n) AS BIGINT) AS n, sum(s) AS s FROM x GROUP BY event_id),
k AS (SELECT item_id, count(*) AS n FROM br GROUP BY item_id)
"""


def _std(n, s, ss):
    return _F(f"CASE WHEN {n} > 1 THEN sqrt(({n} * {ss} - {s} * {s}) / (CAST({n} AS DOUBLE) * {n})) ELSE 0 END")


_AFF = "coalesce(g.s / nullif(g.n, 0), um)"
_COLUMNS17 = f"""b.event_id, b.user_id, b.item_id, b.event_us, gn AS global_count, {_F("gm")} AS global_mean, un AS user_count, {_F("um")} AS user_mean,
  {_std("un", "us", "uss")} AS user_std, (b.event_us - ul) / CAST(1e6 AS DOUBLE) AS user_recency_s,
  b.n AS item_count, {_F("coalesce(b.s / nullif(b.n, 0), gm)")} AS item_mean, {_std("b.n", "b.s", "b.ss")} AS item_std, n30 AS item_count_30d,
  coalesce(g.n, 0) AS user_genre_count, {_F(_AFF)} AS user_genre_mean, {_F(_AFF + " - um")} AS user_genre_delta,
  coalesce(k.n, 0) AS item_genres, CAST(release_year AS BIGINT) AS item_year, release_year IS NULL AS item_year_missing, {_F(_YEARS)} AS item_age_years"""
_JOINS = "FROM b LEFT JOIN g ON b.event_id = g.event_id LEFT JOIN yr ON b.item_id = yr.item_id LEFT JOIN k ON b.item_id = k.item_id"


def _as_double(df):
    return df.select(*[F.col(c).cast("double" if k == "float" else "long" if k == "smallint" else k).alias(c) for c, k in df.dtypes])


@query(with_views("re yr br", _BASE + f"SELECT {_COLUMNS17} {_JOINS}"))
def feature_matrix_baseline17(spark, sf):
    return _as_double(feature_table(views.events(spark, sf), views.catalog(spark, sf), version=17))


_VECTOR_NAMES = ("liked_cosine", "disliked_cosine", "preference_margin", "nearest_liked", "top5_liked", "vector_mean", "vector_std", "vector_top10")


_FULL30 = with_views("re yr br vec", _BASE + _VECTORS + f""", st AS (
  SELECT item_id, list_avg(v) AS vector_mean, list_stddev_pop(v) AS vector_std, list_avg(list_sort(v, 'DESC')[1:10]) AS vector_top10 FROM vec)
SELECT {_COLUMNS17}, n60 AS item_count_60d, {_F("s30 / nullif(n30, 0)")} AS item_mean_30d, {_F("s60 / nullif(n60, 0)")} AS item_mean_60d, {_RATIOS},
  round(liked_cosine, 5) AS liked_cosine, round(disliked_cosine, 5) AS disliked_cosine, round(liked_cosine - disliked_cosine, 5) + 0e0 AS preference_margin,
  round(nearest_liked, 5) AS nearest_liked, round(top5_liked, 5) AS top5_liked,
  round(vector_mean, 5) AS vector_mean, round(vector_std, 5) AS vector_std, round(vector_top10, 5) AS vector_top10
{_JOINS} LEFT JOIN cc ON b.event_id = cc.event_id LEFT JOIN nn ON b.event_id = nn.event_id LEFT JOIN st ON b.item_id = st.item_id""")  # fmt: skip


def _matrix30(spark, sf, hot=None):
    """The vector block in double, rounded to 5 digits; the other columns exactly as the table has them."""
    from ..plans.features import blocks
    from ..schemas import CONTEXT, FEATURES

    e = blocks(views.events(spark, sf), views.catalog(spark, sf), views.scores(spark, sf), hot)
    out = [F.round(F.col(f.name), 5) + F.lit(0.0) if f.name in _VECTOR_NAMES else F.col(f.name).cast(f.kind) for f in FEATURES]
    return _as_double(e.select(*CONTEXT, *[c.alias(f.name) for c, f in zip(out, FEATURES, strict=True)]))


@query(_FULL30)
def feature_matrix_full30(spark, sf):
    return _matrix30(spark, sf)


@query(_FULL30)
def feature_matrix_hot_keys(spark, sf):
    """The 30 features where items and users with over 30 events are hot."""
    return _matrix30(spark, sf, 30)


_CUT = "1998-06-15"


@query(with_views("re", f"SELECT event_id, user_id, item_id, rating, event_us FROM re WHERE ts < TIMESTAMP '{_CUT}'"))
def strict_prior_asof(spark, sf):
    return p.historical(views.events(spark, sf), _CUT).select("event_id", "user_id", "item_id", "rating", "event_us")


@query(with_views("re", f"SELECT event_id, user_id, item_id, rating, event_us FROM re WHERE ts < TIMESTAMP '{_CUT}' AND ts >= TIMESTAMP '{_CUT}' - INTERVAL 30 DAY"))
def rolling_asof(spark, sf):
    return views.events(spark, sf).where(p.in_window("event_us", _CUT, 30 * DAY_US)).select("event_id", "user_id", "item_id", "rating", "event_us")


@query(with_views("re", f"SELECT event_id, user_id, item_id, rating, event_us FROM re WHERE ts < TIMESTAMP '{_CUT}' AND user_id = 7"))
def history_by_entity(spark, sf):
    return p.historical(views.events(spark, sf), _CUT, {"user_id": 7}).select("event_id", "user_id", "item_id", "rating", "event_us")


@query(with_views("re", f"SELECT item_id, count(*) AS n, sum(rating) AS total FROM re WHERE ts < TIMESTAMP '{_CUT}' GROUP BY item_id"))
def state_inputs_asof(spark, sf):
    return p.historical(views.events(spark, sf), _CUT).groupBy("item_id").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))


@query(with_views("re br", f"SELECT event_id, user_id, item_id, genre, rating FROM re JOIN br USING (item_id) WHERE ts < TIMESTAMP '{_CUT}'"))
def relationship_inputs_asof(spark, sf):
    return p.relationship_inputs(views.events(spark, sf), views.bridge(spark, sf), _CUT).select("event_id", "user_id", "item_id", "genre", "rating")


@query(with_views("re", """
SELECT a.event_id, count(b.event_id) AS n, sum(b.rating) AS total FROM re a LEFT JOIN re b ON a.user_id = b.user_id AND b.event_us < a.event_us GROUP BY a.event_id"""))  # fmt: skip
def asof_self_join(spark, sf):
    """Each event with its user's strict history: a window, not the self-join that defines it."""
    w = h.prior("user_id")
    return views.events(spark, sf).select("event_id", F.count("*").over(w).alias("n"), F.sum("rating").over(w).alias("total"))
