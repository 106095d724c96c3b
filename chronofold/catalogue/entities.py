"""Queries of entities, validation, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions.scalars import release_year
from ..operators import entities as e
from ..operators import predicates as p
from ..operators import validate as val
from ..schemas import Column, Dataset
from ..views import with_views
from . import query, rounded

_BARE_YEAR = "CAST(nullif(nullif(regexp_extract(trim(title), '\\((\\d{4})\\)$', 1), ''), '0000') AS BIGINT)"


@query(with_views("re", """
, r AS (SELECT user_id, min(ts) AS first_rating FROM re GROUP BY user_id), t AS (SELECT user_id, min(ts) AS first_tag FROM events GROUP BY user_id)
SELECT coalesce(r.user_id, t.user_id) AS user_id, least(first_rating, first_tag) AS first_observed, first_rating FROM r FULL JOIN t ON r.user_id = t.user_id"""))  # fmt: skip
def entity_users(spark, sf):
    return e.users(views.events(spark, sf).select("user_id", "ts"), views.tags(spark, sf).select("user_id", "ts"))


@query(with_views("it lk", f"""
SELECT it.item_id, title, {_BARE_YEAR} AS release_year, CASE WHEN genres = '(no genres listed)' THEN 'missing_in_source' ELSE 'listed' END AS genre_status, imdb_id, tmdb_id
FROM it LEFT JOIN lk ON it.item_id = lk.item_id"""))  # fmt: skip
def entity_items(spark, sf):
    return rounded(e.items(views.raw_items(spark, sf), views.links(spark, sf), check=False))


@query(with_views("br", "SELECT item_id, genre FROM br"))
def bridge_item_group(spark, sf):
    return e.bridge(views.raw_items(spark, sf))


@query(with_views("br", "SELECT DISTINCT genre AS genre_id, genre AS genre_name FROM br"))
def entity_groups(spark, sf):
    return e.groups(views.bridge(spark, sf))


@query(with_views("it", f"SELECT item_id, title, {_BARE_YEAR} AS release_year FROM it"))
def release_year_parse(spark, sf):
    return rounded(views.raw_items(spark, sf).select("item_id", "title", release_year("title").alias("release_year")))


@query(with_views("yr br", """
SELECT yr.item_id, CAST(release_year AS BIGINT) AS item_year, release_year IS NULL AS item_year_missing, count(genre) AS item_genres
FROM yr LEFT JOIN br ON yr.item_id = br.item_id GROUP BY ALL"""))  # fmt: skip
def static_catalog(spark, sf):
    c = views.catalog(spark, sf)
    return rounded(c.select("item_id", F.col("release_year").alias("item_year"), F.col("release_year").isNull().alias("item_year_missing"), F.size("genres").alias("item_genres")))


@query(with_views("re", "SELECT *, rating >= 4 AS high FROM re"))
def rating_events(spark, sf):
    return e.rating_events(views.events(spark, sf), views.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), views.raw_items(spark, sf))


@query(with_views("re sc", "SELECT DISTINCT item_id FROM re WHERE item_id NOT IN (SELECT item_id FROM sc)"))
def referential_orphans(spark, sf):
    return val.orphans(views.events(spark, sf), views.scores(spark, sf), "item_id")


@query(with_views("re", "SELECT user_id, item_id, count(*) AS n FROM re GROUP BY user_id, item_id HAVING count(*) > 1"))
def key_violations(spark, sf):
    return val.duplicate_keys(views.events(spark, sf), ["user_id", "item_id"])


_LINES = Dataset("lines", (Column("l_quantity", "double", low=2, high=49), Column("l_discount", "double", values=tuple(k / 100 for k in range(11))), Column("l_partkey", "long", low=1)))


@query("""
SELECT rule, CAST(n AS BIGINT) AS n FROM (
  SELECT count(*) FILTER (l_quantity IS NULL) AS "l_quantity is null", count(*) FILTER (NOT isfinite(l_quantity)) AS "l_quantity is not finite",
    count(*) FILTER (l_quantity < 2) AS "l_quantity below 2", count(*) FILTER (l_quantity > 49) AS "l_quantity above 49",
    count(*) FILTER (l_discount IS NULL) AS "l_discount is null", count(*) FILTER (NOT isfinite(l_discount)) AS "l_discount is not finite",
    count(*) FILTER (l_discount NOT IN (0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.1)) AS "l_discount outside its values",
    count(*) FILTER (l_partkey IS NULL) AS "l_partkey is null", count(*) FILTER (l_partkey < 1) AS "l_partkey below 1"
  FROM lineitem) UNPIVOT (n FOR rule IN (COLUMNS(*)))""")
def domain_violations(spark, sf):
    one = val.violations(views.table(spark, sf, "lineitem"), _LINES)
    return one.unpivot([], one.columns, "rule", "n")


@query(with_views("it", """
, f AS (SELECT item_id, CASE item_id % 50 WHEN 1 THEN genres || '|' WHEN 2 THEN ' ' || genres WHEN 3 THEN genres || '|(no genres listed)' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE genres END AS g FROM it),
t AS (SELECT item_id, g, string_split(g, '|') AS p FROM f),
c AS (SELECT item_id, CASE WHEN g IS NULL OR list_contains(p, '') THEN 'empty' WHEN len(list_filter(p, lambda x: trim(x) <> x)) > 0 THEN 'space'
  WHEN list_contains(p, '(no genres listed)') AND len(p) > 1 THEN 'mixed' END AS fault FROM t)
SELECT item_id, fault FROM c WHERE fault IS NOT NULL"""))  # fmt: skip
def genre_grammar(spark, sf):
    """Every 50th item and its neighbours get a fault of each kind."""
    k = F.col("item_id") % 50
    broken = F.when(k == 1, F.concat("genres", F.lit("|"))).when(k == 2, F.concat(F.lit(" "), "genres")).when(k == 3, F.concat("genres", F.lit("|"), F.lit(views.NO_GENRE))).when(k == 4, F.lit(""))
    return val.genre_faults(views.raw_items(spark, sf).withColumn("genres", F.when(k == 5, F.lit(None)).otherwise(F.coalesce(broken, "genres"))))


@query(with_views("br", """
SELECT 'repeated' AS fault, count(*) - count(DISTINCT (item_id, genre)) AS n FROM br UNION ALL SELECT 'token', count(*) FILTER (genre = '' OR contains(genre, '|') OR trim(genre) <> genre) FROM br
UNION ALL SELECT 'item', count(DISTINCT item_id) FILTER (item_id NOT IN (SELECT item_id FROM sx)) FROM br UNION ALL SELECT 'genre', 0
""".replace("sx", "(SELECT p_partkey AS item_id FROM part WHERE p_partkey % 2 = 0)")))  # fmt: skip
def bridge_violations(spark, sf):
    b = views.bridge(spark, sf)
    return val.bridge_faults(b, views.raw_items(spark, sf).where("item_id % 2 = 0"), e.groups(b).withColumnRenamed("genre_id", "genre"))


@query(with_views("it br", """
, n AS (SELECT item_id, count(*) AS n FROM br WHERE item_id % 3 <> 0 GROUP BY item_id),
s AS (SELECT item_id, CASE WHEN genres = '(no genres listed)' THEN 'missing_in_source' ELSE 'listed' END AS genre_status FROM it)
SELECT s.item_id, genre_status, coalesce(n, 0) AS n FROM s LEFT JOIN n ON s.item_id = n.item_id WHERE (genre_status = 'listed') <> (coalesce(n, 0) > 0)"""))  # fmt: skip
def status_violations(spark, sf):
    """Statuses against a bridge that lacks every third item."""
    items = e.items(views.raw_items(spark, sf), views.links(spark, sf), check=False)
    return val.status_faults(items, views.bridge(spark, sf).where("item_id % 3 <> 0"))


@query(with_views("yr", """
, c AS (SELECT CASE WHEN item_id % 40 = 5 THEN -item_id WHEN item_id % 40 = 6 THEN item_id + 1 ELSE item_id END AS item_id, CASE WHEN item_id % 40 = 1 THEN ' ' WHEN item_id % 40 = 2 THEN NULL ELSE title END AS title,
  CASE WHEN item_id % 40 = 3 THEN 0 ELSE release_year END AS release_year, CASE WHEN item_id % 40 = 4 THEN 'unknown' WHEN item_id % 40 = 3 THEN NULL WHEN genres = '(no genres listed)' THEN 'missing_in_source' ELSE 'listed' END AS genre_status FROM yr)
SELECT item_id, 'title' AS fault FROM c WHERE title IS NULL OR trim(title) = '' UNION ALL SELECT item_id, 'year' FROM c WHERE release_year < 1 OR release_year > 9999
UNION ALL SELECT item_id, 'status' FROM c WHERE genre_status IS NULL OR genre_status NOT IN ('listed', 'missing_in_source') UNION ALL SELECT item_id, 'id' FROM c WHERE item_id IS NULL OR item_id < 1
UNION ALL SELECT item_id, 'repeated' FROM c WHERE item_id IS NOT NULL GROUP BY item_id HAVING count(*) > 1"""))  # fmt: skip
def canonical_item_faults(spark, sf):
    """Canonical items of which some of every 40 get a fault."""
    items, k = e.items(views.raw_items(spark, sf), views.links(spark, sf), check=False), F.col("item_id") % 40
    items = items.select(
        F.when(k == 5, -F.col("item_id")).when(k == 6, F.col("item_id") + 1).otherwise(F.col("item_id")).alias("item_id"),
        F.when(k == 1, " ").when(k == 2, F.lit(None)).otherwise(F.col("title")).alias("title"), F.when(k == 3, 0).otherwise(F.col("release_year")).alias("release_year"),
        F.when(k == 4, "unknown").when(k == 3, F.lit(None)).otherwise(F.col("genre_status")).alias("genre_status"),
    )
    return val.item_faults(items)


def _folder(spark) -> str:
    from ..sources.publish import scratch

    return scratch(spark)


@query(with_views("it lk", """
SELECT it.item_id + 1 AS "movieId", title || ', "' || genres || '"' AS title, CAST(imdb_id AS BIGINT) AS "imdbId", CAST(tmdb_id AS BIGINT) AS "tmdbId"
FROM it JOIN lk ON it.item_id = lk.item_id"""))  # fmt: skip
def typed_csv(spark, sf):
    """Titles with commas, quotes and doubled quotes, and links with missing numbers, written as CSV and read by schema."""
    from ..schemas import DATASETS
    from ..sources.scan import read_csv

    root = _folder(spark)
    title = F.concat("title", F.lit(', "'), "genres", F.lit('"')).alias("title")
    out = {"header": True, "quoteAll": True, "escape": '"'}
    views.raw_items(spark, sf).select((F.col("item_id") + 1).alias("movieId"), title, "genres").write.options(**out).csv(f"{root}/movies")
    views.links(spark, sf).select((F.col("item_id") + 1).alias("movieId"), F.col("imdb_id").alias("imdbId"), F.col("tmdb_id").alias("tmdbId")).write.options(header=True).csv(f"{root}/links")
    movies = read_csv(spark, f"{root}/movies", DATASETS["movies"]).select("movieId", "title")
    return movies.join(read_csv(spark, f"{root}/links", DATASETS["links"]), "movieId")


@query(with_views("re it", """
SELECT 'events' AS dataset, count(*) AS "rows" FROM re UNION ALL SELECT 'items', count(*) FROM it UNION ALL SELECT 'tags', count(*) FROM events"""))  # fmt: skip
def convert_report(spark, sf):
    """Tables written, read back, compared and put in place."""
    from ..sources.publish import convert_all

    frames = {"events": views.events(spark, sf), "items": views.raw_items(spark, sf), "tags": views.tags(spark, sf)}
    return convert_all(spark, frames, _folder(spark)).select("dataset", "rows")


@query("""
SELECT 'orders' AS dataset, 'o_custkey' AS "column", count(*) FILTER (o_custkey % 1000 = 1) AS nulls, count(*) FILTER (o_custkey % 1000 = 2 OR o_custkey < 1) AS out_of_domain FROM orders
UNION ALL SELECT 'orders', 'o_orderkey', 0, count(*) FILTER (o_orderkey % 777 = 0) FROM orders""")  # fmt: skip
def declared_domain_report(spark, sf):
    """Missing and impossible ids of orders of which some are broken on purpose."""
    from ..operators.validate import domain_report

    c, k = F.col("o_custkey"), F.col("o_orderkey")
    o = views.table(spark, sf, "orders").select(F.when(c % 1000 == 1, F.lit(None)).when(c % 1000 == 2, F.lit(0)).otherwise(c).alias("o_custkey"), F.when(k % 777 == 0, -k).otherwise(k).alias("o_orderkey"))
    return domain_report(o, "orders", {"o_custkey": (1, 2**32 - 1), "o_orderkey": (1, 2**32 - 1)})


SPLITS = [("train", None, "2000-01-01"), ("validation", "2000-01-01", "2001-01-01"), ("test", "2001-01-01", None)]
_SPLIT = "CASE WHEN ts < TIMESTAMP '2000-01-01' THEN 'train' WHEN ts < TIMESTAMP '2001-01-01' THEN 'validation' ELSE 'test' END"


@query(with_views("re", f"SELECT event_id, {_SPLIT} AS split FROM re"))
def temporal_splits(spark, sf):
    return views.events(spark, sf).select("event_id", p.split_label(F.col("event_us"), SPLITS).alias("split"))


@query(with_views("re", f"""
SELECT {_SPLIT} AS split, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS n, round(avg(CASE WHEN rating >= 4 THEN 1e0 ELSE 0e0 END), 6) AS prevalence FROM re GROUP BY 1"""))  # fmt: skip
def split_audit(spark, sf):
    s = views.events(spark, sf).withColumn("split", p.split_label(F.col("event_us"), SPLITS))
    high = (F.col("rating") >= 4).cast("double")
    return rounded(s.groupBy("split").agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count("*").alias("n"), F.avg(high).alias("prevalence")))


@query(with_views("re", "SELECT count(*) AS n, count(*) FILTER (rating >= 4) AS high, round(count(*) FILTER (rating >= 4) / CAST(count(*) AS DOUBLE), 6) AS prevalence FROM re"))
def target_prevalence(spark, sf):
    high = F.count_if(e.target(F.col("rating")))
    return rounded(views.events(spark, sf).agg(F.count("*").alias("n"), high.alias("high"), (high / F.count("*")).alias("prevalence")))


@query(with_views("re", "SELECT event_id, user_id, item_id, rating FROM re WHERE event_id % 97 = 0"))
def stride_sample(spark, sf):
    return p.stride_sample(views.events(spark, sf), "event_id", 97).select("event_id", "user_id", "item_id", "rating")


@query()
def seeded_sample(spark, sf):
    return p.seeded_sample(views.events(spark, sf).select("event_id", "user_id", "item_id", "rating"), "event_id", 500, 42)


@query(with_views("re it", "SELECT event_id, re.item_id, title FROM re JOIN it ON re.item_id = it.item_id WHERE rating = 5"))
def title_lookup(spark, sf):
    return views.events(spark, sf).where("rating = 5").join(views.raw_items(spark, sf), "item_id").select("event_id", "item_id", "title")


@query(with_views("re vec", "SELECT event_id, item_id FROM re WHERE item_id IN (SELECT item_id FROM vec)"))
def covered_events(spark, sf):
    from ..operators.vectors import vectors

    return views.events(spark, sf).join(vectors(views.scores(spark, sf)), "item_id", "left_semi").select("event_id", "item_id")


@query(with_views("re", "SELECT user_id FROM re INTERSECT SELECT user_id FROM events"))
def users_in_both(spark, sf):
    return views.events(spark, sf).select("user_id").intersect(views.tags(spark, sf).select("user_id"))


@query(with_views("re", "SELECT user_id FROM re EXCEPT SELECT user_id FROM events"))
def users_without_tags(spark, sf):
    return views.events(spark, sf).select("user_id").subtract(views.tags(spark, sf).select("user_id"))


@query(with_views("it", "SELECT item_id, len(string_split(genres, '|')) AS tokens, CASE WHEN genres = '(no genres listed)' THEN 1 ELSE 0 END AS sentinels FROM it"))
def genre_token_counts(spark, sf):
    t = views.raw_items(spark, sf).select("item_id", F.explode(F.split("genres", r"\|")).alias("g"))
    return t.groupBy("item_id").agg(F.count("*").alias("tokens"), F.count_if(F.col("g") == views.NO_GENRE).alias("sentinels"))
