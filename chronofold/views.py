"""The synthetic tables as the engine's canonical tables, in Spark and in SQL.

events: event_id, user_id, item_id, rating (0.5 to 5 by halves), event_us, ts; items: item_id, title, genres; links; tags;
scores (item_id, tag_id, relevance) and their vectors. ``SQL`` has the same as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import micros, release_year
from .sources.scan import row_identity

NO_GENRE = "(no genres listed)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = row_identity(table(spark, sf_dir, "lineitem"), "event_id").select(
        "event_id", F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("item_id"),
        (((F.col("l_quantity").cast("long") - 1) % 10 + 1).cast("double") / 2).alias("rating"), F.col("l_shipdate").alias("ts"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("user_id"))
    return lines.join(orders, "k").select("event_id", "user_id", "item_id", "rating", micros("ts").alias("event_us"), "ts")


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    year = F.when(k % 17 == 0, F.lit(" (0000)")).when(k % 10 == 0, F.lit("")).otherwise(F.concat(F.lit(" ("), (1980 + k % 25).cast("string"), F.lit(")")))
    genres = F.when(k % 13 == 0, F.lit(NO_GENRE)).otherwise(F.replace("p_name", F.lit(" "), F.lit("|")))
    return table(spark, sf_dir, "part").select(k.alias("item_id"), F.concat("p_name", year).alias("title"), genres.alias("genres"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").where(k % 11 != 0).select(k.alias("item_id"), (k + 1).alias("imdb_id"), F.when(k % 7 != 0, k + 2).alias("tmdb_id"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("tag"), "ts")


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, genre), one row a pair."""
    return raw_items(spark, sf_dir).where(F.col("genres") != NO_GENRE).select("item_id", F.explode(F.split("genres", r"\|")).alias("genre")).distinct()


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, release_year, genres array, empty where none are listed)."""
    listed = F.when(F.col("genres") != NO_GENRE, F.array_distinct(F.split("genres", r"\|"))).otherwise(F.array().cast("array<string>"))
    return raw_items(spark, sf_dir).select("item_id", release_year("title").alias("release_year"), listed.alias("genres"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, tag_id, relevance): some items lack a tag, some have all zero."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.posexplode("embedding").alias("pos", "x"))
    relevance = F.when(F.col("item_id") % 31 == 0, F.lit(0.0)).otherwise((F.col("x").cast("double") + 1) / 2).cast("float")
    return e.where("NOT (item_id % 29 = 0 AND pos = 5)").select("item_id", (F.col("pos") + 1).alias("tag_id"), relevance.alias("relevance"))


SQL = {
    "re": """re AS (
  SELECT l.event_id, o.o_custkey AS user_id, l.l_partkey AS item_id, CAST((CAST(l.l_quantity AS BIGINT) - 1) % 10 + 1 AS DOUBLE) / 2 AS rating,
    epoch_us(l.l_shipdate) AS event_us, l.l_shipdate AS ts
  FROM (SELECT *, row_number() OVER () AS event_id FROM lineitem) l JOIN orders o ON l.l_orderkey = o.o_orderkey)""",
    "it": """it AS (
  SELECT p_partkey AS item_id,
    p_name || CASE WHEN p_partkey % 17 = 0 THEN ' (0000)' WHEN p_partkey % 10 = 0 THEN '' ELSE ' (' || (1980 + p_partkey % 25) || ')' END AS title,
    CASE WHEN p_partkey % 13 = 0 THEN '(no genres listed)' ELSE replace(p_name, ' ', '|') END AS genres
  FROM part)""",
    "yr": """yr AS (
  SELECT item_id, title, genres, CAST(nullif(nullif(regexp_extract(trim(title), '\\((\\d{4})\\)$', 1), ''), '0000') AS INTEGER) AS release_year FROM it)""",
    "br": """br AS (
  SELECT DISTINCT item_id, unnest(string_split(genres, '|')) AS genre FROM it WHERE genres <> '(no genres listed)')""",
    "lk": """lk AS (
  SELECT p_partkey AS item_id, p_partkey + 1 AS imdb_id, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey + 2 END AS tmdb_id FROM part WHERE p_partkey % 11 <> 0)""",
    "sc": """sc AS (
  SELECT item_id, pos AS tag_id, CAST(CASE WHEN item_id % 31 = 0 THEN 0 ELSE (CAST(x AS DOUBLE) + 1) / 2 END AS FLOAT) AS relevance
  FROM (SELECT vec_id AS item_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) WHERE NOT (item_id % 29 = 0 AND pos = 6))""",
    "vec": """vec AS (
  SELECT item_id, v, sqrt(list_dot_product(v, v)) AS size FROM (
    SELECT item_id, list(CAST(relevance AS DOUBLE) ORDER BY tag_id) AS v FROM sc GROUP BY item_id HAVING count(*) = (SELECT count(DISTINCT tag_id) FROM sc))
  WHERE list_dot_product(v, v) > 0)""",
}
_NEEDS = {"yr": ("it",), "br": ("it",), "vec": ("sc",)}


def with_views(names: str, body: str) -> str:
    """``body`` after the common table expressions ``names``; what they need comes with them. ``body`` may go on with more."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    text = body.strip()
    rest = ",\n" + text[1:].lstrip() if text.startswith(",") else "\n" + text
    return "WITH " + ",\n".join(SQL[n] for n in order) + rest
