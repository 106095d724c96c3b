"""Benchmark decontamination by winnowing, with DataFrame functions alone.

Of each run of ``WINDOW`` consecutive ``K``-word hashes of a text the smallest is its fingerprint, so two texts that share
``K + WINDOW - 1`` = 10 words in a row share a fingerprint. Fingerprints of documents are joined with those of benchmark
items. A document with a hit is read again, and its hits are extended over the whole of it: each of its 10-word windows is
compared, by two independent hashes of 64 bits, with the windows of the items, and the words under matching windows are
counted. An item of fewer than 10 words is one window and its own fingerprint.

The items' fingerprints are broadcast while there are ``BROADCAST`` of them at most, and joined by a shuffle beyond it.

Defined results: a NULL text has no words; items with a NULL id or without words don't count; items that share an id are
one item; a text without hits has the hash of the empty string as ``items_sha256``; repeated ids and rows each give a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_enough, store, table, unused

SPAN, K = 10, 5
WINDOW = SPAN - K + 1
BROADCAST = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    # lower() would also change letters beyond ASCII
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _shift(array: Column, by: int) -> Column:
    return F.slice(array, by + 1, F.size(array))


def with_grams(df: DataFrame, base: str, prefix: str, lengths: list[int]) -> DataFrame:
    """Adds ``{prefix}{m}`` for each m: hashes of m words from each place on, garbage in the last m - 1 places.

    Built by halves, each array once, as a projection of its own.
    """
    done = {1: base}

    def build(df: DataFrame, m: int) -> DataFrame:
        if m in done:
            return df
        left = m // 2 if m % 2 == 0 else m - 1
        df = build(df, left)
        right = done[left] if m % 2 == 0 else base
        done[m] = f"{prefix}{m}"
        return df.withColumn(done[m], F.zip_with(done[left], _shift(F.col(right), left), lambda a, b: F.xxhash64(a, b)))

    for m in sorted(set(lengths)):
        df = build(df, m)
        if m == 1:
            df = df.withColumn(f"{prefix}1", F.col(base))
    return df


def second(word: Column) -> Column:
    """A hash of a word that doesn't follow from the first one: its seed comes before the word."""
    return F.xxhash64(F.lit(1), word)


def _whole(array: str, m: int) -> Column:
    """The places of ``{array}`` that hold m whole words."""
    return F.slice(array, 1, F.greatest(F.size("w") - (m - 1), F.lit(0)))


def with_words(df: DataFrame) -> DataFrame:
    """Adds w, the words, and h, their hashes."""
    df = df.withColumn("w", words(F.col("text")))
    return df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """Adds ``fps``: the winnowed hashes of a text with ``w`` and ``h``, and all hashes of ``short`` lengths."""
    df = with_grams(df, "h", "g", [K, *short])
    low = lambda a, b: F.least(a, b)
    df = df.withColumn("k", _whole(f"g{K}", K))
    df = df.withColumn("m2", F.zip_with("k", _shift(F.col("k"), 1), low))
    df = df.withColumn("m3", F.zip_with("m2", _shift(F.col("k"), 2), low))
    # the windows at the end are cut short: they add fingerprints, and lose none
    df = df.withColumn("m6", F.zip_with("m3", _shift(F.col("m3"), WINDOW - 3), low))
    return df.withColumn("fps", F.array_distinct(F.concat("m6", *[_whole(f"g{m}", m) for m in short])))


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) to doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key.

    ``text_key`` is the hash of the text: with doc_id it tells which row was hit where ids repeat or are NULL.
    """
    items = with_words(items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL"))
    items = store(items.select("item_id", "w", "h").where(F.size("w") > 0), "items")
    short = sorted(r[0] for r in items.where(F.size("w") < SPAN).select(F.size("w")).distinct().collect())  # 9 numbers at most
    long_items, few = F.size("w") >= SPAN, [*short]
    own = fingerprints(items, few)
    marks = own.where(long_items).select(F.explode("m6").alias("fp"))
    for m in few:
        marks = marks.unionByName(own.where(F.size("w") == m).select(F.col(f"g{m}")[0].alias("fp")))
    marks = store(marks.distinct(), "marks")
    hint = F.broadcast if small_enough(marks, BROADCAST) else (lambda x: x)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = base.withColumn("key", F.xxhash64("text"))
    prints = fingerprints(with_words(keyed), few).select("doc_id", "key", F.size("w").cast("long").alias("n_words"), "fps")
    # a row for the document itself, then one for each fingerprint; explode() would put a filter with a copy of every array
    # function below itself
    rows = prints.select("doc_id", "key", "n_words", F.explode_outer(F.concat(F.array(F.lit(None).cast("long")), "fps")).alias("fp"))
    hits = rows.join(hint(marks.withColumn("marked", F.lit(True))), "fp", "left").where("fp IS NULL OR marked")
    found = store(hits.select("doc_id", "key", "n_words", F.col("fp").isNull().alias("itself")), "winnowed")

    chosen = found.where("NOT itself").select("doc_id", "key").distinct()
    near = F.broadcast if small_enough(chosen, BROADCAST) else (lambda x: x)
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    again = with_words(keyed.join(near(chosen), same(keyed, chosen), "left_semi")).withColumn("h_b", F.transform("w", second))
    spans = sorted({*few, SPAN})
    windows = _windows(again, spans, ["doc_id", "key"])
    of_items = _windows(items.withColumn("h_b", F.transform("w", second)), spans, ["item_id", F.least(F.size("w"), F.lit(SPAN)).alias("length")])
    of_items = store(of_items.where("span = length").select("item_id", "span", "a", "b").distinct(), "item-windows")
    hint = F.broadcast if small_enough(of_items, BROADCAST) else (lambda x: x)
    covered = store(windows.join(hint(of_items), ["span", "a", "b"]).select("doc_id", "key", "item_id", "place", "span").distinct(), "covered")

    places = covered.groupBy("doc_id", "key", "place").agg(F.max("span").alias("span"))
    before = F.max(F.col("place") + F.col("span")).over(W.partitionBy("doc_id", "key").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.col("place") + F.col("span") - F.greatest("place", F.coalesce(before, F.lit(0)))
    n_hit = places.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("doc_id", "key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    who = covered.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    of = n_hit.join(who, same(n_hit, who)).select(n_hit["doc_id"], n_hit["key"], "n_hit", "ids")
    docs_again = found.where("itself")
    out = docs_again.join(of, same(docs_again, of), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        docs_again["doc_id"], "n_words", n.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (n > 0).alias("contaminated"), docs_again["key"].alias("text_key"),
    )


def _windows(df: DataFrame, spans: list[int], keep: list) -> DataFrame:
    """(keep, span, place, a, b): every window of each span, with two hashes."""
    df = with_grams(with_grams(df, "h", "g", spans), "h_b", "e", spans)
    parts = [F.arrays_zip(_whole(f"g{m}", m).alias("a"), _whole(f"e{m}", m).alias("b")).alias(f"z{m}") for m in spans]
    df = df.select(*keep, *parts)
    names = [c for c in df.columns if not c.startswith("z")]
    out = None
    for m in spans:
        part = df.select(*names, F.lit(m).alias("span"), F.posexplode_outer(f"z{m}").alias("place", "z")).where("place IS NOT NULL").select(*names, "span", "place", "z.a", "z.b")
        out = part if out is None else out.unionByName(part)
    return out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def select(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without any window of ``items``, as they are.

    Rows are told apart by id and text, so a clean row stays where another one of its id, or of no id, goes.
    """
    id_, key = unused(docs, "__hit"), unused(docs, "__key")
    hit = find(docs, items).where("contaminated").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    hit = store(hit, "hits")
    side = F.broadcast(hit) if small_enough(hit, BROADCAST) else hit
    return docs.join(side, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left_anti")


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0 AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bi),
ks AS (SELECT DISTINCT k FROM win),
di AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN ks),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM di),
hit AS (SELECT rid, i, dw.k AS k, item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM hit)) GROUP BY rid),
who AS (SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hit GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.rid = pos.rid LEFT JOIN who ON d.rid = who.rid
"""
