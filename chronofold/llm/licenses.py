"""Licence scans by a positional index of rare words, with DataFrame functions alone.

Licence texts are entries: phrases, which must stand word for word, and templates, which may differ in some words. The index
holds, for each entry, the places of its words of the highest inverse document frequency (counted over all files scanned), so
common words are never looked up. A file's words that are in the index give postings; place in the file less place in the
entry is where the entry would begin, and postings of an entry that agree on it are intersected:

* a phrase needs all its rare words at one beginning, and then all its words are compared;
* a template needs rare words of at least ``COVER`` of its weight within ``BAND`` words of drift, and each of its mandatory key
  phrases, which are phrases themselves, at its place in the same band.

The index grows with the entries, not with the files, and is broadcast while it has ``BROADCAST`` postings at most. Files are
read twice: for the frequencies and for the scan.

Defined results: a NULL text has no words; repeated ids and rows each give a row, a NULL id stays; no rows give no rows; other columns aren't read.
"""

from __future__ import annotations

from math import log
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_enough, store, table
from .decontaminate import words


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]


# Phrases that are a licence by themselves, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Notices of public licences, and what must not differ in them.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template(
        "gpl-2",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
        ("gnu general public license", "version 2"),
    ),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc0", "the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Rare words of a phrase and of a template in the index, at most; never more than half of the words.
PHRASE_WORDS, TEMPLATE_WORDS = 2, 6
#: Share of a template's weight that must be there; words that its beginning may drift.
COVER, BAND = 0.75, 32
BROADCAST = 1_000_000


class Posting(NamedTuple):
    word: str
    entry: int
    offset: int
    weight: int
    need: int  # postings of the entry
    total: int  # their weight
    phrase: list[str] | None  # of a phrase, all its words


def entries(phrases=PHRASES, templates=TEMPLATES) -> tuple[list[tuple[str, ...]], list[tuple[str, ...]], dict]:
    """Phrases (key phrases too) and templates as words, and the labels of phrases that have one."""
    keys = dict.fromkeys(tuple(k.split()) for t in templates for k in t.keys)
    known = dict.fromkeys([*(tuple(p.split()) for p, _ in phrases), *keys])
    return list(known), [tuple(t.text.split()) for t in templates], {tuple(p.split()): label for p, label in phrases}


def postings(frequency: dict[str, int], files: int, phrases=PHRASES, templates=TEMPLATES) -> list[Posting]:
    """The index. Phrases are numbered from 0, templates after them."""
    known, texts, _ = entries(phrases, templates)
    weight = lambda w: 1 + round(1000 * log((files + 1) / (frequency.get(w, 0) + 1)))
    out = []
    for i, text in enumerate([*known, *texts]):
        most = PHRASE_WORDS if i < len(known) else TEMPLATE_WORDS
        rare = sorted(set(text), key=lambda w: (frequency.get(w, 0), w))[: min(most, (len(text) + 1) // 2)]
        found = [(w, k, weight(w)) for k, w in enumerate(text) if w in rare]
        out += [Posting(w, i, k, n, len(found), sum(f[2] for f in found), list(text) if i < len(known) else None) for w, k, n in found]
    return out


def frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many files each word of ``vocabulary`` is, and how many files there are; the vocabulary is that of the entries."""
    mine = F.array_distinct(F.filter(words(F.col("text")), lambda w: w.isin(vocabulary)))
    # a NULL for the file itself, and explode_outer, which puts no filter with a copy of the array functions below itself
    each = files.select(F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), mine)).alias("word"))
    found = dict(each.groupBy("word").count().collect())
    return found, found.pop(None, 0)


def _hits(files: DataFrame, index: DataFrame, looked_up: list[str], widest: int) -> DataFrame:
    """(row, doc_id, n_words, entry, offset, weight, need, total, phrase, start, same): a row a posting, and one for the file itself.

    ``same`` tells whether the words from ``start`` on are the phrase.
    """
    rows = files.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    at = F.array_compact(F.transform("w", lambda w, i: F.when(w.isin(looked_up), i)))
    rows = rows.select("row", "doc_id", "w", at.alias("at"))
    around = lambda p: F.slice("w", F.greatest(p - (widest - 2), F.lit(1)), F.lit(2 * widest - 1))
    hit = F.transform("at", lambda p: F.struct(p.alias("place"), F.get(F.col("w"), p).alias("word"), around(p).alias("around")))
    nothing = F.struct(F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("array<string>").alias("around"))
    rows = rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.explode_outer(F.concat(F.array(nothing), hit)).alias("h"))
    rows = rows.select("row", "doc_id", "n_words", "h.*").join(index, "word", "left")
    start = F.col("place") - F.col("offset")
    inside = start - F.greatest(F.col("place") - (widest - 1), F.lit(0)) + 1
    same = F.when(F.col("phrase").isNotNull() & (start >= 0), F.slice("around", F.greatest(inside, F.lit(1)), F.size("phrase")) == F.col("phrase"))
    return rows.select("row", "doc_id", "n_words", "entry", "offset", "weight", "need", "total", start.cast("long").alias("start"), same.alias("same"))


def scan(files: DataFrame, phrases=PHRASES, templates=TEMPLATES, cover: float = COVER, band: int = BAND) -> DataFrame:
    """(doc_id, text) to (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, weakest).

    ``base_labels`` are those of ``phrases`` found, ``labels`` those of templates too; ``score`` is 1 with such a phrase, else the largest share of
    a template's weight in a band; ``weakest`` is the smallest share among the labels' templates.
    """
    spark = files.sparkSession
    known, texts, labels = entries(phrases, templates)
    frequency, n = frequencies(files, sorted({w for e in [*known, *texts] for w in e}))
    found = postings(frequency, n, phrases, templates)
    index = spark.createDataFrame(found, "word string, entry int, offset int, weight long, need int, total long, phrase array<string>")
    index = F.broadcast(index) if len(found) <= BROADCAST else index
    hits = store(_hits(files, index, sorted({p.word for p in found}), max(map(len, known))), "postings")

    of_phrases = hits.where(F.col("entry") < len(known)).groupBy("row", "entry", "start").agg(F.count("*").alias("n"), F.max("need").alias("need"), F.max("same").alias("same"))
    of_phrases = store(of_phrases.where("n = need AND same").select("row", "entry", "start"), "phrases")
    base = [(i, labels[p]) for i, p in enumerate(known) if p in labels]
    base = of_phrases.join(F.broadcast(spark.createDataFrame(base, "entry int, label string")), "entry")

    # where the key phrases put their templates
    keys = [(known.index(tuple(k.split())), len(known) + i, _place(texts[i], k.split()), len(t.keys)) for i, t in enumerate(templates) for k in t.keys]
    keys = spark.createDataFrame(keys, "key int, entry int, offset int, keys int")
    keys = F.broadcast(keys) if small_enough(keys, BROADCAST) else keys
    of_keys = of_phrases.withColumnRenamed("entry", "key").join(keys, "key").select("row", "entry", (F.col("start") - F.col("offset")).alias("start"), "key", "keys")
    none = lambda kind: F.lit(None).cast(kind)
    rare = hits.where(F.col("entry") >= len(known)).select("row", "entry", "start", none("int").alias("key"), none("int").alias("keys"), F.struct("offset", "weight").alias("word"), "total")
    both = rare.unionByName(of_keys.select("*", none("struct<offset:int,weight:bigint>").alias("word"), none("long").alias("total")))
    # bands overlap by half, so that what drifts by half a band is in one
    bands = F.array(2 * F.floor(F.col("start") / band), 2 * F.floor((F.col("start") + band // 2) / band) + 1)
    both = both.withColumn("band", F.explode(bands)).groupBy("row", "entry", "band")
    both = both.agg(F.collect_set("word").alias("words"), F.max("total").alias("total"), F.count_distinct("key").alias("n"), F.max("keys").alias("keys"))
    share = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + w["weight"]) / F.col("total")
    both = both.withColumn("share", F.coalesce(share, F.lit(0.0))).withColumn("whole", F.coalesce((F.col("n") == F.col("keys")) & (F.col("share") >= cover), F.lit(False)))
    names = F.broadcast(spark.createDataFrame([(len(known) + i, t.label) for i, t in enumerate(templates)], "entry int, label string"))
    both = both.join(names, "entry").select("row", F.when(F.col("whole"), F.col("label")).alias("label"), "share", F.when(F.col("whole"), F.col("share")).alias("weakest"))

    null = {c: none(k).alias(c) for c, k in (("doc_id", "long"), ("n_words", "long"), ("start", "long"), ("base", "string"), ("label", "string"), ("share", "double"), ("weakest", "double"))}
    all_ = lambda df, *has: df.select("row", *[c if c in has else null[c] for c in null])
    rows = all_(hits.where("entry IS NULL").dropDuplicates(["row"]), "doc_id", "n_words")
    rows = rows.unionByName(all_(base.withColumn("base", F.col("label")), "start", "base", "label")).unionByName(all_(both, "label", "share", "weakest"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = rows.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count("start").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"),
        joined("base").alias("base_labels"), joined("label").alias("labels"), F.when(F.count("start") > 0, 1.0).otherwise(F.coalesce(F.max("share"), F.lit(0.0))).alias("score"),
        F.min("weakest").alias("weakest"),
    )
    return out.drop("row")


def _place(text: tuple[str, ...], key: list[str]) -> int:
    for i in range(len(text) - len(key) + 1):
        if list(text[i : i + len(key)]) == key:
            return i
    raise ValueError(f"{' '.join(key)!r} isn't in its template")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The scan in SQL: the entries are a table of values, all else follows from it."""
    known, texts, labels = entries()
    quote = lambda s: "'" + s + "'"
    entry = [f"({i}, {quote(' '.join(e))}, {quote(labels[e]) if e in labels else 'NULL'}, {i < len(known)})" for i, e in enumerate(known)]
    entry += [f"({len(known) + i}, {quote(t.text)}, {quote(t.label)}, false)" for i, t in enumerate(TEMPLATES)]
    key = [f"({known.index(tuple(k.split()))}, {len(known) + i}, {_place(texts[i], k.split())}, {len(t.keys)})" for i, t in enumerate(TEMPLATES) for k in t.keys]
    return rf"""
WITH entry(id, txt, label, phrase) AS (VALUES {", ".join(entry)}),
keyed(k, id, o, n_keys) AS (VALUES {", ".join(key)}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), ew AS (SELECT id, phrase, len(ws) AS m, ws[i] AS word, i - 1 AS o FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT *, string_split(txt, ' ') AS ws FROM entry))),
dw AS (SELECT rid, w[i] AS word, i - 1 AS p FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
df AS (SELECT word, count(DISTINCT rid) AS f FROM dw WHERE word IN (SELECT word FROM ew) GROUP BY word),
ranked AS (
  SELECT id, word, any_value(phrase) AS phrase, any_value(m) AS m, any_value(coalesce(f, 0)) AS f,
    row_number() OVER (PARTITION BY id ORDER BY any_value(coalesce(f, 0)), word) AS rk
  FROM ew LEFT JOIN df USING (word) GROUP BY id, word
), rare AS (SELECT id, word, CAST(1 + round(1000 * ln(((SELECT count(*) FROM d) + 1) / (f + 1))) AS BIGINT) AS wt FROM ranked WHERE rk <= least(CASE WHEN phrase THEN {PHRASE_WORDS} ELSE {TEMPLATE_WORDS} END, (m + 1) // 2)),
post AS (SELECT ew.id, ew.phrase, ew.word, ew.o, rare.wt, sum(wt) OVER (PARTITION BY ew.id) AS total FROM ew JOIN rare ON ew.id = rare.id AND ew.word = rare.word),
hit AS (SELECT dw.rid, post.*, dw.p - post.o AS s FROM dw JOIN post ON dw.word = post.word),
ph AS (
  SELECT DISTINCT h.rid, h.id, h.s, entry.label FROM hit h JOIN entry ON entry.id = h.id JOIN d ON d.rid = h.rid
  WHERE h.phrase AND h.s >= 0 AND array_to_string(d.w[h.s + 1:h.s + len(string_split(entry.txt, ' '))], ' ') = entry.txt
), base AS (SELECT rid, s, label FROM ph WHERE label IS NOT NULL),
pieces AS (
  SELECT rid, id, s, o, wt, total, NULL AS k, NULL AS n_keys FROM hit WHERE NOT phrase
  UNION ALL SELECT ph.rid, keyed.id, ph.s - keyed.o, NULL, NULL, NULL, keyed.k, keyed.n_keys FROM ph JOIN keyed ON keyed.k = ph.id
), banded AS (
  SELECT *, 2 * CAST(floor(s / {BAND}.0) AS BIGINT) AS b FROM pieces
  UNION ALL SELECT *, 2 * CAST(floor((s + {BAND // 2}) / {BAND}.0) AS BIGINT) + 1 FROM pieces
), once AS (SELECT DISTINCT rid, id, b, o, wt, total, k, n_keys FROM banded),
share AS (
  SELECT rid, id, b, coalesce(sum(wt) / max(total), 0.0) AS share, count(k) AS n, max(n_keys) AS n_keys FROM once GROUP BY rid, id, b
), tmpl AS (SELECT rid, label, share, coalesce(n = n_keys AND share >= {COVER}, false) AS whole FROM share JOIN entry ON entry.id = share.id),
parts AS (
  SELECT rid, s, label AS base, label, CAST(NULL AS DOUBLE) AS share, CAST(NULL AS DOUBLE) AS weakest FROM base
  UNION ALL SELECT rid, NULL, NULL, CASE WHEN whole THEN label END, share, CASE WHEN whole THEN share END FROM tmpl
), agg AS (
  SELECT rid, count(s) AS n_base, min(s) AS first_word, max(s) AS last_word, array_to_string(list_sort(list(DISTINCT base) FILTER (base IS NOT NULL)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ',') AS labels, max(share) AS share, min(weakest) AS weakest FROM parts GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS DOUBLE) AS score, weakest
FROM d LEFT JOIN agg ON d.rid = agg.rid
"""


OP12_SQL = _sql()
