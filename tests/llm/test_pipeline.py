"""The pipeline: its stages against plain versions on their own input."""

import numpy as np
import pytest

import corpus_pipeline as cp
from chronofold.llm import common, decontaminate, langid, quality
from chronofold.llm.common import table

from .test_group_operators import plain_similarity, roots
from .test_text_operators import plain, plain_quality, plain_sizes


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for name, stage in cp.STAGES:
        new = stage(spark, docs, sf)
        if name != "pack":
            assert new.columns == docs.columns
        new = new.cache()
        out.append((name, docs, new))
        docs = new
    return {n: (a, b) for n, a, b in out}


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_names_and_order():
    assert [n for n, _ in cp.STAGES] == ["quality_filter", "language_filter", "near_dedup", "decontamination", "pack"]


def test_quality_stage(stages, spark, sf):
    """The stage keeps what a plain version of its model, on its input, scores at 0.3 or more."""
    import zlib

    docs, kept = stages["quality_filter"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    labels = [(r["doc_id"], r["quality"]) for r in table(spark, sf, "labels").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    dictionaries, curve = plain_quality(rows, labels)
    model = quality.Model(good=dictionaries[0], bad=dictionaries[1])
    x, y = np.array([c[:3] for c in curve]), np.array([c[3] for c in curve])
    share = np.array([sum(q == k for _, q in labels) / (y == k).sum() for k in (0, 1)])
    model.knots = quality.choose_knots(x)
    model.mean, model.scale, model.weights = quality.fit_curve(quality.features(x, model.knots), y, share[y] * len(y) / share[y].sum())
    scores = quality.probability(model, np.array([plain_sizes(dictionaries, t) for _, t in rows]))
    assert ids(kept) == sorted(d for (d, _), s in zip(rows, scores, strict=True) if s >= 0.3)
    assert len(ids(kept)) < docs.count()


def test_language_stage(stages, spark):
    """The stage keeps what naive Bayes over the same counts, in plain Python, finds sure."""
    import math
    import zlib
    from collections import Counter

    docs, kept = stages["language_filter"]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    grams = {}
    for d, t, _ in rows:
        points = np.array([ord(c) for c in langid.letters(t or "")], dtype="<u4")
        grams[d] = Counter(int(b) for h in langid.grams(points) for b in h)
    counts, n = {}, Counter()
    for d, t, lang in rows:
        if lang is not None and t is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            n[lang] += 1
            counts.setdefault(lang, Counter()).update(grams[d])
    size = {x: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for x, c in counts.items()}
    want = []
    for d, t, _ in rows:
        if langid.letters(t or ""):
            total = {x: math.log(n[x] / sum(n.values())) + sum(k * math.log((counts[x][b] + langid.SMOOTHING) / size[x]) for b, k in grams[d].items()) for x in n}
            top = max(total.values())
            if 1 / sum(math.exp(v - top) for v in total.values()) >= cp.LANGUAGE_SCORE:
                want.append(d)
    assert ids(kept) == sorted(want)


def rows_to_go(rows):
    """Of (id, text): the ids that aren't the smallest of their group by a cosine of 0.8, and the groups by 0.7."""
    rows = sorted(rows)
    n = range(len(rows))
    links = [(a, b, j) for a in n for b in range(a) if (j := plain_similarity(rows[a][1], rows[b][1])) >= 0.54]
    sure, wide = (roots(len(rows), [(a, b) for a, b, j in links if j >= least]) for least in (0.67, 0.54))
    low, group = {}, {}
    for k in n:
        low.setdefault(sure[k], rows[k][0])
        group[rows[k][0]] = wide[k]
    return {rows[k][0] for k in n if rows[k][0] != low[sure[k]]}, group


def test_dedup_stage(stages):
    docs, kept = stages["near_dedup"]
    go, group = rows_to_go([(r["doc_id"], r["text"]) for r in docs.collect()])
    left = set(ids(kept))
    gone = set(ids(docs)) - left
    assert len(gone & go) >= 0.9 * len(go)
    # what goes has a smaller row of its wide group that stays
    for d in gone:
        assert any(group[k] == group[d] and k < d for k in left)


def test_dedup_of_repeated_ids(spark, sf):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "z y x w v"), (None, "a b c d e"), (None, "q r s t u"), (0, "z y x w v")], "doc_id long, text string")
    docs = docs.selectExpr("*", "'r' AS __row", "'k' AS __RANK", "'g' AS __gone", "'x' AS row", "'y' AS `group`")
    kept = cp.near_dedup(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(i, t, "r", "k", "g", "x", "y") for i, t in [(1, "a b c d e"), (0, "z y x w v"), (None, "q r s t u")]], key=repr)
    unique = docs.where("doc_id = 0").unionByName(docs.where("doc_id = 1 AND text LIKE 'z%'"))
    assert [tuple(r) for r in cp.near_dedup(spark, unique, sf).collect()] == [(0, "z y x w v", "r", "k", "g", "x", "y")]


def test_stages_on_odd_rows(spark, sf):
    """NULL and repeated ids, NULL texts and clashing names: a stage drops rows, and only those that it should."""
    passage = table(spark, sf, "benchmark").orderBy("item_id").first()["text"]
    good = [r["text"] for r in table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").where("quality = 1 AND length(text) > 500").orderBy("doc_id").limit(2).collect()]
    rows = [(1, f"{good[0]} {passage}"), (1, good[0]), (None, f"{good[1]} {passage}"), (None, good[1]), (2, None), (2, ""), (2, good[1])]
    names = ["__hit", "__key", "score", "quality", "lang", "text_key", "n", "fp"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'{c}' AS `{c}`" for c in names])
    kept = cp.decontamination(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([r for r in rows if passage not in (r[1] or "")], key=repr)
    assert all(r[c] == c for r in kept.collect() for c in names)
    for stage in (cp.quality_filter, cp.language_filter):
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns
        assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
    assert {(r["doc_id"], r["text"]) for r in cp.quality_filter(spark, docs, sf).collect()} >= {r for r in rows if r[1] in good}
    assert cp.pack(spark, docs, sf).agg({"doc_id": "count"}).first()[0] >= 5


def test_decontamination_stage(stages, spark, sf):
    docs, kept = stages["decontamination"]
    found = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()])
    assert ids(kept) == sorted(r[0] for r in found if not r[-1])
    assert decontaminate.find(kept, table(spark, sf, "benchmark")).where("contaminated").count() == 0


def test_pack_stage_and_run(stages, spark, sf):
    docs, packed = stages["pack"]
    assert sorted(set(ids(packed))) == ids(docs)
    with common.recorded() as outer:
        other = common.store(docs, "of-another")
        again = cp.run(spark, sf)
    assert len(outer) == 1 and other.count() == docs.count()  # a run records and deletes its own tables alone
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, again.select(*columns).collect())) == sorted(map(tuple, packed.select(*columns).collect()))
    assert again.agg({"length": "sum"}).first()[0] == packed.agg({"length": "sum"}).first()[0]


def test_no_documents(spark, tmp_path, sf):
    import shutil

    for t in ("labels", "benchmark"):
        shutil.copy(f"{sf}/{t}.parquet", tmp_path)
    table(spark, sf, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
