"""Collocations against plain counting, and against SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from chronofold.llm import collocations

KIND = "doc_id long, text string, lang string"


def plain(rows, least, longest=5, percent=100, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for i in range(len(w)) for k in range(1, longest + 1) if i + k <= len(w))
    some = {p: c for p, c in f.items() if c >= least and len(p) > 2}
    out = []
    for (lang, *w), a in some.items():
        inside = lambda v, w=w: any(list(v[i : i + len(w)]) == w for i in range(len(v) - len(w) + 1))
        if any(v[0] == lang and len(v) - 1 > len(w) and inside(v[1:]) and 100 * c >= percent * a for v, c in some.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    rank, got = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(got)


def run(spark, rows, least, **more):
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = collocations.collocations(df, least, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    return sorted(map(tuple, got))


def sample(seed=3, docs=150):
    rng = random.Random(seed)
    pool = ["the", "The", "of", "new", "york", "city", "ÄB", "äb", "x-y", "é", "hot", "dog", "\x1c", "a\xa0b", "NEW"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", ";", "\n", "\r\n", "\x0b", "\x0c", "!?", ":"]
    rows = [(i, "".join(rng.choice(pool) + rng.choice(ends) for _ in range(rng.randint(0, 80))), rng.choice(["en", "de", None, "und"])) for i in range(docs)]
    rows += [(500 + i, "big bad wolf ran home. big bad wolf", "en") for i in range(12)]
    return [*rows, (900, None, "en"), (901, "", None), (902, " .,;", "fr"), (None, "new york", None), (None, "new york", None), (903, "word " * 20_000, "en")]


def test_counts_scores_and_subsumption(spark):
    rows = sample()
    for least, percent in ((10, 100), (5, 60)):
        want = plain(rows, least, percent=percent)
        assert len(want) > 30
        assert run(spark, rows, least, percent=percent) == want


def test_a_crowded_sketch_loses_and_adds_nothing(spark, monkeypatch):
    rows = sample(4, 60)
    want = plain(rows, 6)
    monkeypatch.setattr(collocations, "NARROWEST", 4)
    monkeypatch.setattr(collocations, "HELD", 10)
    assert run(spark, rows, 6, widest=4) == want  # 16 cells: all of them are full


def test_many_runs_and_blocks(spark, monkeypatch):
    rows = sample(5, 80)
    for name, value in (("RUN", 50), ("BLOCK", 6), ("HELD", 40)):
        monkeypatch.setattr(collocations, name, value)
    for least in (6, 300):  # counts of a byte, and of more
        assert run(spark, rows, least) == plain(rows, least)


def test_rare_phrases_do_not_survive_in_large_texts(spark):
    """Cells come with the texts, without a widest row: past 2^24 cells all of them filled up, and every phrase was counted and shuffled."""
    assert collocations.row_width(10 << 30) >= (10 << 30) // collocations.SPARE
    assert collocations.row_width(80 << 30) == 8 * collocations.row_width(10 << 30)
    rows = [(" ".join(f"r{i}x{k}" for k in range(2000)) + " often" * 10, "en") for i in range(20)]
    texts = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    width = 1 << 34  # of some 50 GB
    bits, size = collocations.survivors(texts, width, 100)
    some = collocations.Texts(*map(list, zip(*rows, strict=True)))
    kept = 0
    for _, _, h in some.hashes(1):
        cell = collocations._mix(collocations.cells(h, 0, width).astype(np.uint64))
        at = [collocations._filtered(cell, r, size) for r in range(2)]
        hit = np.logical_and.reduce([(bits[r, at[r] >> 3] >> (at[r] & 7).astype(np.uint8) & 1).astype(bool) for r in range(2)])
        kept += int(hit.sum())
    assert 200 <= kept < 200 + 40_000 // 50


def test_first_of_each_language_and_ties(spark):
    rows = [(i, ". ".join(f"a{k} b{k}" for k in range(40)), lang) for i, lang in enumerate(["en"] * 7 + ["de"] * 6)]
    assert run(spark, rows, 6, top=5) == plain(rows, 6, top=5)
    assert run(spark, [], 1) == []
    assert run(spark, rows, 1000) == []


def test_products_past_64_bits(spark):
    counts = spark.createDataFrame([("en", 1, "a", 4 * 10**12), ("en", 1, "b", 3 * 10**12 + 1), ("en", 2, "a b", 2 * 10**12)], "lang string, k int, phrase string, c long")
    words = spark.createDataFrame([("en", 9 * 10**14 + 7)], "lang string, n long")
    got = collocations.score(counts, words).collect()
    assert [(r.score, r.l, r.r) for r in got] == [(1000 * 2 * 10**12 * (9 * 10**14 + 7) // (4 * 10**12 * (3 * 10**12 + 1)), 4 * 10**12, 3 * 10**12 + 1)]


def test_sketches_never_count_too_little():
    rng = np.random.RandomState(0)
    some = collocations.Texts([" ".join(f"w{x}" for x in rng.zipf(1.5, 3000))], ["en"])
    width, rows = 1 << 10, np.zeros((2, 1 << 10), np.int64)
    exact = Counter()
    for k, place, h in some.hashes(5):
        exact.update(h.tolist())
        for r in range(2):
            np.add.at(rows[r], collocations.cells(h, r, width), 1)
        assert len(place) == 3000 - k + 1
    h = np.array(list(exact), dtype=np.uint64)
    low = np.minimum(*[rows[r, collocations.cells(h, r, width)] for r in range(2)])
    assert (low >= np.array(list(exact.values()))).all()


def test_extra_columns(spark):
    df = spark.createDataFrame([("x y. x y", "en", 1, "p", 2)], "text string, lang string, n int, phrase string, k int")
    assert [(r.phrase, r.a) for r in collocations.collocations(df, 2).collect()] == [("x y", 2)]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query_matches_sql(spark, duck, same, folder):
    got = collocations.op13_phrase_collocations(spark, folder).toPandas()
    assert len(got) > 20
    same(got, duck(collocations.OP13_SQL, folder))
