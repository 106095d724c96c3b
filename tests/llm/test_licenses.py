"""The licence scan against a plain scan of every place, and against SQL."""

import random
import re

import pytest

from chronofold.llm import licenses

KIND = "doc_id long, text string"


def plain(rows):
    """Base columns by looking at every place of every text."""
    out = []
    for doc, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        found = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in found]
        out.append((doc, len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    return sorted(out, key=str)


def run(spark, rows, **more):
    return licenses.scan(spark.createDataFrame(rows, KIND).repartition(3), **more).collect()


def base(got):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str)


def test_base_places_and_odd_texts(spark):
    rng = random.Random(5)
    pool = "under the mit license apache license version 2 cc by nc MIT License, x 2.0".split()
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(200 + i, f"{'x ' * i}Under the MIT License. Apache License, Version 2.0; CC BY-NC!{' y' * i}") for i in range(9)]
    rows += [(300, None), (301, ""), (302, " .,"), (None, "cc by nc"), (None, "cc by nc"), (303, "cc by nc"), (303, "cc by nc"), (304, "CC BY NCÉ é cc by nc" * 2), (305, "the under the mit"), (306, "mit license")]
    rows += [(400, "word " * 30_000 + "under the mit license " * 500), (401, "the license " * 5_000)]
    assert base(run(spark, rows)) == plain(rows)
    assert run(spark, []) == []


def test_templates_with_words_changed(spark):
    gpl, mit = licenses.TEMPLATES[2].text, licenses.TEMPLATES[0].text
    rows = [(i, f"some words number {i} and more of them here") for i in range(50)]
    rows += [
        (100, gpl), (101, "This WORK is licensed under the GNU General Public License, version 3."), (102, gpl.replace("work", "thing")),
        (103, gpl.replace("general public", "general private")), (104, gpl.replace("version 3", "version 4")), (105, "gnu general public license " * 3),
        (106, mit.replace("any person", "any person or body or group")), (107, mit.replace("charge", "cost")), (108, f"{gpl} and under the mit license"), (109, "x " * 500 + mit),
        (110, "gnu general public license " + "x " * 100 + "this work is licensed version 3"),
    ]
    got = {r.doc_id: r for r in run(spark, rows)}
    labels = {k: got[k].labels for k in range(100, 111)}
    assert labels == {100: "gpl-3", 101: "gpl-3", 102: "gpl-3", 103: "", 104: "", 105: "", 106: "mit", 107: "", 108: "gpl-3,mit", 109: "mit", 110: ""}
    assert got[108].base_labels == "mit" and got[108].score == 1.0 and got[100].score == 1.0 and 0 < got[103].score < 1
    assert all(got[i].labels == "" and got[i].score < 0.5 for i in range(50))


def test_index_holds_the_rarest_words():
    known = {"the": 90, "under": 50, "license": 5, "mit": 60, "cc": 1, "by": 70, "nc": 1}
    of = {}
    for p in licenses.postings(known, 100):
        of.setdefault(p.entry, []).append(p.word)
    assert sorted(of[0]) == ["license", "under"] and sorted(of[2]) == ["cc", "nc"]


def test_extra_columns_and_own_entries(spark):
    df = spark.createDataFrame([(1, "red green blue", "a", "b", 3)], "doc_id long, text string, row string, entry string, label int")
    got = licenses.scan(df, phrases=(("green blue", "g"),), templates=(licenses.Template("t", "red green blue black", ("red",)),)).collect()
    assert [(r.doc_id, r.n_base, r.first_word, r.base_labels, r.labels) for r in got] == [(1, 1, 1, "g", "g")]
    with pytest.raises(ValueError):
        licenses.scan(df, templates=(licenses.Template("t", "red green", ("blue",)),)).collect()


def test_query_matches_sql(spark, duck, same):
    sf = "/root/testdata/sf0.01"
    got = licenses.op12_license_scan(spark, sf).toPandas()
    same(got, duck(licenses.OP12_SQL, sf))
    assert (got.labels.str.len() > 0).sum() > (got.base_labels.str.len() > 0).sum() > 0
