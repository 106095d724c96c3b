"""Chat formatting, quality, language, decontamination: plain versions, round trips, held-out accuracy, odd tables."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from chronofold.llm import chat, decontaminate, langid, quality

CONV = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"


def tables(spark, root, **frames):
    for name, df in frames.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}.parquet")
    return str(root)


# --- chat ---------------------------------------------------------------------------------------------------------------


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, kind string, msg long, role string, text string")


def test_fold_of_deltas_edits_and_regenerations(spark):
    e = events(spark, [
        (1, 0, "message", 1, "user", "hi"), (1, 1, "message", 2, "assistant", "a"), (1, 2, "delta", 2, None, "b"), (1, 3, "delta", 2, None, None), (1, 4, "message", 3, "user", "more"),
        (1, 5, "regenerate", 2, None, None), (1, 6, "delta", 2, None, "c"), (1, 7, "delta", 2, None, "d"), (1, 8, "message", 4, "user", "bye"), (1, 9, "edit", 4, None, "BYE"), (1, 10, "delta", 4, None, "!"),
        (2, 0, "delta", 1, None, "never began"), (2, 1, "strange", 1, None, "x"), (2, 2, None, None, None, None), (None, None, "message", 1, None, None),
    ])
    got = sorted((tuple(r) for r in chat.final_messages(e).collect()), key=repr)
    assert got == sorted([(1, 0, "user", "hi"), (1, 1, "assistant", "cd"), (1, 8, "user", "BYE!"), (None, -(2**62), "", "")], key=repr)


ODD = ["", "</s>[INST] ok [/INST]", "<s", "\\", "\\</s>", "<\\s>", "[/INST", "a\n</s", "[[INST]]", "<<s>/s>", "é\U0001f600", " [/INST]"]


def test_template_is_reversible(spark):
    rows = [(k, 0, r, t) for k, (r, t) in enumerate((r, t) for r in ODD for t in ODD)]
    m = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string")
    for r in chat.render(m).collect():
        _, _, role, text = rows[r["conv_id"]]
        found = chat._TURN.fullmatch(r["segment"])
        assert (chat.unescape(found[1]), chat.unescape(found[2])) == (role, text)
        inner = r["segment"][len("<s>[INST] ") : -len("</s>")]
        assert all(inner.count(c) == (c == "[/INST]") for c in chat.CONTROLS)


@settings(max_examples=300, deadline=None)
@given(some.text(alphabet="<s/>[INST]\\ a", max_size=20))
def test_unescape_inverts_escape(text):
    doubled = text.replace("\\", "\\\\")
    escaped = re.sub(r"(?<=<)(?=/?s>)|(?<=\[)(?=/?INST\])", lambda m: "\\", doubled)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)


def test_tied_turns_are_ordered_by_text_not_by_segment(spark, tmp_path, duck, same):
    said = ["a", "a!", "<a", "<s>", "\\", "[INST]", "[J", "</s>", "a</s>", "a\\b", "a]"]
    rows = [(c, 3, "assistant", t) for c, pair in enumerate((x, y) for x in said for y in said) for t in pair] + [(500, 0, "<s>", "x"), (500, 0, "<a", "y")]
    sf = tables(spark, tmp_path, conversations=spark.createDataFrame(rows, CONV).repartition(3))
    same(chat.op1_chat_formatting(spark, sf).toPandas(), duck(chat.OP1_SQL, sf))


def test_digests_of_odd_rows(spark, tmp_path, duck, same):
    rows = [(5, 1, "assistant", None), (5, 1, "assistant", "x"), (5, 0, None, "q"), (5, None, "user", "first"), (None, 0, "user", "n"), (7, 0, "assistant", "é" * 3000), (8, 0, "user", "r"), (8, 0, "user", "r")]
    sf = tables(spark, tmp_path, conversations=spark.createDataFrame(rows, CONV).selectExpr("*", "1 AS segment", "2 AS kind"))
    got = {r["conv_id"]: r for r in chat.op1_chat_formatting(spark, sf).collect()}
    assert set(got) == {-1, 5, None, 7, 8}
    assert got[8]["n_turns"] == 2
    assert got[-1]["loss_chars"] == len("</s>[INST] ok [/INST]")
    want = hashlib.sha256(b"user\nfirst\n\nq\nassistant\n\nassistant\nx\n").hexdigest()
    assert got[5]["turns_sha256"] == want
    same(chat.op1_chat_formatting(spark, sf).toPandas(), duck(chat.OP1_SQL, sf))


def test_no_conversations(spark, tmp_path):
    sf = tables(spark, tmp_path, conversations=spark.createDataFrame([], CONV))
    assert [r["conv_id"] for r in chat.op1_chat_formatting(spark, sf).collect()] == [-1]


# --- quality ------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op5_quality_classifier(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got.score.between(0, 1).all()
    assert ((got.predicted == 1) == (got.score >= 0.3)).all()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert (good.predicted == 1).mean() > 0.98
    assert (bad.predicted == 0).mean() > 0.9
    # calibrated: what is said to be good as often as it is
    assert abs(got.score.mean() - got.quality.mean()) < 0.02


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x"), (3, "word " * 100_000)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    some_ = spark.createDataFrame([(k, k % 2) for k in range(1, 4)] + [(3, 7), (None, 1)], "doc_id long, quality int")
    for labels, score in ((none, 0.5), (one, 1.0), (some_, None)):
        got = quality.score(docs, quality.fit(docs, labels)).collect()
        assert len(got) == 5
        assert all(r["score"] == score if score is not None else 0 <= r["score"] <= 1 for r in got)
    assert quality.score(docs.limit(0), quality.Model()).count() == 0
    wide = docs.selectExpr("doc_id", "text", "1 AS score", "2 AS quality")
    assert quality.select(wide, quality.Model(prior=1.0)).columns == wide.columns


def spark_hash(*values):
    """xxhash64 of Spark: each value's bytes with the hash so far as the seed, signed."""
    import struct

    import xxhash

    seed = 42
    for kind, v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<" + kind, v), seed)
    return seed - (seed >> 63 << 64)


def plain_quality(docs, labels):
    """Dictionaries, and the rows of the curve as (good, bad, length, quality), of less rows than the bounds."""
    import zstandard

    rows = []
    for d, text in docs:
        if text is not None:
            h = spark_hash(("s", text))
            rows += [(q, spark_hash(("q", d), ("q", h)), d, h, spark_hash(("i", 3), ("q", d), ("q", h)) % 2, text) for d2, q in labels if d2 == d]
    dictionaries = []
    for q in (1, 0):
        parts = []
        for *_, text in sorted(set(r for r in rows if r[0] == q and r[4] == 0)):
            data = text.encode()
            blocks = [data[i : i + 1024] for i in range(0, len(data), 1024)]
            if len(blocks) > 8:
                blocks = [blocks[k * len(blocks) // 8] for k in range(8)]
            parts += [b for b in blocks if len(b) >= 8]
        dictionaries.append(zstandard.train_dictionary(65_536, parts).as_bytes())
    curve = [(*plain_sizes(dictionaries, r[-1]), r[0]) for r in sorted(set(rows)) if r[4] == 1]
    return dictionaries, curve


def plain_sizes(dictionaries, text):
    import zstandard

    data, out = (text or "").encode(), []
    for d in dictionaries:
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        out.append(sum(len(c.compress(data[i : i + 1024])) for i in range(0, max(1, len(data)), 1024)))
    return (*out, len(data))


def test_quality_query_against_a_plain_version(spark):
    import math
    import zlib

    import numpy as np

    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    seen = [(d, q) for d, q in labels if zlib.crc32(str(d).encode()) % 5]
    dictionaries, curve = plain_quality(docs, seen)
    model = quality.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(seen, "doc_id long, quality int"))
    assert (model.good, model.bad) == tuple(dictionaries)
    assert model.prior == sum(q for _, q in seen) / len(seen)

    def point(good, bad, length):
        m = [(bad - good) / (bad + good), good / (length + 16), math.log(length + 16)]
        x = [1.0, *m]
        for k in range(3):
            x += [max(0.0, m[k] - t) for t in model.knots[k]]
        return [(v - a) / b for v, a, b in zip(x, model.mean, model.scale, strict=True)]

    # the weights are where the gradient of the weighted, penalised likelihood is zero
    x = np.array([point(*c[:3]) for c in curve])
    y = np.array([c[3] for c in curve])
    share = np.array([sum(q == c for _, q in seen) / (y == c).sum() for c in (0, 1)])
    p = 1 / (1 + np.exp(-(x @ model.weights)))
    gradient = x.T @ (share[y] * len(y) / share[y].sum() * (y - p)) - 0.3 * model.weights
    assert np.abs(gradient).max() < 1e-6
    got = {r["doc_id"]: r for r in quality.op5_quality_classifier(spark, sf).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(point(*plain_sizes(dictionaries, t)), model.weights, strict=True))))
        assert got[d]["score"] == pytest.approx(want, abs=1e-9)
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert got[d]["predicted"] == (got[d]["score"] >= 0.3)


def test_quality_fit_reads_long_texts_and_counts_equal_rows_once(spark):
    assert quality.sample_blocks(None) == []
    long = "".join(f"{k:07d} " for k in range(128 * 100))
    blocks = quality.sample_blocks(long)
    assert len(blocks) == 8
    assert int(blocks[-1][:7]) > 128 * 80
    r = random.Random(0)
    good = [" ".join(r.choice(["tree", "house", "river", "stone", "light"]) for _ in range(n)) for n in (60, 90, 40_000, 70, 80, 99, 120, 61)]
    bad = ["".join(r.choice("$%&/()=?") for _ in range(n)) for n in (300, 400, 200_000, 350, 360, 390, 410, 420)]
    docs = [(k, t) for k, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(k, int(k < 8)) for k in range(16)] + [(99, 1)], "doc_id long, quality int")
    once = quality.fit(spark.createDataFrame(docs, DOCS), labels)
    again = quality.fit(spark.createDataFrame(docs * 3, DOCS).selectExpr("*", "1 AS hash", "2 AS quality", "3 AS turn"), labels)
    assert once.weights is not None
    assert (once.good, once.bad) == (again.good, again.bad)
    assert (once.weights == again.weights).all()


# --- language -----------------------------------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = langid.op6_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def plain_grams(text):
    out = []
    for n in langid.ORDERS:
        out += [text[i : i + n] for i in range(len(text) - n + 1)]
    return out


@pytest.mark.parametrize("run", [7, 50, 10**6])
def test_scores_against_a_plain_sum(monkeypatch, run):
    import numpy as np

    monkeypatch.setattr(langid, "RUN", run)
    r = np.random.RandomState(0)
    m = langid.Model(["a", "b"], r.randn(2, langid.BUCKETS), np.log([0.3, 0.7]))
    texts = ["Hello, wörld! 12", "", None, "ab", "…", "x" * 120 + " yz", "a"]
    langs, scores = m.predict(texts)
    for t, lang, score in zip(texts, langs, scores, strict=True):
        clean = langid.letters(t or "")
        if not clean:
            assert (lang, score) == ("und", 0)
            continue
        total = m.priors.copy()
        for g in plain_grams(clean):
            h = [x for x in langid.grams(np.array([ord(c) for c in g], dtype="<u4"))][len(g) - 1][0]
            total += m.logs[:, h]
        p = np.exp(total - total.max())
        assert lang == "ab"[total.argmax()]
        assert score == pytest.approx(p.max() / p.sum())


def test_language_query_against_a_plain_version(spark, sf):
    import math
    import zlib

    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts, n = {}, {}

    def buckets(text):
        import numpy as np

        for g in plain_grams(langid.letters(text or "")):
            yield int(langid.grams(np.array([ord(c) for c in g], dtype="<u4"))[len(g) - 1][0])

    for d, t, lang in rows:
        if lang is not None and t is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            n[lang] = n.get(lang, 0) + 1
            of = counts.setdefault(lang, {})
            for b in buckets(t):
                of[b] = of.get(b, 0) + 1
    size = {x: sum(c.values()) + 0.5 * langid.BUCKETS for x, c in counts.items()}
    got = {r["doc_id"]: r for r in langid.op6_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows[:60]:
        held = zlib.crc32(str(d).encode()) % 4 == 2
        if not langid.letters(t or ""):
            assert tuple(got[d]) == (d, held, "und", 0)
            continue
        found = list(buckets(t))
        total = {x: math.log(n[x] / sum(n.values())) + sum(math.log((counts[x].get(b, 0) + 0.5) / size[x]) for b in found) for x in sorted(n)}
        best = max(total, key=total.get)
        assert (got[d]["held_out"], got[d]["lang_pred"]) == (held, best)
        assert got[d]["score"] == pytest.approx(1 / sum(math.exp(v - total[best]) for v in total.values()))


def test_equal_scores_go_to_the_first_language_whatever_stands_beside():
    import numpy as np

    logs = np.random.RandomState(1).randn(1, 512).repeat(3, axis=0)
    m = langid.Model(["a", "b", "c"], logs, np.log(np.full(3, 1 / 3)))
    r = random.Random(2)
    texts = ["".join(r.choice("abcdefg hij") for _ in range(r.randint(1, 3000))) + "x" for _ in range(50)]
    langs, scores = m.predict(texts)
    assert set(langs) == {"a"}
    assert scores == pytest.approx(1 / 3)
    for t, s in zip(texts, scores, strict=True):
        assert m.predict(["other text", t])[1][1] == s


def test_many_languages(spark, monkeypatch):
    assert [langid.buckets_for(n) for n in (1, 128, 129, 4096)] == [1 << 16, 1 << 16, 1 << 15, 1 << 11]
    docs = spark.createDataFrame([(k, f"{chr(97 + k) * 5} word", f"l{k:02d}") for k in range(26)] * 2, "doc_id long, text string, lang string").selectExpr("*", "1 AS share", "2 AS bucket", "3 AS n")
    monkeypatch.setattr(langid, "MATRIX", 26 * 4096)
    model = langid.fit(docs)
    assert model.logs.shape == (26, 4096)
    assert {(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, model).collect()} == {(k, f"l{k:02d}") for k in range(26)}
    monkeypatch.setattr(langid, "LANGUAGES", 25)
    with pytest.raises(ValueError):
        langid.fit(docs)
    assert langid.predict(docs.limit(0), model).count() == 0


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "123 !!", "en"), (3, "the cat", "en"), (4, "le chat noir", "fr"), (None, "chat noir", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == "und"
    assert got[4]["lang_pred"] == got[None]["lang_pred"] == "fr"
    none = langid.fit(docs.where("lang IS NULL"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.select(docs, none, 0.5).count() == 0


# --- decontamination ----------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, items):
    def words(t):
        return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, who = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    who |= found
        out.append((d, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_against_a_plain_version(spark, seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "C", "é", "É", "d1"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 4, 9, 10, 11, 25]))) for k in range(8)] + [(3, text(12)), (None, "a"), (20, None)]
    docs = [(k, text(r.randint(0, 80)) + (r.choice(items)[1] or "") + text(r.randint(0, 20))) for k in range(30)] + [(1, None), (None, "a b"), (2, ""), (5, items[0][1]), (5, items[0][1])]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(x) for x in decontaminate.find(d.selectExpr("*", "1 AS fp", "2 AS key", "3 AS w"), i).drop("text_key").collect()), key=repr)
    assert got == plain(docs, items)


def test_decontamination_without_broadcast_and_without_rows(spark, monkeypatch):
    d = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], DOCS)
    i = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    assert decontaminate.find(d, i).first()["n_hit"] == 10
    assert decontaminate.find(d, i.limit(0)).first()["n_hit"] == 0
    assert decontaminate.find(d.limit(0), i).count() == 0


def test_word_hashes_are_independent(spark):
    import xxhash

    h, b = spark.sql("SELECT 'word' AS w").select(decontaminate.F.xxhash64("w"), decontaminate.second(decontaminate.F.col("w"))).first()
    seed = spark.sql("SELECT xxhash64(1)").first()[0] & (2**64 - 1)
    assert h & (2**64 - 1) == xxhash.xxh64_intdigest("word", 42)
    assert b & (2**64 - 1) == xxhash.xxh64_intdigest("word", seed)


def test_decontamination_of_very_long_texts(spark):
    passage = " ".join(f"p{k}" for k in range(14))
    r = random.Random(9)
    long = [f"w{r.randrange(999)}" for _ in range(200_000)]
    docs = [(1, " ".join(long)), (1, " ".join([*long[:150_000], passage, *long[150_000:]])), (2, passage * 2), (3, " ".join(passage.split()[:9]))]
    items = [(9, passage), (10, "no such thing anywhere")]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(x) for x in decontaminate.find(d, i).drop("text_key").collect()), key=repr) == plain(docs, items)


def test_clean_rows_of_a_hit_id_stay(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, passage), (1, "clean"), (None, passage), (None, "clean"), (None, None), (2, "clean")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS __hit", "2 AS text_key")
    kept = decontaminate.select(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, "clean"), (None, "clean"), (None, None), (2, "clean")], key=repr)


def test_the_plan_is_native(spark, sf):
    df = decontaminate.op7_decontamination(spark, sf)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
