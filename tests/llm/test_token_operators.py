"""Encoder, token files, separator scan, sharding, packing: exact round trips and plain versions."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from chronofold.llm import common, eodscan, packing, sharding, tokenfile
from chronofold.llm.tokens import PIECES, encoder, vocabulary_path

DOCS = "doc_id long, text string"
ROWS = [(5, "Hello, world. It's 3.14!"), (1, None), (2, ""), (9, "word " * 30_000), (1, "repeated id"), (1, "repeated id"), (None, "no id"), (7, "日本語 text  with  gaps \n"), (8, "<|endoftext|>"), (4, "hello <|endoftext|> world"), (-(2**63), "least <|ENDOFTEXT|>x"), (2**63 - 1, "most <| <|startoftext|>")]


def library(name, texts, apart=False):
    """Ids by a tokenizer as its file gives it."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(name))
    if apart:
        t.encode_special_tokens = True
    return [np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]


@pytest.mark.parametrize("name", sorted(PIECES))
@settings(max_examples=60, deadline=None)
@given(
    texts=some.lists(some.one_of(some.text(alphabet="abS. ,\n'é1²_#\t\x85\xa0<|\x1cŒ\u3000\x01", max_size=25), some.sampled_from(["a <|endoftext|>", "<|EndOfText|> b", "<|startoftext|>.<|endoftext|>", "<|endoftext"])), max_size=30),
    apart=some.booleans(),
)
def test_encoder_equals_the_library(name, texts, apart):
    assert encoder(vocabulary_path(name), None, apart).encode(texts) == library(name, texts, apart)


def test_special_tokens():
    assert np.frombuffer(encoder(vocabulary_path("byte_bpe_50k.json")).encode(["hello <|endoftext|> world"])[0], "<u4").tolist() == [31373, 220, 50256, 995]
    assert 49407 in np.frombuffer(encoder(vocabulary_path("word_bpe_49k.json")).encode(["<|endoftext|>"])[0], "<u4").tolist()
    assert 49407 not in np.frombuffer(encoder(vocabulary_path("word_bpe_49k.json"), apart=True).encode(["<|endoftext|>"])[0], "<u4").tolist()


@pytest.mark.parametrize("name", sorted(PIECES))
def test_encoder_beyond_its_memo(name, monkeypatch, spark, sf):
    from chronofold.llm import tokens

    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    e = tokens.Encoder(vocabulary_path(name))
    monkeypatch.setattr(tokens, "MEMO", 50)
    monkeypatch.setattr(tokens, "RUN", 5000)
    assert e.encode(texts) == library(name, texts)


@settings(max_examples=60, deadline=None)
@given(some.lists(some.one_of(some.integers(0, 300), some.integers(0, 2**32 - 1)), min_size=1, max_size=9000))
def test_blocks_round_trip(ids):
    x = np.array(ids, dtype="<u4")
    assert (tokenfile.decode_blocks(b"".join(tokenfile.encode_blocks(x))) == x).all()


def test_blocks_keep_exceptions_apart():
    x = np.full(tokenfile.SIZE, 100, dtype="<u4")
    x[:7] = 2**31
    (block,) = tokenfile.encode_blocks(x)
    assert len(block) < 100
    assert (tokenfile.decode_blocks(block) == x).all()


def want_files(rows, end=2):
    import xxhash

    def key(row):
        h = 42 if row[1] is None else xxhash.xxh64_intdigest(row[1], 42)
        return row[0] is not None, row[0] or 0, h - (h >> 63 << 64), row[1] or ""

    out, at = [], 0
    rows = sorted(rows, key=key)
    for (d, _), b in zip(rows, library("byte_bpe_50k.json", [t or "" for _, t in rows]), strict=True):
        b += np.array([end], "<u4").tobytes()
        out.append((d, at, len(b) // 4, zlib.crc32(b)))
        at += len(b) // 4
    return sorted(out, key=repr)


def test_token_files(spark):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3).selectExpr("*", "1 AS part", "2 AS file")
    root = common.new_dir(spark, "t")
    manifest = tokenfile.write_files(docs, root, vocabulary_path("byte_bpe_50k.json"))
    assert sorted((tuple(r) for r in tokenfile.read_files(manifest).collect()), key=repr) == want_files(ROWS)
    for r in manifest.collect():
        with common.open_file(r["file"]) as f:
            reader = tokenfile.Reader(f)
            whole = np.concatenate(list(reader.runs()))
            ends = np.cumsum(reader.lengths)
            for k in range(reader.n_docs):
                assert (reader.document(k) == whole[ends[k] - reader.lengths[k] : ends[k]]).all()
    empty = tokenfile.write_files(docs.limit(0), common.new_dir(spark, "t"), vocabulary_path("byte_bpe_50k.json"))
    assert tokenfile.read_files(empty).count() == 0


def test_one_id_in_many_files(spark, request):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    request.addfinalizer(lambda: spark.conf.unset(key))
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(400)], DOCS).repartition(3)
    manifest = tokenfile.write_files(docs, common.new_dir(spark, "t"), vocabulary_path("byte_bpe_50k.json"))
    files = manifest.collect()
    assert len(files) > 1
    assert max(r["docs"] for r in files) < 300
    assert sorted((tuple(r) for r in tokenfile.read_files(manifest).collect()), key=repr) == want_files([(7, f"text {k}") for k in range(400)])


def test_token_files_of_many_runs(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "RUN", 2)
    rows = [(k, f"text {k} " * (k % 50)) for k in range(300)]
    w = None
    import io

    buffer = io.BytesIO()
    w = tokenfile.Writer(buffer)
    e = encoder(vocabulary_path("byte_bpe_50k.json"))
    ids = e._whole([t for _, t in rows])
    for i in range(0, 300, 7):
        w.add([k for k, _ in rows[i : i + 7]], ids[i : i + 7])
    w.close()

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    r = tokenfile.Reader(File(buffer.getvalue()))
    assert np.concatenate(list(r.runs())).astype("<u4").tobytes() == b"".join(ids)
    assert r.docs.tolist() == list(range(300))


def test_a_failed_writer_leaves_nothing(tmp_path):
    with pytest.raises(RuntimeError), common.publish(f"file://{tmp_path}/x") as out:
        out.write(b"abc")
        raise RuntimeError
    assert not list(tmp_path.iterdir())


def test_token_file_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in tokenfile.op4_token_files(spark, sf).collect()), key=repr) == want_files(rows)


@pytest.mark.parametrize("block", [2, 10, 1000, 4 << 20])
def test_separator_scan(spark, block):
    rows = [r for r in ROWS if block > 100 or len(r[1] or "") < 1000]  # blocks of an id or five: not of the longest text
    docs = spark.createDataFrame(rows, DOCS).repartition(2).selectExpr("*", "1 AS file", "2 AS bytes", "3 AS place")
    root = common.new_dir(spark, "f")
    written = eodscan.write_flat(docs, root, vocabulary_path(eodscan.VOCABULARY))
    eodscan.write_flat(docs.where("doc_id > 5").repartition(2), root, vocabulary_path(eodscan.VOCABULARY))  # as another attempt: replaces no file
    files = written.groupBy("file").agg(F.sum("bytes").alias("bytes"))
    got = eodscan.count_tokens(files, block=block).join(written, ["file", "place"]).select("doc_id", "n_tokens")
    want = sorted(((d, len(ids) // 4 + 1) for (d, _), ids in zip(rows, library(eodscan.VOCABULARY, [t or "" for _, t in rows], True), strict=True)), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_separator_scan_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert eodscan.op8_token_counts(spark, str(tmp_path)).count() == 0


def test_scan_of_plain_files(spark, tmp_path):
    ids = [[7, 7, 9, 9, 1], [9], [], [1, 2, 3], [1, 9, 2]]
    for k, x in enumerate(ids):
        (tmp_path / f"{k}").write_bytes(np.array(x, "<u2").tobytes())
    files = spark.createDataFrame([(f"file://{tmp_path}/{k}", 2 * len(x)) for k, x in enumerate(ids)], "file string, bytes long")
    got = sorted((int(r["file"][-1]), r["place"], r["start"], r["n_tokens"]) for r in eodscan.count_tokens(files, end=9, block=4).collect())
    assert got == [(0, 0, 0, 3), (0, 1, 3, 1), (1, 0, 0, 1), (4, 0, 0, 2)]


def test_separator_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted((r["doc_id"], len(ids) // 4 + 1) for r, ids in zip(rows, library(eodscan.VOCABULARY, [r["text"] for r in rows], True), strict=True))
    assert sorted(map(tuple, eodscan.op8_token_counts(spark, sf).collect())) == want


# --- sharding -----------------------------------------------------------------------------------------------------------


def test_compaction_keeps_rows_and_versions(spark):
    root = common.new_dir(spark, "s")
    docs = spark.createDataFrame([(k, f"text {k}" if k % 5 else None, k % 3) for k in range(200)] + [(None, None, None)] * 2, "doc_id long, text string, __arrival int").repartition(6)
    kept = sharding.shard(docs, root, F.col("__arrival"), target=1 << 20, smallest=1 << 10)
    assert sorted(map(tuple, kept.read().collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    sizes = [len(kept.manifest(v)["shards"]) for v in kept.versions()]
    assert kept.versions() == list(range(1, len(sizes) + 1))
    assert sizes[-1] < max(sizes)
    counts = [kept.read(v).count() for v in kept.versions()]
    assert counts == sorted(counts)
    assert kept.vacuum() > 0
    assert kept.read().count() == 202


def test_conflicting_commits(spark):
    root = common.new_dir(spark, "s")
    a, b = sharding.ShardStore(spark, root), sharding.ShardStore(spark, root)
    schema, shards = a.stage(spark.range(3), F.lit(0))
    base = a.manifest()
    b.append(shards[0], schema)
    with pytest.raises(sharding.Conflict):
        a.commit(base, shards[0], schema)
    a.append(a.stage(spark.range(2), F.lit(0))[1][0], schema)
    assert a.read().count() == 5
    with pytest.raises(ValueError):
        a.append([], spark.createDataFrame([("x",)], "id string").schema.json())


def test_no_arrivals(spark):
    kept = sharding.shard(spark.createDataFrame([], DOCS), common.new_dir(spark, "s"), F.lit(0))
    assert kept.read().count() == 0
    with pytest.raises(ValueError):
        sharding.ShardStore(spark, common.new_dir(spark, "s")).read()


def test_sharding_query_equals_sql(spark, sf, duck, same):
    same(sharding.op9_sharding(spark, sf).toPandas(), duck(sharding.OP9_SQL))


# --- packing ------------------------------------------------------------------------------------------------------------


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(some.lists(some.integers(1, 64), max_size=200))
def test_sum_of_squares_fills(sizes):
    where, offset = packing.sum_of_squares(np.array(sizes, dtype=np.int64), 64)
    n = check_bins([{"sequence_id": w, "offset": o, "length": s} for w, o, s in zip(where.tolist(), offset.tolist(), sizes, strict=True)], 64)
    # no more than two sequences can be half empty, as the smaller's pieces would fit the other
    assert n <= 2 * -(-sum(sizes) // 64) + 1


def test_sum_of_squares_chooses_the_smallest_change():
    r = random.Random(3)
    sizes = [r.randint(1, 40) for _ in range(300)]
    where, offset = packing.sum_of_squares(np.array(sizes), 40)
    gaps = {}
    for k in sorted(range(300), key=lambda k: -sizes[k]):
        s, n = sizes[k], {}
        for g in gaps.values():
            n[g] = n.get(g, 0) + 1
        squares = lambda m: sum(v * v for g, v in m.items() if g > 0)
        fits = [g for g in n if g >= s]
        gap = 40 - int(offset[k])
        if fits:
            after = {g: squares({**n, g: n[g] - 1, g - s: n.get(g - s, 0) + 1}) for g in fits}
            assert gaps[int(where[k])] == gap
            assert after[gap] == min(after.values())
        else:
            assert int(where[k]) not in gaps
        gaps[int(where[k])] = gap - s


@pytest.mark.parametrize("group, rounds", [(40_000, 3), (30, 3), (30, 0), (5, 2)])
def test_packing_of_many_groups(spark, group, rounds):
    r = random.Random(1)
    rows = spark.createDataFrame([(k, r.choice([3, 100, 500, 1500, 2047, 2048])) for k in range(400)], "doc_id long, length long").selectExpr("*", "1 AS __GROUP", "2 AS __done", "3 AS offset", "4 AS `a b`")
    packed = packing.pack(rows, group=group, rounds=rounds)
    assert sorted(packed.columns) == ["__GROUP", "__done", "a b", "doc_id", "length", "offset", "sequence_id"]
    got = packed.collect()
    assert {(x["__GROUP"], x["__done"], x["a b"]) for x in got} == {(1, 2, 4)}
    assert sorted(x["doc_id"] for x in got) == list(range(400))
    n = check_bins(got, 2048)
    if rounds and group > 5:
        assert n <= -(-sum(x["length"] for x in got) // 2048) * 1.35


def test_pieces(spark):
    got = packing.pieces(spark.createDataFrame(ROWS, DOCS), vocabulary_path("word_bpe_49k.json")).collect()
    want = []
    for (d, _), b in zip(ROWS, library("word_bpe_49k.json", [t or "" for _, t in ROWS]), strict=True):
        b += bytes(4)
        want += [(d, k, i // 4, len(b[i : i + 8192]) // 4, zlib.crc32(b[i : i + 8192])) for k, i in enumerate(range(0, len(b), 8192))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_packing_query(spark, sf):
    got = packing.op10_packing(spark, sf).collect()
    n = check_bins(got, 2048)
    assert n <= -(-sum(r["length"] for r in got) // 2048) + 2
    assert packing.pack(packing.pieces(spark.createDataFrame([], DOCS), vocabulary_path("word_bpe_49k.json"))).count() == 0


def test_intermediate_tables_can_be_cleaned():
    """In a session of its own folder: nothing is left of what operators stored."""
    import subprocess
    import sys
    import tempfile

    code = """
import sys, os
from chronofold.session import session
from chronofold.llm import common
d = sys.argv[1]
s = session("local[1]", "clean", spark__checkpoint__dir=d, spark__ui__enabled="false")
assert common.store(s.range(5), "x").count() == 5
assert os.listdir(d + "/chronofold")
common.clean(s)
assert not os.listdir(d + "/chronofold")
print("cleaned")
"""
    with tempfile.TemporaryDirectory() as d:
        root = __file__.rsplit("/tests/", 1)[0]
        got = subprocess.run([sys.executable, "-c", code, d], cwd=root, capture_output=True, text=True, timeout=300)
    assert "cleaned" in got.stdout, got.stderr[-2000:]
