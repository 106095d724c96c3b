"""SimHash and embedding near-duplicates against brute force; components."""

import random

import numpy as np
import pytest

from chronofold.llm import common, embeddings, graph, simhash

DOCS = "doc_id long, text string"


def roots(n, links):
    p = list(range(n))

    def find(a):
        while p[a] != a:
            a = p[a]
        return a

    for a, b in links:
        p[find(a)] = find(b)
    return [find(a) for a in range(n)]


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 80)], [(5, 5)], [(k, k + 7) for k in range(0, 90, 3)], [(k, 100 - k) for k in range(50)]])
def test_components(spark, edges):
    got = dict(map(tuple, graph.connected(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()))
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    r = roots(101, edges)
    low = {r[a]: a for a in reversed(nodes)}
    assert got == {a: low[r[a]] for a in nodes}


def plain_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows):
    fp = [plain_fingerprint(t) for _, t in rows]
    r = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2])
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[r[k]] = min(low.get(r[k], d), d)
    return sorted(((d, f"{fp[k]:016x}", low.get(r[k])) for k, (d, _) in enumerate(rows)), key=repr)


def test_golay_keys_share_within_two_bits():
    rng = np.random.RandomState(0)
    x = rng.randint(0, 1 << 23, 3000)
    keys, count = simhash.golay_keys(x)
    assert set(count) == {1, 6}
    for flips in (0, 1, 2):
        y = x.copy()
        for _ in range(flips):
            y ^= 1 << rng.randint(0, 23, len(x))
        other, n = simhash.golay_keys(y)
        assert all(set(keys[k, : count[k]]) & set(other[k, : n[k]]) for k in range(len(x)))


def test_fingerprint_of_white_space_and_case():
    for t in (None, "", " \n", "One", "a B", "a b c", "A\x0bB\x0cC d", "É é É é", "x\x1cy z w", "w " * 70_000):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def near_rows(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(12):
        base = [r.choice(words) for _ in range(r.choice([4, 60, 200]))]
        for _ in range(6):
            new = list(base)
            for _ in range(r.randint(0, 2)):
                new[r.randrange(len(new))] = r.choice(words)
            rows.append((len(rows), " ".join(new)))
    return rows + [(3, "again"), (3, "again"), (None, "nobody"), (500, None), (501, ""), (502, "x"), (503, "X")]


@pytest.mark.parametrize("seed", range(2))
def test_simhash_against_brute_force(spark, seed):
    rows = near_rows(seed)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS fp", "2 AS key", "3 AS root")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == plain_groups(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_links_at_any_bucket_size(spark, bucket):
    rng = np.random.RandomState(1)
    base = rng.randint(0, 2**62, 5, dtype=np.int64)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.randint(0, 64 if n else 63, rng.randint(0, 3))) for b in base for n in range(30)})
    fps = [f if f < 2**63 else f - 2**64 for f in fps]
    e = simhash.links(spark.createDataFrame([(k, f) for f in fps for k in (0, 3)], "space long, fp long"), bucket)
    assert {r["space"] for r in e.select("space").distinct().collect()} <= {0, 3}
    e = e.where("space = 3")
    got = dict(map(tuple, graph.connected(e).collect()))
    r = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 2])
    low = {}
    for k, f in enumerate(fps):
        low[r[k]] = min(low.get(r[k], f), f)
    for k, f in enumerate(fps):
        assert got.get(f, f) == low[r[k]]


def test_simhash_query_on_the_tables(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in simhash.op2_simhash_near_dedup(spark, sf).collect()), key=repr)
    assert got == plain_groups(rows)


def plain_similarity(a, b):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def similar_rows(seed):
    """Groups of texts with a few words changed, and texts of their own."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3_000)]
    rows = []
    for n in (150, 300, 600):
        for _ in range(8):
            base = [r.choice(words) for _ in range(n)]
            rows.append(" ".join(base))
            for _ in range(3):
                new = list(base)
                for _ in range(max(1, n // 150)):
                    new[r.randrange(n)] = r.choice(words)
                rows.append(" ".join(new))
    return rows + [" ".join(r.choice(words) for _ in range(r.choice([3, 40, 200]))) for _ in range(60)] + [None, "", " \n", "A b  c d e f", "a B c\nd e f", "f e d c b a"]


def flipped(rng, bits, n):
    out = bits.copy()
    out[rng.choice(len(bits), n, replace=False)] ^= True
    return out


def sketches_of(spark, bits, fps):
    rows = [(k, f, np.packbits(b, bitorder="little").view("<i8").tolist()) for k, (b, f) in enumerate(zip(bits, fps, strict=True))]
    return spark.createDataFrame(rows, "row long, fps array<long>, sketch array<long>").repartition(4)


def linked(df, n):
    return roots(n, [(r["a"], r["b"]) for r in df.collect()])


def all_links(bits, apart):
    d = np.array([[(x != y).sum() for y in bits] for x in bits])
    return [(a, b) for a in range(len(bits)) for b in range(a) if d[a, b] <= apart]


def families(rng, count, size):
    """Chains of sketches, each some bits from one before it, and unlike ones between them."""
    bits = []
    for _ in range(count):
        family = [rng.rand(1024) < 0.5]
        for _ in range(size - 1):
            family.append(flipped(rng, family[rng.randint(len(family))], rng.randint(20, 260)))
        bits += family
    return [*bits, *[rng.rand(1024) < 0.5 for _ in range(count)]]


@pytest.mark.parametrize("full, ask", [(4096, 1024), (4096, 7), (64, 30), (3, 5)])
def test_no_link_of_a_crowded_group_is_lost(spark, monkeypatch, full, ask):
    """All rows under one key: what is linked, with blocks of what isn't done, connects as all pairs do."""
    for name, value in (("FULL", full), ("ASK", ask), ("MEET", 4)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.RandomState(ask)
    bits = families(rng, 5, 12)
    apart = simhash.bits_apart(simhash.SIMILARITY - simhash.ERROR)
    unique = sketches_of(spark, bits, [[0]] * len(bits))
    groups = unique.selectExpr("7L AS g", "row").unionByName(unique.where("row < 9").selectExpr("8L AS g", "row")).unionByName(unique.where("row < 3").selectExpr("9L AS g", "row"))
    none = unique.selectExpr("row AS a", "row AS b").limit(0)
    links, left = simhash._settle(groups, unique, none, apart, 8, 2)
    want, got = roots(len(bits), all_links(bits, apart)), linked(links, len(bits))
    named = lambda of: [of.index(x) for x in of]
    if full > 3:
        assert left is None or left.isEmpty()
        assert named(got) == named(want)
    else:
        assert left.where("g = 7").count() == len(bits)
        assert all(want[a] == want[got[a]] for a in range(len(bits)))


def test_unlike_texts_under_one_key_cost_bands_not_pairs(spark, monkeypatch):
    rng = np.random.RandomState(3)
    monkeypatch.setattr(simhash, "FULL", 64)
    apart = simhash.bits_apart(simhash.SIMILARITY - simhash.ERROR)
    stored = []
    plain_store = simhash.store
    monkeypatch.setattr(simhash, "store", lambda df, name: stored.append(plain_store(df, name)) or stored[-1])
    rows = {}
    for n in (1000, 4000):
        bits = [rng.rand(1024) < 0.5 for _ in range(n)]
        bits += [flipped(rng, bits[k], 150) for k in range(0, n, 10)]
        stored.clear()
        links = simhash.similar_links(sketches_of(spark, bits, [[0] * 2] * len(bits)))
        got = {(min(r), max(r)) for r in links.collect()}
        want = {(k, n + k // 10) for k in range(0, n, 10)}
        assert got <= want and len(got) >= 0.97 * len(want)
        rows[n] = sum(x.count() for x in stored)
    assert rows[4000] < 4 * 2 * rows[1000]
    places = simhash.bands(4000, apart)
    assert 1 - (1 - (1 - apart / 1024) ** places.shape[1]) ** len(places) >= 1 - simhash.MISS


@pytest.mark.parametrize("copies", [1, 40])
def test_similar_texts_behind_an_unlike_one_of_the_same_words(spark, copies):
    """A has the words of the others in another order, so all have one fingerprint; the others are similar to each other."""
    r = random.Random(copies)
    base = [f"w{k}" for k in range(300)]
    first, texts = r.sample(base, len(base)), [list(base)]
    for _ in range(copies):
        new = list(base)
        i = r.randrange(290)
        new[i], new[i + 5] = new[i + 5], new[i]
        texts.append(new)
    rows = [" ".join(t) for t in [first, *texts]]
    got = dict(map(tuple, simhash.similar(spark.createDataFrame(list(enumerate(rows)), "row long, text string")).collect()))
    assert got == {0: 0} | {k: 1 for k in range(1, len(rows))}


@pytest.mark.parametrize("hot, meet", [(100_000, 8), (2, 2)])
def test_similar_texts_are_found(spark, monkeypatch, hot, meet):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(simhash, "MEET", meet)
    rows = similar_rows(hot)
    got = dict(map(tuple, simhash.similar(spark.createDataFrame(list(enumerate(rows)), "row long, text string").selectExpr("*", "1 AS fp", "2 AS n")).collect()))
    assert sorted(got) == list(range(len(rows)))
    links = [(a, b, plain_similarity(rows[a], rows[b])) for a in range(len(rows)) for b in range(a)]
    found = [got[a] == got[b] for a, b, j in links if j >= 0.8]
    assert sum(found) > 0.95 * len(found)
    sure = roots(len(rows), [(a, b) for a, b, j in links if j >= 0.55])
    assert all(sure[k] == sure[g] and g <= k for k, g in got.items())
    assert simhash.similar(spark.createDataFrame([], "row long, text string")).count() == 0


def test_sketch_of_long_texts_and_estimates():
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(30_000)]
    other = base[:27_000] + [f"x{k}" for k in range(3_000)]
    a, b = (simhash.sketch(" ".join(t))[3] for t in (base, other))
    apart = sum(int(x).bit_count() for x in (a ^ b).view(np.uint64))
    j = plain_similarity(" ".join(base), " ".join(other))
    assert abs(apart - simhash.bits_apart(2 * j / (1 + j))) < 40


# --- embeddings ---------------------------------------------------------------------------------------------------------


def plain_links(rows):
    ok = [i is not None and lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], dtype=float), np.array(rows[b][1], dtype=float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((a, b))
    r = roots(len(rows), links)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[r[k]] = min(low.get(r[k], i), i)
    n = [sum(k in e for e in links) for k in range(len(rows))]
    return sorted(((i, n[k], low.get(r[k]), i is None or i == low[r[k]]) for k, (i, _, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("cells, block, hot", [(2048, 8192, 100_000), (2, 8192, 3), (64, 7, 10), (16, 3, 1)])
def test_embeddings_against_brute_force(spark, monkeypatch, cells, block, hot):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(embeddings, "COPY", 1e-9)  # many cells even on few rows
    monkeypatch.setattr(embeddings, "FINE", 5)
    rng = np.random.RandomState(cells + block)
    base = rng.randn(9, 6)
    rows = [(k, [float(np.float32(x)) for x in base[k % 9] + rng.randn(6) * rng.choice([0, 0.05, 0.1, 0.3])], int(k % 9 % 2)) for k in range(150)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 6, 1), (903, [float("nan")] * 6, 1), (904, [float("inf")] + [0.0] * 5, 1), (905, [None] + [1.0] * 5, 1), (906, rows[0][1], None), (None, rows[0][1], 0)]
    rows += [(907, rows[0][1][:3], 0), (908, rows[0][1][:3], 0), rows[5], (909, [2 * x for x in rows[3][1]], 1), (910, [0.0, 1.0], 1), (911, [-0.0, 1.0], 1), (912, [-0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS fine", "3 AS cell", "4 AS n", "5 AS k1")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df, cells=cells, block=block).collect()), key=repr)
    assert got == plain_links(rows)


def test_each_close_pair_is_compared_once():
    rng = np.random.RandomState(3)
    v = embeddings.unit(np.concatenate([rng.randn(600, 24), rng.randn(20, 24).repeat(15, axis=0) + 0.02 * rng.randn(300, 24)]))
    links = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(v @ v.T >= 0.98, 1)), strict=True)}
    everyone, half = np.arange(len(v)), np.arange(len(v)) % 2 == 0
    for parts in ([(everyone, everyone)], [(everyone[half], everyone[half]), (everyone[~half], everyone[~half]), (everyone[half], everyone[~half])]):
        seen, compared = [], 0
        for a, b in parts:
            for x, y, mask in embeddings.products(v, a, b, lambda x, y: np.ones((len(x), len(y)), dtype=bool)):
                compared += mask.size
                r, c = np.nonzero(mask)
                seen += [(min(i, j), max(i, j)) for i, j in zip(x[r].tolist(), y[c].tolist(), strict=True)]
        assert sorted(seen) == sorted(links)
        assert compared < len(v) ** 2 / 2


def test_cells_at_every_size():
    rng = np.random.RandomState(0)
    for n in (2, 50, 500, 5_000):
        v = embeddings.unit(rng.randn(n, 16))
        assert len(embeddings.choose_centres(v, np.zeros(n, dtype=int), 1.0)) >= 2
    # vectors in groups: more cells, few copies over borders, and few pairs left
    v = embeddings.unit(rng.randn(64, 16).repeat(100, axis=0) + 0.05 * rng.randn(6_400, 16))
    centres = embeddings.choose_centres(v, np.zeros(len(v), dtype=int), 100.0)
    home, margin = embeddings.margins(v, centres)
    copies = ((margin <= embeddings.chord(0.98)) & (np.arange(len(centres)) < home[:, None])).sum(axis=0)
    own = np.bincount(home, minlength=len(centres))
    assert len(centres) >= 16
    assert (own * (own / 2 + copies)).sum() < len(v) ** 2 / 4


def test_no_embeddings(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embedding_query_equals_sql(spark, sf, duck, same):
    same(embeddings.op3_embedding_near_dedup(spark, sf).toPandas(), duck(embeddings.OP3_SQL))
