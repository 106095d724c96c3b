"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. With at most two differing bits, at least one
segment is equal and the next one differs in at most two. A segment padded to 23 bits is decoded with the perfect binary
Golay code: a word within two bits of a codeword has that codeword's index as its only key, and a word at three bits has
the nearest codeword and the five at four bits, six keys; any two words that differ in at most two bits share a key. So
(equal segment, key of the next segment) gives about 16 keys of 34 bits for each distinct fingerprint, and loses no link.

Equal fingerprints are one row before any key is made. Keys that a few fingerprints share are joined and verified by the
count of differing bits. A key that many share would give all pairs of them; those fingerprints are linked exactly by
their 65 words within one bit instead (two fingerprints differ in at most two bits exactly if they share such a word, and
at most 65 share one), which stays linear in their number.

Defined results: NULL and wordless texts have fingerprint zero and are linked like any other; NULL ids stay, and are a
component's id only if it holds nothing else; repeated ids and rows each give a row; no rows give no rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, ship, slices, store, table
from .graph import connected

SEED, WORDS, BITS = 42, 3, 2
#: Most fingerprints of a key that are joined with each other.
BUCKET = 64
#: (shift, bits) of the segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fixed value: generator of the binary Golay code [23, 12, 7], x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0xAE3

_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def votes(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, j], minlength=256) @ _BIT for j in range(8)])
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(hashes))))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space alone
    if not found:
        return 0
    flat, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts, ends = (ends[:n] - [len(w) + 1 for w in found[:n]]).tolist(), (ends[-n:] - 1).tolist()
    return votes(np.fromiter((digest(flat[i:j], SEED) for i, j in zip(starts, ends, strict=True)), np.uint64, n))


def _fingerprints(batches):
    import pyarrow as pa

    for batch in slices(batches):
        got = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, fp); ``fp`` is the fingerprint as a signed long."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


# --- keys -----------------------------------------------------------------------------------------------------------


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY << (bit - 11)
    return word


@lru_cache(maxsize=1)
def decoder() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the three bytes of a word; errors by remainder (2048 x 6); how many of them count."""
    unit = [_remainder(1 << i) for i in range(23)]
    byte = np.zeros((3, 256), dtype=np.int64)
    for k in range(3):
        for value in range(256):
            for i in range(8):
                if value >> i & 1 and 8 * k + i < 23:
                    byte[k, value] ^= unit[8 * k + i]
    errors, count = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            rest = 0
            for i in places:
                rest ^= unit[i]
            if weight < 4 or count[rest] and bin(errors[rest, 0]).count("1") == 3:
                errors[rest, count[rest]] = sum(1 << i for i in places)
                count[rest] += 1
    return byte, errors, count


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the nearby codewords of 23-bit words: (n, 6) and how many of each row count, 1 or 6."""
    byte, errors, count = decoder()
    rest = byte[0, words & 255] ^ byte[1, words >> 8 & 255] ^ byte[2, words >> 16 & 255]
    return (words[:, None] ^ errors[rest]) >> 11, count[rest]


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each key of each fingerprint."""
    bits = fp.view(np.uint64)
    parts = [((bits >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64) for shift, width in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        index, count = golay_keys(parts[(k + 1) % 3])
        some = np.arange(6) < count[:, None]
        rows.append(np.nonzero(some)[0])
        keys.append((k << 34 | parts[k][:, None] << 12 | index)[some])
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches):
    import pyarrow as pa

    for batch in slices(batches, 8192):
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        rows, keys = keys_of(fp)
        space = batch.column("space").to_numpy()[rows]
        yield pa.RecordBatch.from_arrays([pa.array(space << 36 | keys), pa.array(space), pa.array(fp[rows])], names=["key", "space", "fp"])


def _apart(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _buckets(distinct: DataFrame) -> DataFrame:
    """(space, fp) to (key, space, fp, n) for the keys that n > 1 fingerprints of a space share."""
    ship(distinct.sparkSession)
    keys = distinct.select(F.col("space").cast("long").alias("space"), "fp")
    keys = store(keys.mapInArrow(_keys, "key long, space long, fp long"), "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return store(join_counted(keys, shared, ["key"]), "buckets")


def _pairs(few: DataFrame, bits: int) -> DataFrame:
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (_apart("a.fp", "b.fp") <= bits)
    return few.alias("a").join(few.alias("b"), same).select("a.space", F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(space, fp) of distinct fingerprints to edges (space, a, b) that connect what differs in at most two bits.

    Only fingerprints of a space meet.
    """
    buckets = _buckets(distinct)
    pairs = _pairs(buckets.where(F.col("n") <= bucket).select("key", "space", "fp"), BITS)
    many = buckets.where(F.col("n") > bucket).select("space", "fp").distinct()
    words = many.select("space", "fp", F.explode(F.expr("transform(sequence(0, 64), i -> if(i = 64, fp, fp ^ shiftleft(1L, i)))")).alias("word"))
    groups = words.groupBy("space", "word").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    stars = groups.select("space", F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, fingerprint, component_id)."""
    prints = store(fingerprints(docs), "fingerprints")
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "distinct")
    roots = connected(links(distinct.select(F.lit(0).alias("space"), "fp"))).withColumnRenamed("node", "fp")
    rooted = store(distinct.join(roots, "fp", "left").select("fp", "first_doc", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    component = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of = store(rooted.join(component, "root").select("fp", "n", "component_id"), "components")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return join_counted(prints, of, ["fp"]).select("doc_id", hexed.alias("fingerprint"), "component_id")


# --- similar texts --------------------------------------------------------------------------------------------------

#: Words of a shingle, and the similarity of the sets of shingles that is asked for: their cosine, as SimHash has it.
SHINGLE, SIMILARITY = 5, 0.8
#: Independent fingerprints of a text's distinct words; 64-bit parts of the sketch of its shingles.
SPACES, PARTS = 8, 16
#: Standard error of a similarity of 0.8 that is estimated from the sketch.
ERROR = 0.026
#: Rows of a key that are joined with each other; rows that are compared with all others of their key, at most, block by block.
MEET, FULL, ASK = 8, 4096, 1024
#: Keys of the words, and bands, whose crowded groups are the first to meet one of them; rounds of that; share of similar texts, at
#: most, that meet in no band.
EARLY_SPACES, EARLY_BANDS, ROUNDS, MISS = 2, 4, 3, 0.01
_CHUNK = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ x >> np.uint64(30)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _majority(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Each hash is widened to ``parts`` words; the bits set in over half of them."""
    ones, odd = np.zeros(64 * parts, dtype=np.int64), np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(hashes), _CHUNK):
        wide = _mix(hashes[i : i + _CHUNK, None] + odd).astype("<u8")
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8").astype(np.int64)


def sketch(text: str | None) -> tuple[int, int, np.ndarray, np.ndarray]:
    """128 bits of the words in order; the fingerprints of the distinct words; the sketch of the distinct shingles."""
    import xxhash

    found = (text or "").encode().lower().split()
    whole = xxhash.xxh128_intdigest(b" ".join(found))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)) if found else np.zeros(1, dtype=np.uint64)
    n = max(1, len(hashes) - SHINGLE + 1)
    shingles = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(hashes))):
        shingles = _mix(shingles * np.uint64(3) + hashes[k : k + n])
    high, low = np.array([whole >> 64, whole & 2**64 - 1], dtype=np.uint64).view(np.int64).tolist()
    return high, low, _majority(np.unique(hashes), SPACES), _majority(np.unique(shingles), PARTS)


def _sketches(batches):
    import pyarrow as pa

    for batch in slices(batches):
        got = [sketch(t) for t in batch.column("text").to_pylist()]
        high, low, prints, parts = zip(*got, strict=True)
        lists = [pa.ListArray.from_arrays(np.arange(0, n * len(got) + 1, n, dtype=np.int32), np.concatenate(x)) for n, x in ((SPACES, prints), (PARTS, parts))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(high), pa.array(low), *lists], names=["row", "high", "low", "fps", "sketch"])


def bits_apart(similarity: float) -> int:
    """Bits of the sketch in which sets of shingles of this cosine differ, on average."""
    return int(64 * PARTS * np.arccos(similarity) / np.pi)


def _distances(pairs: DataFrame, sketches: DataFrame, hot: bool = False) -> DataFrame:
    """(a, b), pairs of rows, to (a, b, d), the bits in which their sketches differ; with ``hot`` a row may be ``a`` of any number of pairs."""
    left, right = (sketches.select(F.col("row").alias(x), F.col("sketch").alias(f"{x}_sketch")) for x in "ab")
    if hot:
        side = store(pairs.groupBy("a").agg(F.count("*").alias("n")).join(left, "a"), "leaders")
        pairs = join_counted(pairs, side, ["a"])
    else:
        pairs = pairs.join(left, "a")
    apart = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(right, "b").select("a", "b", apart.alias("d"))


def _settle(groups: DataFrame, sketches: DataFrame, links: DataFrame, apart: int, early: int, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame | None]:
    """``links`` (a, b) and those that connect what differs in at most ``apart`` bits in each of ``groups`` (g, row), and the groups not done.

    All rows of a group of at most ``MEET`` meet. In a larger one, all meet one of them, its leader, at first where g < ``early`` alone.
    Then a group is done if links lead from each of its rows to each other. If all but ``FULL`` lead to one place, those are compared with
    all rows of the group, block by block, and it is done; else its rows meet another leader, ``rounds`` times in all.
    """
    sizes = store(groups.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("sum")).where("n > 1"), "sizes")
    few = store(join_counted(groups, sizes.where(F.col("n") <= MEET).select("g", "n"), ["g"]), "few")
    same = (F.col("x.g") == F.col("y.g")) & (F.col("x.row") < F.col("y.row"))
    pairs = few.alias("x").join(few.alias("y"), same).select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct()
    found = [links, _distances(pairs, sketches).where(F.col("d") <= apart).select("a", "b")]
    # groups of the same rows are one
    many = sizes.where(F.col("n") > MEET).groupBy("n", "sum").agg(F.min("g").alias("g")).select("g", "n")
    groups = store(join_counted(groups, many, ["g"]).select("g", "row"), "crowded")
    for k in range(rounds):
        if groups.isEmpty():
            break
        leader = F.min_by("row", F.xxhash64(F.lit(k), "row")).alias("leader")
        now = groups if k else groups.where(F.col("g") < early)
        of = store(now.groupBy("g").agg(F.count("*").alias("n"), leader), "leads")
        near = join_counted(now, of, ["g"]).select(F.col("leader").alias("a"), F.col("row").alias("b")).where("a <> b").distinct()
        found.append(_distances(near, sketches, hot=True).where(F.col("d") <= apart).select("a", "b"))
        links = store(_union(found), "links")
        found = [links]
        rooted = groups.join(connected(links).withColumnRenamed("node", "row"), "row", "left").select("g", "row", F.coalesce("root", "row").alias("root"))
        rooted = store(rooted, "rooted")
        each = rooted.groupBy("g", "root").agg(F.count("*").alias("n")).groupBy("g")
        each = each.agg(F.sum("n").alias("n"), F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("most")).where("roots > 1")
        each = store(each.select("g", "n", F.col("most.root").alias("main"), (F.col("n") - F.col("most.n")).alias("asking")), "apart")
        asks = each.where(F.col("asking") <= FULL)
        found.append(_blocks(join_counted(rooted, asks, ["g"]), sketches, apart))
        groups = store(join_counted(rooted, each.where(F.col("asking") > FULL), ["g"]).select("g", "row"), "crowded")
    else:
        return store(_union(found), "links"), groups
    return store(_union(found), "links"), None


def _union(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _word_keys(batches):
    import pyarrow as pa

    for batch in slices(batches, 2048):
        row = batch.column("row").to_numpy()
        fps = batch.column("fps").flatten().to_numpy(zero_copy_only=False).reshape(len(row), -1)
        for space in range(fps.shape[1]):
            at, keys = keys_of(np.ascontiguousarray(fps[:, space]))
            yield pa.RecordBatch.from_arrays([pa.array(space << 36 | keys), pa.array(row[at])], names=["g", "row"])


def bands(rows: int, apart: int, miss: float = MISS) -> np.ndarray:
    """Bits of a sketch that make up each band, a row a band: so many bits that about four of ``rows`` unlike texts share
    a band's value, and so many bands that two texts ``apart`` bits from each other share none with probability ``miss``."""
    bits = min(24, max(8, int(np.ceil(np.log2(max(rows, 1) / 4)))))
    shared = (1 - apart / (64 * PARTS)) ** bits
    count = int(np.ceil(np.log(miss) / np.log1p(-shared)))
    rng = np.random.RandomState(11)
    return np.stack([rng.choice(64 * PARTS, bits, replace=False) for _ in range(count)])


def _band_keys(places: np.ndarray):
    def run(batches):
        import pyarrow as pa

        weight, number = 1 << np.arange(places.shape[1]), np.arange(len(places)) << 32
        for batch in slices(batches, 256):
            row = batch.column("row").to_numpy()
            parts = batch.column("sketch").flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(row), -1)
            bits = np.unpackbits(parts.view(np.uint8), axis=1, bitorder="little")
            keys = bits[:, places].astype(np.int64) @ weight | number
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(row, len(places)))], names=["g", "row"])

    return run


def _unite(apart: int):
    """Rows (ask, row, root, sketch) of a block: links of rows that ask and others of another root, as many as it takes to connect them."""

    def unite(group):
        import pyarrow as pa

        ask, row, root = (group.column(c).to_numpy() for c in ("ask", "row", "root"))
        bits = group.column("sketch").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(row), -1)
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        out, asking, others = [], np.flatnonzero(ask == 1), np.flatnonzero(ask == 0)
        for i in asking:
            d = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
            for j in others[(d <= apart) & (root[others] != root[i])]:
                x, y = top(int(root[i])), top(int(root[j]))
                if x != y:
                    above[max(x, y)] = min(x, y)
                    out.append((int(row[i]), int(row[j])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return unite


def _blocks(rows: DataFrame, sketches: DataFrame, apart: int) -> DataFrame:
    """(g, row, root, n, main, asking) to links (a, b) of rows outside a group's main root and any of it, ``ASK`` with ``ASK`` a task."""
    rows = rows.withColumns({"row_parts": F.ceil(F.col("n") / ASK), "ask_parts": F.ceil(F.col("asking") / ASK)}).join(sketches.select("row", "sketch"), "row")
    part = lambda c: F.pmod(F.xxhash64("row"), F.col(c))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("ask_parts") - 1))
    cols = ["g", "p", "q", "ask", "row", "root", "sketch"]
    every = rows.select("g", part("row_parts").alias("q"), F.lit(0).alias("ask"), "row", "root", "sketch", others.alias("p")).select(*cols)
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_parts") - 1))
    asking = rows.where("root <> main").select("g", part("ask_parts").alias("p"), F.lit(1).alias("ask"), "row", "root", "sketch", others.alias("q")).select(*cols)
    return every.unionByName(asking).groupBy("g", "p", "q").applyInArrow(_unite(apart), "a long, b long")


def similar_links(unique: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(row, fps, sketch) of different texts to links (a, b) of rows."""
    apart = bits_apart(similarity - ERROR)
    keys = store(unique.mapInArrow(_word_keys, "g long, row long"), "keys")
    none = unique.select(F.col("row").alias("a"), F.col("row").alias("b")).limit(0)
    links, left = _settle(keys, unique, none, apart, EARLY_SPACES << 36)
    if left is None:
        return links
    # texts of much the same words in another order: the keys of the words can't tell them apart, the sketch can
    again = store(unique.join(left.select("row").distinct(), "row", "left_semi").select("row", "sketch"), "again")
    keys = store(again.mapInArrow(_band_keys(bands(again.count(), apart)), "g long, row long"), "bands")
    links, left = _settle(keys, again, links, apart, EARLY_BANDS << 32)
    if left is None:
        return links
    # what is left of a band: none leads to any other, so all of them ask
    rooted = left.join(connected(links).withColumnRenamed("node", "row"), "row", "left").select("g", "row", F.coalesce("root", "row").alias("root"))
    sizes = store(rooted.groupBy("g").agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("main"), F.count("*").alias("asking")), "sizes")
    rest = _blocks(join_counted(rooted, sizes, ["g"]).withColumn("main", F.lit(-1).cast("long")), again, apart)
    return links.unionByName(rest)


def similar(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(row long, text) to (row, group): the smallest row of those that similar texts lead to; ``row`` is unique.

    Two texts are similar if the cosine of their sets of five-word shingles is, as estimated from 1024-bit SimHash sketches, at most one
    standard error below ``similarity``; for sets of one size a cosine of 0.8 is two thirds of the union in common. Texts meet that share
    a Golay key of one of ``SPACES`` fingerprints of their distinct words. Where over ``MEET`` share one, all meet one of them, and then those that
    links don't connect with most others are compared with all under the key, block by block. Only where over ``FULL`` are apart,
    as texts of the same words in ever other orders are, they meet by bands of bits of their sketches instead, as many as it takes. So no group is one
    task, and a text is compared with a bounded number of others a key. Texts of the same words in order (ASCII case and white space aside) are one;
    NULL and wordless texts are such texts too.
    """
    spark = texts.sparkSession
    ship(spark)
    rows = store(texts.select(F.col("row").cast("long").alias("row"), "text").mapInArrow(_sketches, "row long, high long, low long, fps array<long>, sketch array<long>"), "sketches")
    copies = rows.groupBy("high", "low").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    copies = store(copies, "copies")
    unique = store(rows.join(copies.select(F.col("first").alias("row")), "row", "left_semi").select("row", "fps", "sketch"), "texts")
    roots = connected(similar_links(unique, similarity))
    of = copies.join(roots.withColumnRenamed("node", "first"), "first", "left").select("high", "low", "first", "n", F.coalesce("root", "first").alias("group"))
    single = of.where("n = 1").select(F.col("first").alias("row"), "group")
    several = join_counted(rows.select("row", "high", "low"), store(of.where("n > 1"), "copied"), ["high", "low"])
    return single.unionByName(several.select("row", "group"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
