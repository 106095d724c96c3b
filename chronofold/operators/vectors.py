"""Item vectors and the profiles that a user's history makes of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import norm
from ..session import reach_workers
from ..sources.publish import stored
from .buckets import bucketed

# The rating from which an item is liked; similarities and tags averaged; tags needed.
LIKED = 4.0
NEAREST, TOP, MIN_TAGS = 5, 10, 10
#: Numbers of the vectors of all items that a broadcast may hold (64 MB of float32).
BROADCAST = 16 << 20
#: Rows of a running sum, and similarities, held at once.
CHUNK, NUMBERS = 1024, 1 << 21
#: Of a hot user: tasks that add up a bucket's vectors, at most; rows of a block of items.
PARTS, BLOCK = 8, 4096


def vectors(scores: DataFrame) -> DataFrame:
    """(item_id, tag_id, relevance) to (item_id, vector): items with every tag, by tag_id, of a finite norm above zero.

    Fewer than ``MIN_TAGS`` distinct tags raise ValueError, none give no vectors.
    """
    n = scores.select(F.count_distinct("tag_id")).first()[0]
    if 0 < n < MIN_TAGS:
        raise ValueError(f"{MIN_TAGS} tags are needed, there are {n}")
    v = F.transform(F.sort_array(F.collect_list(F.struct("tag_id", "relevance"))), lambda x: x["relevance"])
    dense = scores.where("relevance IS NOT NULL").groupBy("item_id").agg(v.alias("vector")).where(F.size("vector") == n)
    size = norm("vector")
    return dense.where((size > 0) & (size < float("inf")))


def statistics(vectors: DataFrame) -> DataFrame:
    """(item_id, vector_mean, vector_std, vector_top10): mean, population deviation, mean of the ten largest."""
    x, n = F.transform("vector", lambda x: x.cast("double")), F.size("vector")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    v = vectors.select("item_id", x.alias("x"), n.alias("n")).withColumn("m", total("x") / F.col("n"))
    v = v.withColumn("q", F.transform("x", lambda y: (y - F.col("m")) * (y - F.col("m"))))
    top = F.slice(F.sort_array("x", asc=False), 1, TOP)
    return v.select("item_id", F.col("m").alias("vector_mean"), F.sqrt(total("q") / F.col("n")).alias("vector_std"), (total(top) / F.least("n", F.lit(TOP))).alias("vector_top10"))


def _unit(vector: np.ndarray) -> np.ndarray:
    """Normalised in double, kept in 32 bits, multiplied in double."""
    return (vector / np.sqrt(np.einsum("ij,ij->i", vector, vector))[:, None]).astype(np.float32).astype(np.float64)


def _profile(item: np.ndarray, vector: np.ndarray, unit: np.ndarray, rating: np.ndarray, us: np.ndarray, start=(None, None), near: np.ndarray | None = None):
    """Features of one user's events, sorted by time; ``item`` is the row in ``vector`` and ``unit``, -1 without one.

    Sums grow by time, some rows at once with the sum so far carried over; what a row sees ends before the first row of its
    own time. Similarities are taken against the distinct liked items, in blocks of targets, with how often each was liked
    by then. So what is held at once doesn't grow with the user's events, but for the events themselves. Where events are only
    a part of the user's, ``start`` has the sums of vectors liked and disliked before them, and ``near`` of each row the ``NEAREST`` largest
    similarities to items liked before them, -inf where there are fewer.
    """
    n = len(item)
    out = np.full((n, 4), np.nan)
    top = np.full((n, NEAREST), -np.inf) if near is None else near.copy()
    seen = np.searchsorted(us, us, side="left")  # rows before each row's time
    has = item >= 0

    def cosine(rows: np.ndarray, sums: np.ndarray, k: int) -> None:
        size = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        with np.errstate(invalid="ignore", divide="ignore"):
            out[rows, k] = np.where(size > 0, np.einsum("ij,ij->i", unit[item[rows]], sums) / size, np.nan)

    for k, want in enumerate((rating >= LIKED, rating < LIKED)):
        rows = np.flatnonzero(has & want)
        upto = np.searchsorted(rows, seen)  # how many of them each row sees; it never falls
        first = np.flatnonzero(has & (upto == 0))
        if start[k] is not None and len(first):
            for i in range(0, len(first), CHUNK):
                cosine(first[i : i + CHUNK], np.broadcast_to(start[k], (len(first[i : i + CHUNK]), len(start[k]))), k)
        if not len(rows):
            continue
        at = np.flatnonzero(has & (upto > 0))
        carried = np.zeros(vector.shape[1]) if start[k] is None else start[k]
        for c in range(0, len(rows), CHUNK):
            sums = np.cumsum(vector[item[rows[c : c + CHUNK]]], axis=0) + carried
            carried = sums[-1]
            first, last = np.searchsorted(upto[at], [c, c + len(sums)], side="right")
            for i in range(first, last, CHUNK):
                some = at[i : min(last, i + CHUNK)]
                cosine(some, sums[upto[some] - 1 - c], k)
        if k == 0:
            _nearest(top, item, unit, item[rows], upto, at)
    some = np.flatnonzero(has & (top[:, 0] > -np.inf))
    out[some, 2] = top[some, 0]
    there = top[some] > -np.inf
    out[some, 3] = np.where(there, top[some], 0).sum(axis=1) / there.sum(axis=1)
    return out


def _largest(sims: np.ndarray, often) -> np.ndarray:
    """The ``NEAREST`` largest of each row of ``sims``, falling, each as often as ``often(columns)`` says; -inf where there are fewer."""
    k = min(NEAREST, sims.shape[1])
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(sims, best, axis=1)
    order = np.argsort(-value, axis=1, kind="stable")
    best, value = np.take_along_axis(best, order, axis=1), np.take_along_axis(value, order, axis=1)
    ends = np.cumsum(np.where(value > -np.inf, often(best), 0), axis=1)
    out = np.full((len(sims), NEAREST), -np.inf)
    for slot in range(NEAREST):
        which = (ends <= slot).sum(axis=1)
        ok = np.flatnonzero(which < k)
        out[ok, slot] = value[ok, which[ok]]
    return out


def _nearest(top: np.ndarray, item: np.ndarray, unit: np.ndarray, liked: np.ndarray, upto: np.ndarray, at: np.ndarray) -> None:
    """Merges into ``top``, for the rows ``at``, the largest similarities to the first ``upto`` of ``liked``."""
    distinct, since, which = np.unique(liked, return_index=True, return_inverse=True)
    # places of an item's likes, item after item, so that a binary search counts those before a place
    step = len(liked) + 1
    places = np.sort(which * step + np.arange(len(liked)))
    block = max(16, NUMBERS // len(distinct))
    for i in range(0, len(at), block):
        some = at[i : i + block]
        sims = unit[item[some]] @ unit[distinct].T
        sims[since >= upto[some][:, None]] = -np.inf
        found = _largest(sims, lambda best, some=some: np.searchsorted(places, best * step + upto[some][:, None]) - np.searchsorted(places, best * step))
        top[some] = -np.sort(-np.concatenate([top[some], found], axis=1), axis=1)[:, :NEAREST]


NAMES = ("liked_cosine", "disliked_cosine", "nearest_liked", "top5_liked")


class _Vectors:
    """The vectors of items inside a task: those of a broadcast, or those that came with the rows."""

    def __init__(self, spark, have: DataFrame):
        count, length = have.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
        self.shared, self.have = None, have
        if count * length <= BROADCAST:
            rows = have.toArrow()  # no row becomes an object of its own
            ids = rows.column("item_id").to_numpy()
            order = np.argsort(ids)
            matrix = rows.column("vector").combine_chunks().flatten().to_numpy().astype(np.float32).reshape(count, -1)[order] if count else np.zeros((0, 1), np.float32)
            self.shared = spark.sparkContext.broadcast((ids[order], matrix))

    def join(self, rows: DataFrame) -> DataFrame:
        """The rows whose item has a vector, and the vector where it isn't broadcast."""
        return rows.join(self.have, "item_id") if self.shared is None else rows.join(F.broadcast(self.have.select("item_id")), "item_id", "left_semi")

    def reader(self):
        """A function of a table's item_id to (row in a matrix, -1 without one; the matrix)."""
        shared = self.shared

        def read(table):
            import pyarrow as pa

            uniq, first, item = np.unique(table.column("item_id").to_numpy(), return_index=True, return_inverse=True)
            if shared is not None:
                known, matrix = shared.value
                at = np.searchsorted(known, uniq)
                ok = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == uniq) if len(known) else np.zeros(len(uniq), bool)
                local = matrix[at[ok]].astype(np.float64)
            else:
                values = table.column("vector").take(pa.array(first)).to_pylist()
                ok = np.array([v is not None for v in values], dtype=bool)
                local = np.array([v for v in values if v is not None], dtype=np.float64)
            place = np.full(len(uniq), -1)
            place[ok] = np.arange(ok.sum())
            return place[item], local

        return read


def _groups(batches, *keys: str):
    """Tables of whole groups of rows that lie sorted by ``keys``; those of a group at the end of a batch wait for the next one."""
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([batch.column(k).to_numpy() for k in keys])
        change = np.flatnonzero((now[:, 1:] != now[:, :-1]).any(axis=0)) + 1
        cut = int(change[-1]) if len(change) else 0
        if held and (cut or (now[:, 0] != last).any()):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
        last = now[:, -1]
    if held:
        yield pa.Table.from_batches(held)


_SCHEMA = "event_id long, user_id long, " + ", ".join(f"{n} double" for n in NAMES)


def preference_history(events: DataFrame, vectors: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(event_id, user_id) with the profile features of events whose item has a vector; the others have no row.

    The state is a user's alone: one pass over the user's events. Vectors go to the tasks once, while they are small, and
    else come with the events. ``hot`` as from ``buckets.hot_keys`` of the users: their passes go by (user, bucket of time), and a bucket
    begins with what earlier ones hand on: sums of vectors, and of each of its items the nearest ones liked before.
    """
    spark = events.sparkSession
    reach_workers(spark)
    known = _Vectors(spark, vectors.select("item_id", "vector"))
    read = known.reader()
    base = events.select("event_id", "user_id", "item_id", "event_us", "rating").where("user_id IS NOT NULL AND item_id IS NOT NULL")
    cut = hot is not None
    if cut:
        base = bucketed(base, "user_id", hot)

    def features(table):
        """Whole users, or whole buckets of them, sorted by time after what earlier buckets hand on."""
        import pyarrow as pa

        item, local = read(table)
        users, rating, us = (table.column(c).to_numpy() for c in ("user_id", "rating", "event_us"))
        bucket, kind = (table.column(c).to_numpy() for c in ("__b", "__kind")) if cut else (np.zeros(len(item), np.int64), np.full(len(item), 2))
        out = np.full((len(item), 4), np.nan)
        unit = _unit(local) if len(local) else local
        for a, b in zip(*_runs(users, bucket), strict=True):
            start, near, e = (None, None), None, a + int(np.searchsorted(kind[a:b], 2))
            if e > a:  # handed on
                start = tuple(None if (v := table.column(c)[a].as_py()) is None else np.array(v) for c in ("liked", "disliked")) if kind[a] == 0 else start
                found = {int(item[i]): table.column("near")[i].as_py() for i in range(a, e) if kind[i] == 1}
                near = np.full((b - e, NEAREST), -np.inf)
                for i in range(e, b):
                    if (v := found.get(int(item[i]))) is not None and item[i] >= 0:
                        near[i - e, : len(v)] = v
            if (item[e:b] >= 0).any():
                out[e:b] = _profile(item[e:b], local, unit, rating[e:b], us[e:b], start, near)
        has = np.flatnonzero((item >= 0) & (kind == 2))
        columns = [pa.array(table.column("event_id").to_numpy(zero_copy_only=False)[has].astype(np.int64)), pa.array(users[has])]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(out[has, k], from_pandas=True) for k in range(4)]], names=["event_id", "user_id", *NAMES])

    def run(batches):
        for table in _groups(batches, *(["user_id", "__b"] if cut else ["user_id"])):
            yield features(table)

    rows = known.join(base)
    if not cut:
        return rows.repartition("user_id").sortWithinPartitions("user_id", "event_us").mapInArrow(run, _SCHEMA)
    # stored, as several branches read them, and so that the plan of one is not part of the plan of all
    rows = stored(rows, "rows-of-users")
    some = rows.where("__last IS NOT NULL")
    handed = stored(_sums_before(some, read), "sums-before"), stored(_near_before(some, known, read), "near-before")
    rows = rows.drop("__last").withColumn("__kind", F.lit(2))
    for more in (handed[0].withColumn("__kind", F.lit(0)), known.join(handed[1]).withColumn("__kind", F.lit(1))):
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = rows.withColumns({"item_id": F.coalesce("item_id", F.lit(-1).cast("long")), "event_us": F.coalesce("event_us", F.lit(0).cast("long")), "rating": F.coalesce("rating", F.lit(0.0))})
    return rows.repartition("user_id", "__b").sortWithinPartitions("user_id", "__b", "__kind", "event_us").mapInArrow(run, _SCHEMA)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin and end."""
    change = np.zeros(len(keys[0]), dtype=bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    first = np.concatenate([[0], np.flatnonzero(change)]).astype(np.int64)
    return first, np.append(first[1:], len(change))


def _parts(events: DataFrame) -> int:
    """Parts that a bucket's vectors are added up in: one for each ``BLOCK`` rows of the largest bucket, ``PARTS`` at most, as each part costs a call."""
    most = events.where("__b < __last").groupBy("user_id", "__b").count().agg(F.max("count")).first()[0] or 0
    return max(1, min(PARTS, -(-most // BLOCK)))


def _sums_before(events: DataFrame, read) -> DataFrame:
    """(user_id, __b, liked, disliked): the sums of vectors of earlier buckets, for each bucket of hot users after the first.

    Events are counted by item before any vector is added, each bucket in some tasks (``_parts``).
    """
    liked = F.col("rating") >= LIKED
    same = [c for c in ("vector",) if c in events.columns]
    counts = events.groupBy("user_id", "__b", "item_id").agg(F.max("__last").alias("__last"), F.sum(F.when(liked, 1.0).otherwise(0.0)).alias("n1"), F.sum(F.when(liked, 0.0).otherwise(1.0)).alias("n0"), *[F.first(c).alias(c) for c in same])
    counts = counts.where("__b < __last").withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(_parts(events))))

    def add(group):
        import pyarrow as pa

        item, local = read(group)
        ok = item >= 0
        total = {c: (group.column(n).to_numpy()[ok] @ local[item[ok]]).tolist() if group.column(n).to_numpy()[ok].any() else None for c, n in (("liked", "n1"), ("disliked", "n0"))}
        one = {c: [group.column(c)[0].as_py()] for c in ("user_id", "__b", "__last")}
        return pa.table(one | {c: pa.array([v], pa.list_(pa.float64())) for c, v in total.items()})

    def before(group):
        import pyarrow as pa

        last, sums, rows = group.column("__last")[0].as_py(), [None, None], []
        of: dict[int, list] = {}
        for b, *found in zip(*(group.column(c).to_pylist() for c in ("__b", "liked", "disliked")), strict=True):
            of.setdefault(b, []).append(found)
        for b in range(1, last + 1):
            for found in of.get(b - 1, []):
                sums = [s if v is None else np.array(v) if s is None else s + v for s, v in zip(sums, found, strict=True)]
            rows.append((b, *[None if s is None else s.tolist() for s in sums]))
        b, liked, disliked = zip(*rows, strict=True)
        kind = pa.list_(pa.float64())
        return pa.table({"user_id": pa.array([group.column("user_id")[0].as_py()] * len(b), pa.int64()), "__b": pa.array(b, pa.int64()), "liked": pa.array(liked, kind), "disliked": pa.array(disliked, kind)})

    arrays = "liked array<double>, disliked array<double>"
    sums = counts.groupBy("user_id", "__b", "part").applyInArrow(add, f"user_id long, __b long, __last long, {arrays}")
    return sums.groupBy("user_id").applyInArrow(before, f"user_id long, __b long, {arrays}")  # PARTS rows a bucket


def _near_before(events: DataFrame, known: _Vectors, read) -> DataFrame:
    """(user_id, __b, item_id, near): of each item in a bucket, the ``NEAREST`` largest similarities to items liked in earlier buckets.

    An item counts for as many as ``NEAREST`` of its likes, so no more of them are kept; items of the targets and liked ones are
    multiplied block by block, each pair of blocks a task of its own, and the largest of blocks are merged.
    """
    upto = W.partitionBy("user_id", "item_id").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    past = events.where((F.col("rating") >= LIKED) & (F.col("__b") < F.col("__last"))).groupBy("user_id", "item_id", "__b").agg(F.count("*").alias("n"))
    past = past.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where(F.col("before") < NEAREST)
    past = past.select("user_id", "item_id", "__b", F.least("n", NEAREST - F.col("before")).alias("n"))
    targets = events.where("__b > 0").select("user_id", "item_id", "__b").distinct().withColumn("n", F.lit(0).cast("long"))
    sizes = past.withColumn("p", F.lit(1)).unionByName(targets.withColumn("p", F.lit(0))).groupBy("user_id")
    sizes = sizes.agg(F.ceil(F.sum("p") / BLOCK).alias("of_past"), F.ceil(F.sum(1 - F.col("p")) / BLOCK).alias("of_targets")).where("of_past > 0 AND of_targets > 0")
    rows = None
    for df, own, other in ((past, "of_past", "of_targets"), (targets, "of_targets", "of_past")):
        df = df.join(sizes, "user_id").select("user_id", "item_id", "__b", "n", F.pmod(F.xxhash64("item_id"), F.col(own)).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("y"))
        df = df.select("user_id", "item_id", "__b", "n", *([F.col("x").alias("hb"), F.col("y").alias("tb")] if own == "of_past" else [F.col("y").alias("hb"), F.col("x").alias("tb")]))
        rows = df if rows is None else rows.unionByName(df)

    def multiply(group):
        import pyarrow as pa

        item, local = read(group)
        unit = _unit(local) if len(local) else local
        bucket, n = group.column("__b").to_numpy(), group.column("n").to_numpy()
        liked, wanted = np.flatnonzero((n > 0) & (item >= 0)), np.flatnonzero((n == 0) & (item >= 0))
        near = np.full((len(wanted), NEAREST), -np.inf)
        if len(liked):
            step = max(16, NUMBERS // len(liked))
            for i in range(0, len(wanted), step):
                some = wanted[i : i + step]
                sims = unit[item[some]] @ unit[item[liked]].T
                sims[bucket[liked] >= bucket[some][:, None]] = -np.inf
                near[i : i + step] = _largest(sims, lambda best: n[liked][best])
        keep = near[:, 0] > -np.inf
        lists = [row[row > -np.inf].tolist() for row in near[keep]]
        at = pa.array(wanted[keep])
        return pa.table({c: group.column(c).take(at) for c in ("user_id", "__b", "item_id")} | {"near": pa.array(lists, pa.list_(pa.float64()))})

    found = known.join(rows).groupBy("user_id", "hb", "tb").applyInArrow(multiply, "user_id long, __b long, item_id long, near array<double>")
    return found.groupBy("user_id", "__b", "item_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near")), asc=False), 1, NEAREST).alias("near"))


def _units(vectors: DataFrame, item_id: int, name: str) -> DataFrame:
    unit = vectors.where(F.col("item_id") == item_id).select(F.posexplode(F.transform("vector", lambda x: x.cast("double") / norm("vector"))).alias("pos", name))
    return unit.select((F.col("pos") + 1).alias("tag_id"), name)


def attribution(vectors: DataFrame, item_id: int, other_id: int, k: int = TOP) -> DataFrame:
    """The k tags with the largest difference between two normalised vectors, largest first."""
    diff = F.col("a") - F.col("b")
    j = _units(vectors, item_id, "a").join(_units(vectors, other_id, "b"), "tag_id")
    return j.select("tag_id", "a", "b", diff.alias("difference")).orderBy(F.abs(diff).desc(), "tag_id").limit(k)


def top_tags(vectors: DataFrame, item_id: int, k: int = TOP) -> DataFrame:
    """(tag_id, weight): the k largest of an item's normalised vector, largest first; ties by tag."""
    return _units(vectors, item_id, "weight").orderBy(F.desc("weight"), "tag_id").limit(k)


def contributions(vectors: DataFrame, item_id: int, other_id: int, k: int = 8) -> DataFrame:
    """(tag_id, contribution): the k tags that add most to the cosine of two items, largest first; ties by tag."""
    j = _units(vectors, item_id, "a").join(_units(vectors, other_id, "b"), "tag_id")
    return j.select("tag_id", (F.col("a") * F.col("b")).alias("contribution")).orderBy(F.desc("contribution"), "tag_id").limit(k)
