"""As-of state tables and features of a suffix from them.

A state holds, for an exclusive cutoff c, what the features of later events need from events before c, as sums: by user (with
the last time), by item (one row for all that is older than 60 days before c, and one for each timestamp since), and by
user and group. All are monoids: the state at a later cutoff is the union with the events between, aggregated again.

Rows of state are weighted events: (n, s, ss) at the time they count from. Features of a suffix are the same windows over
the union of state rows and suffix rows, from which the state rows are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import DAY_US, age_years, pop_std, safe_ratio
from ..operators import buckets
from ..operators.history import at_times, global_times, window_ratios
from ..plans.features import genre_codes

KEEP_US = 60 * DAY_US
#: The time of what is older than any window.
OLD = -(2**60)
NAMES = ("user", "item", "group")
#: Kinds of rows that meet in a shuffle: events, and rows of the state's tables.
NEW, ITEM, USER, GROUP = range(4)
#: Columns of the tables in a document, and rows of one at most.
DOCUMENTS = {
    "user": "user_id long, event_us long, n long, s double, ss double", "item": "item_id long, event_us long, n long, s double, ss double",
    "group": "user_id long, genre string, event_us long, n long, s double",
}
DOCUMENT = 100_000


@dataclass
class State:
    cutoff_us: int
    count: int
    total: float
    user: DataFrame  # user_id, event_us, n, s, ss
    item: DataFrame  # item_id, event_us, n, s, ss
    group: DataFrame  # user_id, genre, event_us, n, s
    windows: bool = True  # whether recent rows of items are kept; fixed when a state is made
    trusted: bool = True  # whether all came through build and advance, with times


def weighted(events: DataFrame) -> DataFrame:
    r = F.col("rating")
    return events.select("*", F.lit(1).cast("long").alias("n"), r.alias("s"), (r * r).alias("ss"))


def _sums(df: DataFrame, *keys, ss: bool = True) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), *([F.sum("ss").alias("ss")] if ss else []))


def fold(user: DataFrame, item: DataFrame, group: DataFrame, cutoff_us: int, windows: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of state, or weighted events, summed to the rows of the state at the cutoff."""
    u = user.groupBy("user_id").agg(F.max("event_us").alias("event_us"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    recent = (F.col("event_us") >= cutoff_us - KEEP_US) & F.lit(windows)
    when = F.when(recent, F.col("event_us")).otherwise(F.lit(OLD)).alias("event_us")
    i = _sums(item, "item_id", when)
    g = _sums(group, "user_id", "genre", F.lit(OLD).alias("event_us"), ss=False)
    return u, i, g


def _rows(events: DataFrame, bridge: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    w = weighted(events)
    return w.select("user_id", "event_us", "n", "s", "ss"), w.select("item_id", "event_us", "n", "s", "ss"), w.join(bridge, "item_id").select("user_id", "genre", "event_us", "n", "s")


def build(events: DataFrame, bridge: DataFrame, cutoff_us: int, windows: bool = True) -> State:
    """The state of exactly the events before the cutoff.

    Without ``windows`` an item is one row, and neither rolling features nor a checkpoint can come from the state, nor from
    any that it is advanced to.
    """
    past = events.where(F.col("event_us") < cutoff_us)
    u, i, g = fold(*_rows(past, bridge), cutoff_us, windows)
    n, s = past.agg(F.count("*"), F.coalesce(F.sum("rating"), F.lit(0.0))).first()
    return State(cutoff_us, n, s, u, i, g, windows)


def add_untimed(state: State, ratings: DataFrame, bridge: DataFrame) -> State:
    """The state with ratings (user_id, item_id, rating) whose times are unknown: they count as older than any window.

    Such a state gives features, but isn't bound to a history any more, so no checkpoint is made of it.
    """
    u, i, g = _rows(ratings.withColumn("event_us", F.lit(OLD)), bridge)
    u, i, g = fold(state.user.unionByName(u), state.item.unionByName(i), state.group.unionByName(g), state.cutoff_us, state.windows)
    n, s = ratings.agg(F.count("*"), F.coalesce(F.sum("rating"), F.lit(0.0))).first()
    return State(state.cutoff_us, state.count + n, state.total + s, u, i, g, state.windows, False)


def advance(state: State, events: DataFrame, bridge: DataFrame, cutoff_us: int) -> State:
    """The state at a later cutoff from that at an earlier one and the events between; others among ``events`` don't count.

    A cutoff that isn't later raises ValueError.
    """
    if cutoff_us < state.cutoff_us:
        raise ValueError("the cutoff is before the state's")
    new = events.where((F.col("event_us") >= state.cutoff_us) & (F.col("event_us") < cutoff_us))
    u, i, g = _rows(new, bridge)
    u, i, g = fold(state.user.unionByName(u), state.item.unionByName(i), state.group.unionByName(g), cutoff_us, state.windows)
    n, s = new.agg(F.count("*"), F.coalesce(F.sum("rating"), F.lit(0.0))).first()
    return State(cutoff_us, state.count + n, state.total + s, u, i, g, state.windows, state.trusted)


def to_document(state: State, most: int = DOCUMENT) -> dict:
    """A small state as plain values in order of its keys, for JSON. More than ``most`` rows raise ValueError: tables are for these."""
    out = {"cutoff_us": state.cutoff_us, "count": state.count, "total": state.total, "windows": state.windows, "trusted": state.trusted}
    for name in NAMES:
        rows = getattr(state, name).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name}: more than {most} rows")
        key = [c for c in ("user_id", "item_id", "genre", "event_us") if c in rows[0]] if rows else []
        out[name] = sorted((r.asDict() for r in rows), key=lambda r: [r[c] for c in key])
    return out


def from_document(spark: SparkSession, document: dict) -> State:
    """The state of ``to_document``. Other fields, values of other types, or sums that disagree raise ValueError; nothing is cast."""
    plain = {"cutoff_us": int, "count": int, "total": float, "windows": bool, "trusted": bool}
    if not isinstance(document, dict) or set(document) != {*plain, *NAMES}:
        raise ValueError("the document's fields differ")
    if wrong := [k for k, kind in plain.items() if type(document[k]) is not kind]:
        raise ValueError(f"{wrong} are of other types")
    kinds = {"long": int, "double": float, "string": str}
    found = []
    for name, schema in DOCUMENTS.items():
        want = dict(c.split() for c in schema.split(", "))
        for row in document[name]:
            if set(row) != set(want) or any(type(row[c]) is not kinds[k] for c, k in want.items()):
                raise ValueError(f"{name}: {row}")
        found.append(spark.createDataFrame([tuple(r[c] for c in want) for r in document[name]], schema))
    state = State(document["cutoff_us"], document["count"], document["total"], *found, document["windows"], document["trusted"])
    if not conservation(state).first()["ok"]:
        raise ValueError("the state's sums disagree")
    return state


def _before(*key: str, upto: int = -1):
    return W.partitionBy(*key).orderBy("event_us").rangeBetween(W.unboundedPreceding, upto)


def _met(state: State, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of the state's tables, of the keys of ``events`` alone where these are few, so that a small batch shuffles no whole state."""
    if events.limit(buckets.BROADCAST + 1).count() > buckets.BROADCAST:
        return state.user, state.item, state.group
    of = lambda rows, key: rows.join(F.broadcast(events.select(F.col(key).alias("__k")).distinct()), F.col(key).eqNullSafe(F.col("__k")), "left_semi")
    return of(state.user, "user_id"), of(state.item, "item_id"), of(state.group, "user_id")


def suffix_features(state: State, events: DataFrame, catalog: DataFrame, windows: bool = True) -> DataFrame:
    """Features of the 22 columns that need no vectors, for the events from the state's cutoff on, in double precision.

    Without ``windows`` those of rolling windows are NULL; only so can a state that was made without them be used. A user
    whose last time isn't known has no recency before the first event here.
    """
    if windows and not state.windows:
        raise ValueError("the state was made without windows")
    zero, mine, rating = F.lit(0.0), F.col("__kind") == NEW, F.col("rating")
    e = events.where(F.col("event_us") >= state.cutoff_us).select("event_id", "user_id", "item_id", "rating", "event_us")
    times, few = global_times(e, count=state.count, total=state.total)
    e = e if few else at_times(e, times)
    # events and state rows are dealt by the key once; weights are made after that, and means only of the last rows
    own = lambda new, c, none: F.when(mine, new).otherwise(F.coalesce(c, none))
    kind = lambda df, k: df.withColumn("__kind", F.lit(k))
    user, item, group = _met(state, e)
    e = kind(e, NEW).unionByName(kind(item.select("item_id", "event_us", "n", "s", "ss"), ITEM), allowMissingColumns=True).repartition("item_id")
    e = e.withColumns({"n": own(F.lit(1).cast("long"), "n", F.lit(0)), "s": own(rating, "s", zero), "ss": own(rating * rating, "ss", zero)})
    w, w30, w60 = _before("item_id"), _before("item_id", upto=-30 * DAY_US - 1), _before("item_id", upto=-60 * DAY_US - 1)
    new = {"item_count": F.coalesce(F.sum("n").over(w), F.lit(0)), "__is": F.coalesce(F.sum("s").over(w), zero), "__iss": F.coalesce(F.sum("ss").over(w), zero)}
    for name, out in (("30d", w30), ("60d", w60)):
        new |= {f"__n_{name}": F.coalesce(F.sum("n").over(out), F.lit(0)), f"__s_{name}": F.coalesce(F.sum("s").over(out), zero)}
    e = e.withColumns(new).where(mine).drop("n", "s", "ss")
    of_items, code, genre = catalog.select("item_id", "release_year", "genres"), genre_codes(catalog), F.col("genre")
    if code is not None:  # numbers are shuffled for genres; what no item has now meets no event
        of_items, group, genre = of_items.withColumn("genres", F.transform("genres", code)), group.where(code(genre) > 0), code(genre)
    e = e.join(of_items, "item_id", "left")

    u = user.select("user_id", "event_us", "n", "s", "ss")
    g = group.select("user_id", F.lit(OLD).alias("event_us"), F.array(genre).alias("genres"), "n", "s")
    e = e.unionByName(kind(u, USER), allowMissingColumns=True).unionByName(kind(g, GROUP), allowMissingColumns=True).repartition("user_id")
    w, theirs, n, s = _before("user_id"), F.col("__kind") == USER, F.col("n"), F.col("s")
    e = e.withColumns({
        "__un": F.when(mine, 1).when(theirs, n).otherwise(0), "__us": F.when(mine, rating).when(theirs, s).otherwise(0.0), "__uss": F.when(mine, rating * rating).when(theirs, F.col("ss")).otherwise(0.0),
    })
    e = e.withColumns({
        "user_count": F.coalesce(F.sum("__un").over(w), F.lit(0)).cast("long"), "__us": F.coalesce(F.sum("__us").over(w), zero), "__uss": F.coalesce(F.sum("__uss").over(w), zero), "__last": F.nullif(F.max("event_us").over(w), F.lit(OLD)),
    }).where(~theirs)

    e = e.withColumns({"n": own(F.lit(1).cast("long"), "n", F.lit(0)), "s": own(rating, "s", zero), "item_genres": F.coalesce(F.size("genres"), F.lit(0))}).drop("__un", "ss")
    others = [c for c in e.columns if c not in ("user_id", "event_id", "genres", "n", "s", "__kind")]
    # plain columns alone, as an array would have each row of a genre sorted for the grouping
    x = e.select("user_id", "event_id", *others, "n", "s", "__kind", F.explode_outer("genres").alias("genre"))
    w = _before("user_id", "genre")
    x = x.withColumns({"__gn": F.when(F.col("genre").isNotNull(), F.sum("n").over(w)), "__gs": F.when(F.col("genre").isNotNull(), F.sum("s").over(w))}).where(mine)
    e = x.groupBy("user_id", "event_id").agg(*[F.first(c).alias(c) for c in others], F.coalesce(F.sum("__gn"), F.lit(0)).alias("user_genre_count"), F.sum("__gs").alias("__gs"))

    e = at_times(e, times) if few else e
    n, un = F.col("item_count").cast("double"), F.col("user_count").cast("double")
    more = {"item_mean": F.coalesce(safe_ratio(F.col("__is"), n), "global_mean"), "item_std": pop_std(n, F.col("__is"), F.col("__iss"))}
    for name in ("30d", "60d"):
        k = F.col("item_count") - F.col(f"__n_{name}")
        more |= {f"item_count_{name}": k, f"item_mean_{name}": safe_ratio(F.col("__is") - F.col(f"__s_{name}"), k.cast("double"))}
    more |= {
        "user_mean": F.coalesce(safe_ratio(F.col("__us"), un), "global_mean"), "user_std": pop_std(un, F.col("__us"), F.col("__uss")), "user_recency_s": (F.col("event_us") - F.col("__last")) / F.lit(1e6),
    }
    e = window_ratios(e.withColumns(more))
    if not windows:
        kinds = dict(e.dtypes)
        e = e.withColumns({c: F.lit(None).cast(kinds[c]) for c in ("item_count_30d", "item_mean_30d", "item_count_60d", "item_mean_60d", "item_mean_ratio", "item_count_ratio")})
    mean = F.coalesce(safe_ratio(F.col("__gs"), F.col("user_genre_count").cast("double")), "user_mean")
    e = e.withColumns({
        "user_genre_mean": mean, "user_genre_delta": mean - F.col("user_mean"), "item_year": F.col("release_year"), "item_year_missing": F.col("release_year").isNull(),
        "item_age_years": age_years(F.col("event_us"), F.col("release_year")),
    })
    return e.drop(*[c for c in e.columns if c.startswith("__")])


def conservation(state: State) -> DataFrame:
    """One row: counts and sums by user and by item against the whole; group counts over user counts; ``ok``."""
    u = state.user.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("user_n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("user_s"))
    i = state.item.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("item_n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("item_s"), F.coalesce(F.sum(F.when(F.col("event_us") != OLD, F.col("n"))), F.lit(0)).alias("recent_n"))
    over = state.group.alias("g").join(state.user.alias("u"), "user_id").where("g.n > u.n").agg(F.count("*").alias("groups_over_user"))
    all_ = u.crossJoin(i).crossJoin(over).withColumns({"n": F.lit(state.count).cast("long"), "s": F.lit(float(state.total))})
    ok = (F.col("user_n") == F.col("n")) & (F.col("item_n") == F.col("n")) & (F.col("user_s") == F.col("s")) & (F.col("item_s") == F.col("s")) & (F.col("groups_over_user") == 0)
    return all_.withColumn("ok", ok)
