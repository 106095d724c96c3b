"""Declarative checks, compiled to one aggregation pass a table; each failure raises ValueError."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import Dataset

NO_GENRE = "(no genres listed)"


def violation_exprs(dataset: Dataset) -> dict[str, Column]:
    """A condition for each way a row can break the columns' declarations."""
    out: dict[str, Column] = {}
    for c in dataset.columns:
        v = F.col(c.name)
        if not c.nullable:
            out[f"{c.name} is null"] = v.isNull()
        if c.kind in ("float", "double"):
            out[f"{c.name} is not finite"] = F.isnan(v) | (F.abs(v) == float("inf"))
        if c.low is not None:
            out[f"{c.name} below {c.low}"] = v < c.low
        if c.high is not None:
            out[f"{c.name} above {c.high}"] = v > c.high
        if c.values:
            out[f"{c.name} outside its values"] = v.isNotNull() & ~v.isin(*c.values)
    return out


def violations(df: DataFrame, dataset: Dataset) -> DataFrame:
    """One row: how many rows break each rule, in one pass."""
    return df.agg(*[F.count_if(e).alias(name) for name, e in violation_exprs(dataset).items()])


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def check_frame(df: DataFrame, dataset: Dataset) -> None:
    dataset.check_columns(df.columns)
    broken = {k: v for k, v in violations(df, dataset).first().asDict().items() if v}
    if broken:
        raise ValueError(f"{dataset.name}: {broken}")
    if dataset.key and (some := duplicate_keys(df, list(dataset.key)).limit(5).collect()):
        raise ValueError(f"{dataset.name}: repeated keys {[tuple(r)[:-1] for r in some]}")


def check_types(df: DataFrame, types: dict[str, str]) -> None:
    """Column types by name; a zoned timestamp where a naive one is declared is told apart."""
    have = dict(df.dtypes)
    for name, kind in types.items():
        if name not in have:
            raise ValueError(f"missing column {name}")
        if have[name] != kind:
            hint = "; timestamps must be naive" if kind == "timestamp_ntz" and have[name] == "timestamp" else ""
            raise TypeError(f"{name} is {have[name]}, not {kind}{hint}")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``rows`` that ``parents`` lacks."""
    return rows.select(key).distinct().join(parents.select(key).distinct(), key, "left_anti")


def check_references(rows: DataFrame, parents: DataFrame, key: str, what: str) -> None:
    if some := orphans(rows, parents, key).limit(5).collect():
        raise ValueError(f"{what}: unknown {key} {[r[0] for r in some]}")


def genre_faults(items: DataFrame) -> DataFrame:
    """Items whose genre text breaks the grammar: an empty token, outer white space, or the sentinel among others."""
    tokens = F.split("genres", r"\|")
    empty = F.exists(tokens, lambda g: g == "")
    space = F.exists(tokens, lambda g: F.trim(g) != g)
    mixed = F.array_contains(tokens, NO_GENRE) & (F.size(tokens) > 1)
    fault = F.when(F.col("genres").isNull() | empty, "empty").when(space, "space").when(mixed, "mixed")
    return items.select("item_id", fault.alias("fault")).where("fault IS NOT NULL")


def bridge_faults(bridge: DataFrame, items: DataFrame, genres: DataFrame) -> DataFrame:
    """(fault, n): repeated pairs, malformed tokens, and pairs of an unknown item or genre."""
    repeated = duplicate_keys(bridge, ["item_id", "genre"]).agg(F.count("*").alias("n")).select(F.lit("repeated").alias("fault"), "n")
    bad = (F.col("genre") == "") | F.contains("genre", F.lit("|")) | (F.trim("genre") != F.col("genre")) | F.col("genre").isNull()
    token = bridge.agg(F.count_if(bad).alias("n")).select(F.lit("token").alias("fault"), "n")
    item = orphans(bridge, items, "item_id").agg(F.count("*").alias("n")).select(F.lit("item").alias("fault"), "n")
    genre = orphans(bridge, genres, "genre").agg(F.count("*").alias("n")).select(F.lit("genre").alias("fault"), "n")
    return repeated.unionByName(token).unionByName(item).unionByName(genre)


def domain_report(df: DataFrame, dataset: str, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(dataset, column, nulls, out_of_domain) of numeric columns against closed ranges, in one pass."""
    sums = []
    for name, (low, high) in ranges.items():
        x = F.col(name)
        sums += [F.count_if(x.isNull()).alias(f"n_{name}"), F.count_if(~x.between(low, high)).alias(f"d_{name}")]
    one = df.agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"n_{n}").alias("nulls"), F.col(f"d_{n}").alias("out_of_domain")) for n in ranges])).alias("r")
    return one.select(F.lit(dataset).alias("dataset"), rows).select("dataset", "r.*")


#: What a canonical item's genres may be.
STATUSES = ("listed", "missing_in_source")


def item_faults(items: DataFrame) -> DataFrame:
    """(item_id, fault), one row a fault: canonical items without a title, with a year outside 1 to 9999, an unknown status, or an
    id that is missing, below 1 or repeated."""
    year, k = F.col("release_year"), F.col("item_id")
    faults = {
        "title": F.coalesce(F.trim("title") == "", F.lit(True)), "year": F.coalesce((year < 1) | (year > 9999), F.lit(False)),
        "status": ~F.coalesce(F.col("genre_status").isin(*STATUSES), F.lit(False)), "id": F.coalesce(k < 1, F.lit(True)),
    }
    each = F.explode(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in faults.items()]), lambda x: x.isNotNull())).alias("fault")
    repeated = items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").select("item_id", F.lit("repeated").alias("fault"))
    return items.select("item_id", each).unionByName(repeated)


def check_items(items: DataFrame) -> None:
    """Raises ValueError where ``item_faults`` finds one; the columns must be there."""
    if missing := {"item_id", "title", "release_year", "genre_status"} - set(items.columns):
        raise ValueError(f"items: missing columns {sorted(missing)}")
    if some := item_faults(items).limit(5).collect():
        raise ValueError(f"items: {[tuple(r) for r in some]}")


def status_faults(items: DataFrame, bridge: DataFrame) -> DataFrame:
    """Items whose status and membership disagree, or with over 255 genres."""
    n = bridge.groupBy("item_id").agg(F.count("*").alias("n"))
    have = items.join(n, "item_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return have.where(((F.col("genre_status") == "listed") != (F.col("n") > 0)) | (F.col("n") > 255)).select("item_id", "genre_status", "n")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal schemas and equal bags of rows, which are counted once, those of ``b`` downwards."""
    if a.dtypes != b.dtypes:
        return False
    names = [f"c{k}" for k in range(len(a.columns))]
    rows = a.toDF(*names).withColumn("__n", F.lit(1)).union(b.toDF(*names).withColumn("__n", F.lit(-1)))
    return rows.groupBy(*names).agg(F.sum("__n").alias("__n")).where("__n <> 0").isEmpty()
