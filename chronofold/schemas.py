"""Declared schemas, domains and the output contract; nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass

MAX_ID = 2**32 - 1
#: Ratings: half stars.
RATINGS = tuple(k / 2 for k in range(1, 11))


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    nullable: bool = False
    low: float | None = None
    high: float | None = None
    values: tuple = ()


def _id(name: str, nullable: bool = False, high: int = MAX_ID) -> Column:
    return Column(name, "long" if high == MAX_ID else "int", nullable, 1, high)


@dataclass(frozen=True)
class Dataset:
    name: str
    columns: tuple[Column, ...]
    key: tuple[str, ...] = ()

    def check_columns(self, names: list[str]) -> None:
        want = {c.name for c in self.columns}
        if missing := want - set(names):
            raise ValueError(f"{self.name}: missing columns {sorted(missing)}")
        if extra := set(names) - want:
            raise ValueError(f"{self.name}: unexpected columns {sorted(extra)}")


DATASETS = {
    d.name: d
    for d in (
        Dataset("ratings", (_id("userId"), _id("movieId"), Column("rating", "float", values=RATINGS), Column("timestamp", "timestamp_ntz"))),
        Dataset("movies", (_id("movieId"), Column("title", "string"), Column("genres", "string")), ("movieId",)),
        Dataset("tags", (_id("userId"), _id("movieId"), Column("tag", "string"), Column("timestamp", "timestamp_ntz"))),
        Dataset("genome_scores", (_id("movieId"), _id("tagId", high=65_535), Column("relevance", "float", low=0, high=1)), ("movieId", "tagId")),
        Dataset("genome_tags", (_id("tagId", high=65_535), Column("tag", "string")), ("tagId",)),
        Dataset("links", (_id("movieId"), _id("imdbId"), _id("tmdbId", nullable=True)), ("movieId",)),
    )
}

CONTEXT = ("event_id", "user_id", "item_id", "event_us")


@dataclass(frozen=True)
class Feature:
    name: str
    kind: str
    nullable: bool
    role: str
    since: int  # the smallest contract that has it: 17, 25 or 30


def _features() -> tuple[Feature, ...]:
    history, static, context, vector = "strict_prior_historical", "static_catalog", "event_context_from_static_catalog", "static_external_metadata"
    rows = [
        ("global_count", "long", False, history, 17), ("global_mean", "float", False, history, 17), ("user_count", "long", False, history, 17),
        ("user_mean", "float", False, history, 17), ("user_std", "float", False, history, 17), ("user_recency_s", "double", True, history, 17),
        ("item_count", "long", False, history, 17), ("item_mean", "float", False, history, 17), ("item_std", "float", False, history, 17),
        ("item_count_30d", "long", False, history, 17), ("user_genre_count", "long", False, history, 17), ("user_genre_mean", "float", False, history, 17),
        ("user_genre_delta", "float", False, history, 17), ("item_genres", "short", False, static, 17), ("item_year", "short", True, static, 17),
        ("item_year_missing", "boolean", False, static, 17), ("item_age_years", "float", True, context, 17),
        ("item_count_60d", "long", False, history, 30), ("item_mean_30d", "float", True, history, 30), ("item_mean_60d", "float", True, history, 30),
        ("item_mean_ratio", "float", True, history, 30), ("item_count_ratio", "float", True, history, 30),
        ("liked_cosine", "float", True, history, 25), ("disliked_cosine", "float", True, history, 25), ("preference_margin", "float", True, history, 25),
        ("nearest_liked", "float", True, history, 25), ("top5_liked", "float", True, history, 25),
        ("vector_mean", "float", True, vector, 25), ("vector_std", "float", True, vector, 25), ("vector_top10", "float", True, vector, 25),
    ]
    return tuple(Feature(*r) for r in rows)


FEATURES = _features()


def contract(version: int) -> tuple[Feature, ...]:
    """The features of contract 17, 25 or 30, in order."""
    if version not in (17, 25, 30):
        raise ValueError(f"no contract {version}")
    return tuple(f for f in FEATURES if f.since <= version)


def check_contract(columns: list[tuple[str, str]], version: int) -> None:
    """(name, simple type) of a table against context and contract: names, order and types."""
    kinds = {"long": "bigint", "short": "smallint"}
    want = [(c, "bigint") for c in CONTEXT] + [(f.name, kinds.get(f.kind, f.kind)) for f in contract(version)]
    if list(columns) != want:
        wrong = [(a, b) for a, b in zip(columns, want, strict=False) if a != b][:3]
        raise ValueError(f"contract {version}: {len(columns)} columns of {len(want)}; first differences {wrong}")
