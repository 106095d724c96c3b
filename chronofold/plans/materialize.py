"""Materialisation of the feature table with provenance, published as a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import check_contract, contract
from ..sources.publish import identity, publish_pair
from .features import feature_table


def materialize(events: DataFrame, catalog: DataFrame, scores: DataFrame | None, path: str, version: int = 30) -> dict:
    """Writes the feature table, partitioned files sorted by time so that filters on event_us prune, and its sidecar.

    The staged table must have the contract's columns and types and exactly the events' ids before it is put in place.
    """
    table = feature_table(events, catalog, scores, version)
    source = events.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.bit_xor(F.xxhash64("event_id")).alias("x")).first()
    if source["n"] != source["ids"]:
        raise ValueError("event ids repeat")
    metadata = {
        "contract": version, "columns": [f.name for f in contract(version)], "rows": source["n"],
        "source": identity(events.select("event_id", "user_id", "item_id", "rating", "event_us")),
        "catalog": identity(catalog.select("item_id", "release_year", F.array_join(F.array_sort("genres"), "|").alias("genres"))),
    }

    def check(staged: DataFrame) -> None:
        check_contract(staged.dtypes, version)
        got = staged.agg(F.count("*"), F.bit_xor(F.xxhash64("event_id"))).first()
        if tuple(got) != (source["n"], source["x"]):
            raise ValueError("the staged table doesn't have the events' ids")
        needed = [f.name for f in contract(version) if not f.nullable]
        bad = staged.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in needed]).first().asDict()
        if any(bad.values()):
            raise ValueError(f"missing values in {[k for k, v in bad.items() if v]}")

    publish_pair(table.repartitionByRange("event_us").sortWithinPartitions("event_us"), path, metadata, check)
    return metadata
