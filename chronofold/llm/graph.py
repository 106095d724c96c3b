"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

#: Rounds after which something must be wrong: a round halves the depth, more or less.
ROUNDS = 64


def connected(edges: DataFrame) -> DataFrame:
    """(a long, b long) to (node, root): every node of an edge between two nodes, with the smallest node it reaches.

    Only neighbour minima are gathered, so a node with any number of edges is pre-aggregated before the shuffle and the
    rows that carry it stay splittable. Each round is written to the shared folder; nothing comes to the driver but a
    count and a checksum. Edges may repeat and lie in either direction; loops and NULLs don't count.
    """
    e = store(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct(), "edges")
    for _ in range(ROUNDS):
        if _stars(e):
            break
        ends = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        pair = F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), F.col("v").alias("v"))))
        e = store(large.join(low, "v").select(pair.alias("p")).select("p.u", "p.v").where("u < v").distinct(), "edges")
    else:
        raise RuntimeError(f"no components after {ROUNDS} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether each node is either a centre or hangs on one centre alone; an empty list is such."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("down > 1 OR (up = 1 AND down = 1)").isEmpty()
