"""Queries of exact sums and stable moments, on prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions.scalars import micros
from ..operators import moments
from . import query


@query("""
WITH x AS (SELECT l_returnflag AS flag, CAST(l_extendedprice * 17592186044416 AS HUGEINT) AS units FROM lineitem)
SELECT flag, count(*) AS n, round(CAST(sum(units) // 17592186044416 AS DOUBLE) + CAST(sum(units) % 17592186044416 AS DOUBLE) / 17592186044416, 2) AS total FROM x GROUP BY flag""")  # fmt: skip
def exact_price_sums(spark, sf):
    """The exact sum of prices by flag, held against sums of whole numbers: a price is a multiple of 2^-44."""
    out = moments.exact_sums(views.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select(F.col("l_returnflag").alias("flag"), "n", F.round("total", 2).alias("total"))


@query("""
WITH x AS (SELECT l_suppkey AS supplier, epoch_us(l_shipdate) AS event_us, l_extendedprice AS price FROM lineitem),
h AS (SELECT supplier, event_us, price, count(*) OVER w AS prior_n, avg(price) OVER w AS m, stddev_pop(price) OVER w AS s FROM x
  WINDOW w AS (PARTITION BY supplier ORDER BY event_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT supplier, event_us, price, prior_n, floor(m * 1000 + 0.318309886) / 1000 AS prior_mean, floor(s * 1000 + 0.318309886) / 1000 AS prior_std FROM h""")  # fmt: skip
def prior_price_moments(spark, sf):
    """Mean and deviation of a supplier's earlier prices; suppliers with over 100 rows are hot."""
    x = views.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), micros("l_shipdate").alias("event_us"), F.col("l_extendedprice").alias("price"))
    out = moments.prior_moments(x, "supplier", "price", 100)
    # cut at thousandths, aside from where means of prices are
    cut = lambda c: (F.floor(F.col(c) * 1000 + 0.318309886).cast("double") / 1000).alias(c)
    return out.select("supplier", "event_us", "price", "prior_n", cut("prior_mean"), cut("prior_std"))
