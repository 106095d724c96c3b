"""Evaluation of scores (y 0 or 1, p in [0, 1]) by one pass over distinct scores.

Rows are first grouped by distinct score; running counts over scores go through buckets of the score axis, whose totals are
a small table, so no task sorts all scores of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .explore import quantiles_of

BUCKETS = 1024
EPSILON = 1e-15


def score_groups(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, p, pos, neg, pos_below, neg_below: counts at a score and at all lower ones."""
    by = by or []
    g = df.groupBy(*by, "p").agg(F.sum("y").cast("double").alias("pos"), (F.count("*") - F.sum("y")).cast("double").alias("neg"))
    g = g.withColumn("__b", F.floor(F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)) * BUCKETS))
    totals = g.groupBy(*by, "__b").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    before = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumns({"p0": F.coalesce(F.sum("tp").over(before), F.lit(0.0)), "n0": F.coalesce(F.sum("tn").over(before), F.lit(0.0))})
    inner = W.partitionBy(*by, "__b").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    g = g.withColumns({"p1": F.coalesce(F.sum("pos").over(inner), F.lit(0.0)), "n1": F.coalesce(F.sum("neg").over(inner), F.lit(0.0))})
    j = g.join(totals.drop("tp", "tn"), [*by, "__b"])
    return j.select(*by, "p", "pos", "neg", (F.col("p0") + F.col("p1")).alias("pos_below"), (F.col("n0") + F.col("n1")).alias("neg_below"))


def metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, n, prevalence, mean_score, roc_auc (NULL with one class), average_precision (0 without positives), log_loss, brier."""
    by = by or []
    g = score_groups(df, by)
    totals = g.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    j = g.join(totals, by) if by else g.crossJoin(totals)  # one row
    clipped = F.least(F.greatest("p", F.lit(EPSILON)), F.lit(1 - EPSILON))
    pos_ge, neg_ge = F.col("all_pos") - F.col("pos_below"), F.col("all_neg") - F.col("neg_below")
    n = F.max(F.col("all_pos") + F.col("all_neg"))
    return j.groupBy(*by).agg(
        n.cast("long").alias("n"),
        (F.max("all_pos") / n).alias("prevalence"),
        (F.sum(F.col("p") * (F.col("pos") + F.col("neg"))) / n).alias("mean_score"),
        (F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)) / F.nullif(F.max(F.col("all_pos") * F.col("all_neg")), F.lit(0.0))).alias("roc_auc"),
        F.coalesce(F.sum(F.col("pos") * pos_ge / (pos_ge + neg_ge)) / F.nullif(F.max("all_pos"), F.lit(0.0)), F.lit(0.0)).alias("average_precision"),
        (F.sum(-F.col("pos") * F.ln(clipped) - F.col("neg") * F.ln(1 - clipped)) / n).alias("log_loss"),
        (F.sum(F.col("pos") * (F.col("p") - 1) * (F.col("p") - 1) + F.col("neg") * F.col("p") * F.col("p")) / n).alias("brier"),
    )


def curves(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, threshold, tpr, fpr, precision, recall at each distinct score, alerting at or above it."""
    by = by or []
    g = score_groups(df, by)
    totals = g.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    j = g.join(totals, by) if by else g.crossJoin(totals)
    tp, fp = F.col("all_pos") - F.col("pos_below"), F.col("all_neg") - F.col("neg_below")
    zero = F.lit(0.0)
    return j.select(
        *by, F.col("p").alias("threshold"), (tp / F.nullif("all_pos", zero)).alias("tpr"), (fp / F.nullif("all_neg", zero)).alias("fpr"),
        (tp / F.nullif(tp + fp, zero)).alias("precision"), (tp / F.nullif("all_pos", zero)).alias("recall"),
    )


def bin_left(p: Column, bins: int = 10) -> Column:
    """[k/bins, (k+1)/bins), the last one closed."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def bin_right(p: Column, bins: int = 10) -> Column:
    """(k/bins, (k+1)/bins], the first one closed, numbered from 0."""
    return (F.greatest(F.ceil(p * bins), F.lit(1)) - 1).cast("int")


def calibration(df: DataFrame, bin_: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """by, bin, n, mean_score, observed, gap; bins without rows are left out."""
    b = bin_left(F.col("p")) if bin_ is None else bin_
    g = df.withColumn("bin", b).groupBy(*(by or []), "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("observed"))
    return g.withColumn("gap", F.abs(F.col("mean_score") - F.col("observed")))


def expected_calibration_error(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    c = calibration(df, by=by)
    return c.groupBy(*(by or [])).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def quantile_edges(df: DataFrame, column: str, parts: int) -> list[float]:
    """Linear-interpolated quantiles of ``parts`` equal shares, equal ones once; parts + 1 numbers at most."""
    found = quantiles_of(df, column, tuple(k / parts for k in range(parts + 1))).first()[0]
    return sorted(set(found or []))


def bucket_right(x: Column, edges: list[float]) -> Column:
    """Number from 1 of the bucket (e[k], e[k+1]] that holds x; the lowest edge belongs to the first."""
    return F.greatest(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < x)), F.lit(1))


def bucket_left(x: Column, edges: list[float]) -> Column:
    """Number from 1 of the bucket [e[k], e[k+1]); the highest edge belongs to the last."""
    return F.least(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x)), F.lit(len(edges) - 1))


def quantile_buckets(df: DataFrame, parts: int = 20) -> DataFrame:
    """bucket, n, lowest, mean_score, highest, rate over right-closed quantile buckets of p."""
    edges = quantile_edges(df, "p", parts)
    return df.groupBy(bucket_right(F.col("p"), edges).alias("bucket")).agg(
        F.count("*").alias("n"), F.min("p").alias("lowest"), F.avg("p").alias("mean_score"), F.max("p").alias("highest"), F.avg(F.col("y").cast("double")).alias("rate"),
    )


def threshold_performance(df: DataFrame, parts: int = 20) -> DataFrame:
    """For each bucket's highest score as the cutoff: alerts, tp, fp, fn, precision, recall, f1, alert_rate.

    Buckets are aggregated, and what lies at or above a cutoff is a suffix sum over the few buckets. The rows of
    a bucket that equal its highest score alert; its other rows don't.
    """
    edges = quantile_edges(df, "p", parts)
    b = df.select("p", "y", bucket_right(F.col("p"), edges).alias("bucket"))
    highest = b.groupBy("bucket").agg(F.max("p").alias("highest"))  # a row a bucket
    at = F.col("p") == F.col("highest")
    g = b.join(F.broadcast(highest), "bucket").groupBy("bucket").agg(
        F.max("highest").alias("cutoff"), F.count("*").alias("n"), F.sum("y").alias("pos"), F.count_if(at).alias("n_at"), F.sum(F.when(at, F.col("y"))).alias("pos_at"),
    )
    after, whole = W.orderBy("bucket").rowsBetween(1, W.unboundedFollowing), W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    g = g.withColumns({
        "alerts": F.col("n_at") + F.coalesce(F.sum("n").over(after), F.lit(0)), "tp": F.col("pos_at") + F.coalesce(F.sum("pos").over(after), F.lit(0)),
        "all_pos": F.sum("pos").over(whole), "all_n": F.sum("n").over(whole),
    })
    d = lambda c: F.col(c).cast("double")
    precision, recall = d("tp") / F.nullif(d("alerts"), F.lit(0.0)), d("tp") / F.nullif(d("all_pos"), F.lit(0.0))
    f1 = 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))
    return g.select(
        "bucket", "cutoff", "alerts", "tp", (F.col("alerts") - F.col("tp")).alias("fp"), (F.col("all_pos") - F.col("tp")).alias("fn"),
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), (d("alerts") / d("all_n")).alias("alert_rate"),
    )


def deltas(a: DataFrame, b: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """by, and b - a of each metric, with the relative change of average precision."""
    j = a.alias("a").join(b.alias("b"), by)
    out = [(F.col(f"b.{n}") - F.col(f"a.{n}")).alias(f"delta_{n}") for n in names]
    relative = (F.col("b.average_precision") - F.col("a.average_precision")) / F.nullif(F.col("a.average_precision"), F.lit(0.0))
    return j.select(*by, *out, relative.alias("relative_average_precision"))


#: Whether a rise is better, by metric.
BETTER = {"roc_auc": 1, "average_precision": 1, "log_loss": -1, "brier": -1}


def robust(deltas: DataFrame) -> DataFrame:
    """One row: whether every period improves in every metric."""
    return deltas.agg(F.coalesce(F.bool_and(F.expr(" AND ".join(f"delta_{n} * {s} > 0" for n, s in BETTER.items()))), F.lit(False)).alias("robust"))
