"""Queries of classification metrics over scores made of line items: y is whether a line came back, p ten times its discount,
kept inside (0.01, 0.99)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions.scalars import quarter_label
from ..operators import evaluate as ev
from ..operators import explore as ex
from ..views import with_views
from . import query, rounded
from .history import _BASE

_S = """s AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, least(greatest(l_discount * 10, 0.01), 0.99) AS p,
    least(greatest(l_tax * 12, 0.01), 0.99) AS q, (l_discount * 10 + l_tax) AS m,
    year(l_shipdate) || 'Q' || quarter(l_shipdate) AS quarter, CASE WHEN l_quantity <= 9 THEN 'a' WHEN l_quantity <= 25 THEN 'b' ELSE 'c' END AS cohort
  FROM lineitem)"""


def _scores(spark, sf, column="l_discount", factor=10):
    score = F.least(F.greatest(F.col(column) * factor, F.lit(0.01)), F.lit(0.99))
    cohort = F.when(F.col("l_quantity") <= 9, "a").when(F.col("l_quantity") <= 25, "b").otherwise("c")
    return views.table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"), score.alias("p"), (F.col("l_discount") * 10 + F.col("l_tax")).alias("m"),
        quarter_label("l_shipdate").alias("quarter"), cohort.alias("cohort"),
    )


def _metrics(by: str = "", score: str = "p") -> str:
    """Common table expressions that end in ``mt``: the metrics by the columns ``by``."""
    part = f"PARTITION BY {by}" if by else ""
    first, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""
g{score} AS (SELECT {first}{score} AS p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) - sum(y) AS DOUBLE) AS neg FROM s GROUP BY {first}{score}),
c{score} AS (SELECT *, sum(pos) OVER ({part}) AS tp, sum(neg) OVER ({part}) AS tn,
  coalesce(sum(pos) OVER ({part} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb,
  coalesce(sum(neg) OVER ({part} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g{score}),
mt{score} AS (SELECT {first}CAST(max(tp + tn) AS BIGINT) AS n, max(tp) / max(tp + tn) AS prevalence, sum(p * (pos + neg)) / max(tp + tn) AS mean_score,
  sum(pos * (nb + neg / 2)) / nullif(max(tp * tn), 0) AS roc_auc, coalesce(sum(pos * (tp - pb) / (tp - pb + tn - nb)) / nullif(max(tp), 0), 0) AS average_precision,
  sum(-pos * ln(p) - neg * ln(1 - p)) / max(tp + tn) AS log_loss, sum(pos * (p - 1) * (p - 1) + neg * p * p) / max(tp + tn) AS brier FROM c{score} {group})"""


_ROUND = "n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("prevalence", "mean_score", "roc_auc", "average_precision", "log_loss", "brier"))


@query(f"WITH {_S}, {_metrics()} SELECT round(roc_auc, 6) AS roc_auc FROM mtp")
def roc_auc(spark, sf):
    return rounded(ev.metrics(_scores(spark, sf)).select("roc_auc"))


@query(f"WITH {_S}, {_metrics()} SELECT round(average_precision, 6) AS average_precision FROM mtp")
def average_precision(spark, sf):
    return rounded(ev.metrics(_scores(spark, sf)).select("average_precision"))


@query(f"WITH {_S}, {_metrics()} SELECT n, round(prevalence, 6) AS prevalence, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier FROM mtp")
def logloss_brier(spark, sf):
    return rounded(ev.metrics(_scores(spark, sf)).select("n", "prevalence", "log_loss", "brier"))


@query(f"WITH {_S}, {_metrics('quarter')} SELECT quarter, {_ROUND} FROM mtp")
def metrics_by_quarter(spark, sf):
    return rounded(ev.metrics(_scores(spark, sf), ["quarter"]))


@query(f"WITH {_S}, {_metrics('cohort')} SELECT cohort, {_ROUND} FROM mtp")
def metrics_by_cohort(spark, sf):
    return rounded(ev.metrics(_scores(spark, sf), ["cohort"]))


@query("""
WITH s AS (SELECT quality AS y, least(greatest(n_chars / CAST(4000 AS DOUBLE), 0.01), 0.99) AS p, source FROM labels JOIN documents USING (doc_id)), """ + _metrics("source") + f" SELECT source, {_ROUND} FROM mtp")  # fmt: skip
def label_metrics_by_source(spark, sf):
    """Length as a score of quality; a source with one class has no area."""
    d = views.table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    s = views.table(spark, sf, "labels").join(d, "doc_id")
    s = s.select(F.col("quality").alias("y"), F.least(F.greatest(F.col("n_chars") / F.lit(4000.0), F.lit(0.01)), F.lit(0.99)).alias("p"), "source")
    return rounded(ev.metrics(s, ["source"]))


@query(f"""
WITH {_S}, {_metrics()} SELECT round(p, 6) AS threshold, round((tp - pb) / tp, 6) AS tpr, round((tn - nb) / tn, 6) AS fpr, round((tp - pb) / (tp - pb + tn - nb), 6) AS precision, round((tp - pb) / tp, 6) AS recall FROM cp""")  # fmt: skip
def roc_pr_curves(spark, sf):
    return rounded(ev.curves(_scores(spark, sf)))


_CAL = "count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS observed, round(abs(avg(p) - avg(y)), 6) AS gap FROM s GROUP BY 1"


@query(f"WITH {_S} SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, {_CAL}")
def calibration_left_closed(spark, sf):
    return rounded(ev.calibration(_scores(spark, sf)))


@query(f"WITH {_S} SELECT CAST(greatest(ceil(p * 10), 1) - 1 AS BIGINT) AS bin, {_CAL}")
def calibration_right_closed(spark, sf):
    return rounded(ev.calibration(_scores(spark, sf), ev.bin_right(F.col("p"))))


@query(f"WITH {_S}, c AS (SELECT cohort, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM s GROUP BY ALL) SELECT cohort, round(sum(n * gap) / sum(n), 6) AS ece FROM c GROUP BY cohort")
def calibration_ece(spark, sf):
    return rounded(ev.expected_calibration_error(_scores(spark, sf), ["cohort"]))


def _edges(column: str, parts: int) -> str:
    qs = ", ".join(f"{k}e0/{parts}" for k in range(parts + 1))
    return f"eg AS (SELECT list_sort(list_distinct(quantile_cont({column}, [{qs}]))) AS e FROM s)"


_BUCKET = "greatest(len(list_filter(e, lambda v: v < p)), 1)"


@query(f"""
WITH {_S}, {_edges('p', 20)} SELECT {_BUCKET} AS bucket, count(*) AS n, round(min(p), 6) AS lowest, round(avg(p), 6) AS mean_score, round(max(p), 6) AS highest, round(avg(y), 6) AS rate FROM s, eg GROUP BY 1""")  # fmt: skip
def score_ventiles(spark, sf):
    return rounded(ev.quantile_buckets(_scores(spark, sf)))


@query(f"""
WITH {_S}, {_edges('p', 20)}, b AS (SELECT {_BUCKET} AS bucket, max(p) AS cutoff FROM s, eg GROUP BY 1),
t AS (SELECT bucket, cutoff, count(*) FILTER (p >= cutoff) AS alerts, CAST(coalesce(sum(y) FILTER (p >= cutoff), 0) AS BIGINT) AS tp, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n FROM b, s GROUP BY ALL),
r AS (SELECT *, tp / nullif(CAST(alerts AS DOUBLE), 0) AS pr, tp / nullif(CAST(pos AS DOUBLE), 0) AS re FROM t)
SELECT bucket, round(cutoff, 6) AS cutoff, alerts, tp, alerts - tp AS fp, pos - tp AS fn, round(pr, 6) AS precision, round(re, 6) AS recall,
  round(2 * pr * re / nullif(pr + re, 0), 6) AS f1, round(alerts / CAST(n AS DOUBLE), 6) AS alert_rate FROM r""")  # fmt: skip
def threshold_performance(spark, sf):
    return rounded(ev.threshold_performance(_scores(spark, sf)))


@query(f"""
WITH {_S}, {_edges('m', 10)} SELECT least(len(list_filter(e, lambda v: v <= m)), len(e) - 1) AS decile, count(*) AS n, round(avg(m), 6) AS mean_margin, round(avg(y), 6) AS rate FROM s, eg GROUP BY 1""")  # fmt: skip
def margin_deciles(spark, sf):
    s = _scores(spark, sf)
    edges = ev.quantile_edges(s, "m", 10)
    return rounded(s.groupBy(ev.bucket_left(F.col("m"), edges).alias("decile")).agg(F.count("*").alias("n"), F.avg("m").alias("mean_margin"), F.avg(F.col("y").cast("double")).alias("rate")))


@query(f"""
WITH {_S}, {_metrics('quarter')}, {_metrics('quarter', 'q')}
SELECT quarter, round(b.roc_auc - a.roc_auc, 6) AS delta_roc_auc, round(b.average_precision - a.average_precision, 6) AS delta_average_precision,
  round(b.log_loss - a.log_loss, 6) AS delta_log_loss, round(b.brier - a.brier, 6) AS delta_brier,
  round((b.average_precision - a.average_precision) / nullif(a.average_precision, 0), 6) AS relative_average_precision
FROM mtp a JOIN mtq b USING (quarter)""")  # fmt: skip
def metric_deltas(spark, sf):
    a, b = ev.metrics(_scores(spark, sf), ["quarter"]), ev.metrics(_scores(spark, sf, "l_tax", 12), ["quarter"])
    return rounded(ev.deltas(a, b, ["quarter"], list(ev.BETTER)))


@query(f"""
WITH {_S}, {_metrics('quarter')}, {_metrics('quarter', 'q')}
SELECT coalesce(bool_and(b.roc_auc > a.roc_auc AND b.average_precision > a.average_precision AND b.log_loss < a.log_loss AND b.brier < a.brier), false) AS robust
FROM mtp a JOIN mtq b USING (quarter)""")  # fmt: skip
def quarterly_robustness(spark, sf):
    a, b = ev.metrics(_scores(spark, sf), ["quarter"]), ev.metrics(_scores(spark, sf, "l_tax", 12), ["quarter"])
    return ev.robust(ev.deltas(a, b, ["quarter"], list(ev.BETTER)))


@query(f"""
WITH {_S}, {_edges('p', 20)}, b AS (SELECT {_BUCKET} AS bucket, avg(y) AS rate FROM s, eg GROUP BY 1), d AS (SELECT rate - lag(rate) OVER (ORDER BY bucket) AS d FROM b)
SELECT count(*) FILTER (round(d, 9) < 0) AS falls FROM d""")  # fmt: skip
def ventile_rate_falls(spark, sf):
    b = ev.quantile_buckets(_scores(spark, sf)).withColumn("rate", F.round("rate", 9))
    return ex.falls(b, "bucket", "rate")


@query(f"WITH {_S} SELECT CAST(y AS BIGINT) AS y, CAST(least(floor(p * 40 + 1e-9) + 1, 40) AS BIGINT) AS bin, count(*) AS n FROM s GROUP BY 1, 2")
def score_density_by_class(spark, sf):
    return rounded(ex.histogram(_scores(spark, sf).withColumn("p", F.col("p") + F.lit(2.5e-11)), "p", 0.0, 1.0, 40, ["y"]))


@query()
def boosted_trees(spark, sf):
    """Boosted trees that stop on the validation split: metrics by split and quarter, calibration, gains."""
    from ..model.train import fit_and_evaluate_trees

    return rounded(fit_and_evaluate_trees(spark, sf))


@query()
def boosted_trees_missing(spark, sf):
    """Boosted trees that route missing values and stop on the validation split, of 25 features: metrics by split."""
    from ..model import boosting
    from ..model.train import evaluate_splits, labelled
    from ..schemas import contract
    from ..sources.publish import stored

    features, table = contract(25), labelled(spark, sf, 25)
    some = table.where("split IN ('train', 'validation')").withColumn("held", F.col("split") == "validation")
    model = boosting.fit(some, features, "held", trees=10, depth=4, rate=0.3, patience=3)
    # metrics read the scores several times
    return rounded(evaluate_splits(stored(boosting.score(model, table, features, ["split", "y"]), "scored")))


@query()
def shapley_importance(spark, sf):
    """Mean absolute Shapley value of each feature over the whole test split, of the trees of ``boosted_trees``."""
    from ..model.attribution import contributions, importance
    from ..model.train import fit_trees, labelled
    from ..schemas import contract
    from ..sources.publish import scratch

    features, table = contract(17), labelled(spark, sf, 17)
    model = fit_trees(table, features)
    return rounded(importance(contributions(model, table.where("split = 'test'"), features, [], scratch(spark)), features))


@query()
def model_scores(spark, sf):
    """Trains on the past, scores later splits; no other engine gives the same model."""
    from ..model.train import fit_and_evaluate

    return rounded(fit_and_evaluate(spark, sf))


_MARGIN = """-0.5 + CASE WHEN (b.event_us - ul) / CAST(1e6 AS DOUBLE) < 20000000 THEN 0.4 WHEN b.n < 20 THEN -0.3 ELSE 0.2 END
  + CASE WHEN CAST(um AS FLOAT) < 2.75 THEN -0.1 ELSE 0.25 END + CASE WHEN release_year IS NULL OR release_year < 1990 THEN 0.05 ELSE -0.05 END"""


@query(with_views("re yr br", _BASE + f"SELECT b.event_id, round(1 / (1 + exp(-({_MARGIN}))), 9) AS p FROM b LEFT JOIN yr ON b.item_id = yr.item_id"))
def fixed_trees_scores(spark, sf):
    """Scores of three fixed trees over the feature table; missing values go right in the first, left in the last."""
    from ..model.boosting import Boosted, Tree, score
    from ..plans.features import feature_table
    from ..schemas import contract

    features = contract(17)
    at = {f.name: k for k, f in enumerate(features)}
    stump = lambda name, cut, null_left, a, b: Tree([at[name], -1, -1], [cut, 0.0, 0.0], [0] * 3, [null_left, True, True], [1, 1, 2], [2, 1, 2], [0.0, a, b], [0.0] * 3)
    first = Tree([at["user_recency_s"], -1, at["item_count"], -1, -1], [2e7, 0.0, 20.0, 0.0, 0.0], [0] * 5, [False, True, True, True, True], [1, 1, 3, 3, 4], [2, 1, 4, 3, 4], [0.0, 0.4, 0.0, -0.3, 0.2], [0.0] * 5)
    model = Boosted([f.name for f in features], -0.5, [first, stump("user_mean", 2.75, True, -0.1, 0.25), stump("item_year", 1990.0, True, 0.05, -0.05)], [])
    table = feature_table(views.events(spark, sf), views.catalog(spark, sf), version=17)
    return score(model, table, features, ["event_id"]).select("event_id", F.round("p", 9).alias("p"))
