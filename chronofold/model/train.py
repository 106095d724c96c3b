"""A gradient-boosted classifier of the target from the feature table, evaluated out of time.

Missing values are -1 with a flag, as trees of Spark's learner take no NaN.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import buckets, evaluate
from ..operators.predicates import allow_columns, check_splits, split_label
from ..schemas import Feature, contract


#: Columns that show the target and are never inputs.
TARGETS = {"rating", "y"}


def matrix(df: DataFrame, features: tuple[Feature, ...]) -> tuple[DataFrame, list[str]]:
    """Adds the columns of the feature vector in the contract's order, and gives their names.

    A feature that shows the target or isn't there raises ValueError.
    """
    allow_columns(df, [f.name for f in features], TARGETS)
    new, names = {}, []
    for f in features:
        x = F.col(f.name).cast("int").cast("double") if f.kind == "boolean" else F.col(f.name).cast("double")
        new[f"x_{f.name}"] = F.coalesce(F.when(~F.isnan(x), x), F.lit(-1.0)) if f.nullable else x
        names.append(f"x_{f.name}")
        if f.nullable:
            new[f"m_{f.name}"] = F.col(f.name).isNull().cast("double")
            names.append(f"m_{f.name}")
    return df.withColumns(new), names


def fit(train: DataFrame, features: tuple[Feature, ...], kind: str = "gbt", seed: int = 7, trees: int = 20, depth: int = 4, stop: str | None = None):
    """``train`` has the features and ``y``. ``stop`` names a boolean column of rows held out: trees end when they gain nothing
    on these."""
    df, names = matrix(train, features)
    kept = ["y", *names, *([stop] if stop and kind == "gbt" else [])]
    if kind == "gbt":
        learner = GBTClassifier(labelCol="y", featuresCol="features", maxIter=trees, maxDepth=depth, seed=seed)
        if stop:
            learner = learner.setValidationIndicatorCol(stop)
    elif kind == "logistic":
        learner = LogisticRegression(labelCol="y", featuresCol="features", regParam=1e-4, maxIter=50)
    else:
        raise ValueError(f"no learner {kind}")
    # learners hold a task's rows unpacked, many times what they have in a file
    with buckets.small_reads(train.sparkSession, train.count()):
        return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), learner]).fit(df.select(*kept))


def score(model, df: DataFrame, features: tuple[Feature, ...], keep: list[str]) -> DataFrame:
    """``keep`` and p, the probability of the target."""
    x, names = matrix(df, features)
    return model.transform(x.select(*keep, *names)).select(*keep, vector_to_array("probability")[1].alias("p"))


def gains(model, features: tuple[Feature, ...]) -> list[tuple[str, float]]:
    """Importance by feature of a tree model, largest first; ties by name."""
    names = model.stages[0].getInputCols()
    return sorted(zip(names, model.stages[1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def evaluate_splits(scored: DataFrame) -> DataFrame:
    """Metrics by split."""
    return evaluate.metrics(scored, ["split"])


def evaluate_model(scored: DataFrame, model=None, features: tuple[Feature, ...] = ()) -> DataFrame:
    """(part, name, n, roc_auc, average_precision, log_loss, brier, value): a model's whole evaluation in one table.

    ``scored`` has split, event_us, y and p. Parts: ``split``; ``quarter`` of the test split; ``calibration``, its bins, with
    the gap as value; ``ece`` by split; ``gain`` by feature, of tree models.
    """
    from ..functions.scalars import quarter_label

    names = ["n", "roc_auc", "average_precision", "log_loss", "brier"]
    empty = [F.lit(None).cast("double").alias(c) for c in names[1:]]
    none = F.lit(None).cast("double").alias("value")
    test = scored.where("split = 'test'").withColumn("quarter", quarter_label(F.timestamp_micros("event_us")))
    out = evaluate.metrics(scored, ["split"]).select(F.lit("split").alias("part"), F.col("split").alias("name"), *names, none)
    out = out.unionByName(evaluate.metrics(test, ["quarter"]).select(F.lit("quarter").alias("part"), F.col("quarter").alias("name"), *names, none))
    out = out.unionByName(evaluate.calibration(test).select(F.lit("calibration").alias("part"), F.col("bin").cast("string").alias("name"), "n", *empty, F.col("gap").alias("value")))
    n = F.lit(None).cast("long").alias("n")
    out = out.unionByName(evaluate.expected_calibration_error(scored, ["split"]).select(F.lit("ece").alias("part"), F.col("split").alias("name"), n, *empty, F.col("ece").alias("value")))
    if model is not None and hasattr(model.stages[1], "featureImportances"):
        rows = scored.sparkSession.createDataFrame(gains(model, features), "name string, value double")
        out = out.unionByName(rows.select(F.lit("gain").alias("part"), "name", n, *empty, "value"))
    return out


def labelled(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """The feature table with ``y`` and ``split``, made once and stored, as fitting and scoring read it many times."""
    from .. import views
    from ..catalogue.entities import SPLITS
    from ..plans.features import feature_table
    from ..sources.publish import kept

    check_splits(SPLITS)
    scores = views.scores(spark, sf_dir) if version > 17 else None
    y = (F.col("rating") >= 4.0).cast("int").alias("y")
    table = feature_table(views.events(spark, sf_dir), views.catalog(spark, sf_dir), scores, version, y)
    return kept(table.withColumn("split", split_label(F.col("event_us"), SPLITS)), "labelled", maxRecordsPerFile=buckets.TASK)


def fit_trees(table: DataFrame, features: tuple[Feature, ...], trees: int = 5, depth: int = 3):
    """Boosted trees of the training split that stop on the validation split."""
    some = table.where("split IN ('train', 'validation')").withColumn("held", F.col("split") == "validation")
    return fit(some, features, "gbt", trees=trees, depth=depth, stop="held")


def fit_and_evaluate_trees(spark: SparkSession, sf_dir: str, version: int = 17, trees: int = 5, depth: int = 3) -> DataFrame:
    """Boosted trees that stop on the validation split, and their whole evaluation."""
    features, table = contract(version), labelled(spark, sf_dir, version)
    model = fit_trees(table, features, trees, depth)
    return evaluate_model(score(model, table, features, ["split", "event_us", "y"]), model, features)


def fit_and_evaluate(spark: SparkSession, sf_dir: str, version: int = 17, kind: str = "logistic") -> DataFrame:
    table, features = labelled(spark, sf_dir, version), contract(version)
    model = fit(table.where("split = 'train'"), features, kind)
    return evaluate_splits(score(model, table, features, ["split", "y"]))
