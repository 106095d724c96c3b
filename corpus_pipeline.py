"""A training corpus in five stages, each written as Parquet and read again: quality, language, near-duplicates,
benchmark passages, packing.

A stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of documents.

Defined results of all stages: rows are told apart as rows, so NULL and repeated ids do no harm; a NULL text is an empty one;
columns beside doc_id and text pass through whatever their names are; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import decontaminate, langid, packing, quality, simhash
from chronofold.llm.common import crc_mod, delete, recorded, small_enough, store, table, unused
from chronofold.llm.tokens import vocabulary_path

#: Languages surer than this stay.
LANGUAGE_SCORE = 0.5
#: Ids that are broadcast, at most.
BROADCAST = 1_000_000


def _without(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``docs`` without the rows whose ``column`` is among ``ids``, of which each is there once."""
    key = unused(docs, "__gone")
    gone = ids.toDF(key)
    gone = F.broadcast(gone) if small_enough(gone, BROADCAST) else gone
    return docs.join(gone, F.col(column) == F.col(key), "left_anti")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below the threshold."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(crc_mod("doc_id", quality.FOLDS) != 0))
    return quality.select(docs, model)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language that the text shows."""
    model = langid.fit(docs.where(crc_mod("doc_id", langid.FOLDS) != 2))
    return langid.select(docs, model, LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts whose five-word shingles are similar by 0.8 or more, as ``simhash.similar`` has it: that of the smallest doc_id.

    NULL ids come last. Where ids repeat or are NULL they can't tell rows apart, and rows are numbered first.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        found = store(simhash.similar(docs.select(F.col("doc_id").alias("row"), "text")).where("row <> group").select("row"), "near")
        return _without(docs, found, "doc_id")
    row, rank = unused(docs, "__row"), unused(docs, "__rank")
    rows = store(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    # numbered by doc_id, NULL last, so that the smallest number is that of the smallest id
    order = rows.select(row, "doc_id").orderBy(F.col("doc_id").asc_nulls_last(), row)
    order = store(order.select(row, F.monotonically_increasing_id().alias(rank)), "order")
    ranked = store(rows.join(order, row), "ranked")
    found = store(simhash.similar(ranked.select(F.col(rank).alias("row"), "text")).where("row <> group").select("row"), "near")
    return _without(ranked, found, rank).drop(row, rank)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark; other rows of their ids stay."""
    return decontaminate.select(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(packing.pieces(docs, vocabulary_path("word_bpe_49k.json")))


STAGES = [
    ("quality_filter", quality_filter),
    ("language_filter", language_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pack", pack),
]

#: The stages' models and hashes can't be written in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage stored on its way, and its input, is deleted once its output is written; the
    last output, which the result reads, stays until ``common.clean``."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with recorded() as written:
            docs = store(stage(spark, docs, sf_dir), name)
        *inner, own = written
        delete(spark, [*inner, *read])
        read = [own]
    return docs
