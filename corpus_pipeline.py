"""A training-data pipeline: language, near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm import decontaminate, jaccard_join, language_id
from flowscope.llm.queries import bpe_digests, vocabulary
from flowscope.llm.rows import whole_rows
from flowscope.sizing import local_scratch, small_rows, stored

#: rows sent to a Python worker at once; a row is a whole document with all its columns
ROWS_AT_ONCE = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: a text whose likeliest language has a smaller share of the probability is rejected
LEAST_SCORE = 0.5


def small_batches(spark: SparkSession) -> None:
    """Documents are wide, so fewer of them at once, unless the session has still fewer."""
    now = int(spark.conf.get(BATCH_SETTING))
    if not 0 < now <= ROWS_AT_ONCE:
        spark.conf.set(BATCH_SETTING, str(ROWS_AT_ONCE))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that the models know; null texts and texts without letters go."""
    small_batches(spark)
    model = language_id.train(docs, vocabulary("piece_bpe_32k.model"))
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return language_id.predict(whole_rows(docs), model, "row", "row.text").filter(known).select("row.*")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Documents without words stay, and so do rows with a null id. Rows that repeat the id of
    a document that stays, stay with it.
    """
    small_batches(spark)
    groups = jaccard_join.similar_groups(docs).filter(F.col("doc_id").isNotNull())
    others = stored(
        groups.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first"))
        .filter(~F.col("first")).select("doc_id"))
    few = small_rows(others)
    if few is not None:  # at most the bounds of small_rows
        others = F.broadcast(spark.createDataFrame(few, schema=others.schema))
    return docs.join(others, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    small_batches(spark)
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of token ids and of what they decode to."""
    small_batches(spark)
    return bpe_digests(docs)


STAGES = [
    ("language_id", identified),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("bpe_encoding", encoded),
]

#: the models of the first stage cannot be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves is kept for the next one."""
    local_scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
