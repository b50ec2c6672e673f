"""A training-data pipeline over ``documents``: five stages, each one operator of ``chainlake.llm``.

Each stage is written as Parquet and read again before the next. All but the last return the
columns of ``documents``; the last returns the tokens of what remains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm import decontaminate, langid, line_dedup, piece_bpe, queries, simhash
from chainlake.session import new_path

#: The stages hold trained models and graph steps, which SQL cannot say; tests check them by brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return langid.drop_rejected(docs, langid.learn(docs, F.lit(True)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; every document stays."""
    return line_dedup.dedup(docs, F.col("source"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark passages go; every document stays."""
    return decontaminate.remove_spans(docs, queries.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and of the decoded text."""
    return queries.token_digest(piece_bpe.encode(docs, queries.model_path()))


STAGES = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
