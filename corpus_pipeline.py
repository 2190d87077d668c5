"""A corpus pipeline of five stages, from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each
result as Parquet and reads it again as the next stage's documents.  All but the last stage
return the columns of ``documents``; a stage that changes texts also sets ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import linededup, quality, simhash
from tidemill.llm.common import materialize
from tidemill.llm.queries import mix, token_digests

#: Documents below this probability of being good go.
LEAST_QUALITY = 0.5
#: Words that the mixture keeps, as a share of those that reach it.
MIXTURE_SHARE = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    scored = quality.score(docs, quality.train(docs), score_col=name)
    return scored.where(F.col(name) >= LEAST_QUALITY).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line is similar to."""
    kept = linededup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return simhash.drop_near_duplicates(docs, words=5)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose words have the target shares of source, language and topic."""
    return mix(docs, MIXTURE_SHARE)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of SentencePiece ids, their digest and the check of the round trip for each document."""
    return token_digests(docs)


STAGES = [
    ("quality", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("mixture", mixture_stage),
    ("sentencepiece", token_stage),
]

#: SQL can't express trained models and fingerprints; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
