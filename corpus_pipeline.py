"""The corpus pipeline: quality, near copies, benchmark leaks, mixture, token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's docs.  All stages but the last return the
columns they were given, whatever their names.

Defined results: null and empty texts have the quality score of a text without words, are
no near copies of anything, hold no benchmark item, are taken floor(q) times by the mixture of their
source, and give an end token alone.  Rows without a doc_id stay in every filter.  Rows
that repeat each other, doc_id and all, are one document: they stay or go together, and the mixture draws
them together.  Of a group of near copies the least doc_id stays.  An empty table gives
empty results and no shards; without labels every document stays; without a benchmark none leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import common, decontamination, jaccard_join, mixing, quality, token_shards


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_shards.shards_in_scratch(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: The quality scores, the seeded draw and the tokens are not SQL; the tests hold run() against the stages' brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
