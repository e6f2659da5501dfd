"""The corpus pipeline: documents through five of the operators, each stage stored.

Toxic and low-quality documents go, one document of each group of near duplicates stays
(word five-grams, Jaccard similarity of 0.8 or more), documents that hold a benchmark
item go, and what is left is encoded. A stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseledger.llm import bpe, decontamination, ngram_join, quality, toxicity
from caseledger.storage import stored


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, _labels(spark, sf_dir))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_only(docs, _labels(spark, sf_dir))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers have run the other stages by then, so the table of words is a small one
    return bpe.round_trip(docs, with_ids=True, kept=100_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The classifiers and the codec are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
