"""The registered queries of the operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseledger.llm import (
    bpe,
    decontamination,
    filter_audit,
    fingerprints,
    licences,
    ngram_join,
    packing,
    quality,
    simhash,
    suffix_tree,
    toxicity,
    warc,
    whitening,
)

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(plan: Plan) -> Plan:
    QUERIES[plan.__name__] = plan
    return plan


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(_table(spark, folder, "documents"))


SQL["op1_licence_scan"] = licences.scan_sql()


@query
def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@query
def op3_token_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_files(_table(spark, folder, "documents"))


@query
def op4_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.against_edits(_table(spark, folder, "documents"))


@query
def op5_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(_table(spark, folder, "documents"))


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classified(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query
def op7_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages"))


@query
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classified(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query
def op9_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, folder, "documents"))


@query
def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.held_out_scores(_table(spark, folder, "documents"))


@query
def op11_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@query
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(_table(spark, folder, "embeddings"))


@query
def op13_filter_interaction_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


SQL["op13_filter_interaction_audit"] = filter_audit.audit_sql()
