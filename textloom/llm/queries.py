"""One query for each operator, over whole tables, and the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import (
    op1_license_scan,
    op2_mix_sources,
    op3_ann,
    op4_secret_scan,
    op5_toxicity,
    op6_pivot_dedup,
    op7_jaccard_join,
    op8_chat_format,
    op9_bpe,
    op10_hmm_score,
    op11_sharded_lloyd,
    op12_merkle_manifest,
    op13_html_extract,
)
from textloom.llm.common import table
from textloom.llm.stages import vocabulary_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_license_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_license_scan.scan(table(spark, sf_dir, "documents"))


def op2_mix_sources_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_mix_sources.report(table(spark, sf_dir, "documents"))


def op3_ann_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return op3_ann.search(vectors, F.col("vec_id") % 20 == 0)


def op6_pivot_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_pivot_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_secret_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return op5_toxicity.toxicity(docs, labels)


def op7_jaccard_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_chat_format_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_chat_format.digests(spark, table(spark, sf_dir, "conversations"))


def op10_hmm_score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_hmm_score.score(table(spark, sf_dir, "documents"))


def op11_sharded_lloyd_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_sharded_lloyd.digests(table(spark, sf_dir, "embeddings"))


def op13_html_extract_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_html_extract.extract(table(spark, sf_dir, "pages"))


def op12_merkle_manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_merkle_manifest.lowered(table(spark, sf_dir, "documents"))


QUERIES["op1_license_scan"] = op1_license_scan_query
ORACLES["op1_license_scan"] = op1_license_scan.sql()
QUERIES["op2_mix_sources"] = op2_mix_sources_query
ORACLES["op2_mix_sources"] = op2_mix_sources.SQL
QUERIES["op3_ann"] = op3_ann_query
QUERIES["op6_pivot_dedup"] = op6_pivot_dedup_query
QUERIES["op4_secret_scan"] = op4_secret_scan_query
QUERIES["op8_chat_format"] = op8_chat_format_query
ORACLES["op8_chat_format"] = op8_chat_format.SQL
QUERIES["op10_hmm_score"] = op10_hmm_score_query
QUERIES["op5_toxicity"] = op5_toxicity_query
QUERIES["op7_jaccard_join"] = op7_jaccard_join_query
QUERIES["op9_bpe"] = op9_bpe_query
QUERIES["op11_sharded_lloyd"] = op11_sharded_lloyd_query
ORACLES["op11_sharded_lloyd"] = op11_sharded_lloyd.sql()
QUERIES["op12_merkle_manifest"] = op12_merkle_manifest_query
ORACLES["op12_merkle_manifest"] = op12_merkle_manifest.sql()
QUERIES["op13_html_extract"] = op13_html_extract_query
