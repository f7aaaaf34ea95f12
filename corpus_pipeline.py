"""A corpus pipeline of five operators: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import textloom
from textloom.llm import stages
from textloom.session import materialize

cloudpickle.register_pickle_by_value(textloom)

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("jaccard_join", stages.keep_one_of_each_group),
    ("secret_scan", stages.mask_secrets),
    ("mix_sources", stages.mix_sources),
    ("bpe", stages.encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
