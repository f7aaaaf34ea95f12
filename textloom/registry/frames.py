"""Frames that queries derive from the shipped tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.messages import collect_messages
from textloom.functions.text import has_min_chars
from textloom.functions.vocabulary import BpeModel
from textloom.operators.encode import encode_documents
from textloom.operators.packing import block_offsets
from textloom.sources.corpus import spread

FRACTION = 0.05
BLOCK = 512
DOMAINS = {
    "english": tuple(f"src{i}" for i in range(10)),
    "code": tuple(f"src{i}" for i in range(10, 15)),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def spread_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents over all cores, for work that is heavy per row."""
    return spread(documents(spark, sf))


def usable_documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).filter(has_min_chars("text"))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """``conv_id, messages``."""
    turns = table(spark, sf, "conversations")
    return turns.groupBy("conv_id").agg(
        collect_messages(F.col("turn"), F.col("role"), F.col("text")).alias("messages")
    )


def _assistants(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] == "assistant")


def explicit_pairs(talks: DataFrame) -> DataFrame:
    """Turns up to the first assistant turn, against the same turns with the second answer."""
    m = F.col("messages")
    first = F.array_position(F.transform(m, lambda x: x["role"]), F.lit("assistant")).cast("int")
    rows = talks.filter(F.size(_assistants(m)) >= 2)
    return rows.select(
        "conv_id",
        F.slice(m, F.lit(1), first).alias("chosen"),
        F.concat(
            F.slice(m, F.lit(1), F.greatest(first - 1, F.lit(0))), F.array(F.try_element_at(_assistants(m), F.lit(2)))
        ).alias("rejected"),
    )


def scored_pairs(talks: DataFrame) -> DataFrame:
    """Two responses with a strength; the prompt is shared by many rows."""
    answers = _assistants(F.col("messages"))
    asked = F.filter(F.col("messages"), lambda m: m["role"] == "user")
    prompts = talks.filter(F.size(asked) > 0).select(
        F.col("conv_id").alias("prompt_id"), F.try_element_at(asked, F.lit(1))["content"].alias("prompt")
    )
    both = talks.filter(F.size(answers) >= 2).select(
        "conv_id",
        F.floor(F.col("conv_id") / 2).alias("prompt_id"),
        F.try_element_at(answers, F.lit(1))["content"].alias("response_1"),
        F.try_element_at(answers, F.lit(2))["content"].alias("response_2"),
    )
    return both.join(prompts, "prompt_id").select(
        "conv_id",
        "prompt",
        "response_1",
        "response_2",
        (F.col("conv_id") % 7 - 3).cast("int").alias("preference_strength"),
        F.when(F.col("conv_id") % 10 == 0, "validation").otherwise("train").alias("split"),
    )


def shard_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """``source, n_tokens``: a byte is a token, and every document has a begin and an end."""
    return documents(spark, sf).groupBy("source").agg(
        F.sum(F.octet_length("text") + 2).cast("bigint").alias("n_tokens")
    )


def offsets(spark: SparkSession, sf: str) -> DataFrame:
    return block_offsets(shard_sizes(spark, sf), "source", F.col("n_tokens"), BLOCK)


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """``source, block, block_index`` for every block of every shard."""
    return offsets(spark, sf).select(
        "source",
        F.posexplode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("block", "block_index"),
    )


def byte_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Usable documents encoded without any merge."""
    return encode_documents(spread(usable_documents(spark, sf)), "text", BpeModel())


def source_number() -> Column:
    return F.substring("source", 4, 10).cast("int")


def joined(messages: Column) -> Column:
    """A conversation as one string, for comparison."""
    return F.array_join(
        F.transform(messages, lambda m: F.concat_ws(":", m["role"], m["content"])), "|"
    )


