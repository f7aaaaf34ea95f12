"""Conversations and preferences to the four post-training collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.messages import MESSAGES_TYPE
from textloom.operators.manifest import collection_counts
from textloom.operators.preference import (
    SYSTEM_PROMPT,
    explicit_pairs,
    normalize_scored,
    scored_filter,
    unique_prompts,
    valid_conversations,
)
from textloom.operators.split import exact_split, source_split
from textloom.session import materialize
from textloom.sources.corpus import (
    file_listing,
    names_validation,
    read_files,
    require_stored,
    split_by_filename,
)
from textloom.sources.preference import preference_file, preference_scan, require_fields
from textloom.sources.sinks import publish_collections, published


def sft_collection(
    conversations: DataFrame, key: str, seed: int = 42, validation_rows: int = 2_000
) -> DataFrame:
    """Split first, then validate: the validation size counts all rows."""
    split = (
        conversations
        if "split" in conversations.columns
        else exact_split(conversations, key, seed, validation_rows, 100)
    )
    return valid_conversations(split)


def dpo_collection(
    pairs: DataFrame,
    key: str,
    seed: int = 42,
    validation_rows: int = 2_000,
    on_no_prompt: str = "fail",
) -> DataFrame:
    """Explicit pairs, split after filtering."""
    return exact_split(explicit_pairs(pairs, on_no_prompt), key, seed, validation_rows, 100)


def reward_collection(
    scored: DataFrame, key: str, seed: int = 42, validation_rows: int = 2_000
) -> DataFrame:
    """Scored pairs in explicit form, split by their source or at random."""
    rows = normalize_scored(scored_filter(scored), keep=[key])
    return source_split(rows, key, seed, validation_rows, 10).drop("source_split")


def rlhf_collection(reward: DataFrame, key: str, across_splits: bool = False) -> DataFrame:
    """The distinct prompts of either split."""
    return unique_prompts(reward, key, across_splits)


def collections(
    conversations: DataFrame,
    pairs: DataFrame,
    scored: DataFrame,
    key: str,
    seed: int = 42,
    validation_rows: int = 2_000,
    on_no_prompt: str = "fail",
) -> dict[str, DataFrame]:
    """All four collections by name."""
    reward = reward_collection(scored, key, seed, validation_rows)
    return {
        "sft": sft_collection(conversations, key, seed, validation_rows),
        "dpo": dpo_collection(pairs, key, seed, validation_rows, on_no_prompt),
        "reward": reward,
        "rlhf": rlhf_collection(reward, key),
    }


KEY = "row_key"


def _keyed(rows: DataFrame) -> DataFrame:
    """File and position as one key, in place of the two."""
    key = F.concat_ws(":", "shard", F.lpad(F.col("row_index").cast("string"), 19, "0"))
    return rows.withColumn(KEY, key).drop("shard", "row_index")


def load_conversations(spark: SparkSession, root: str) -> DataFrame:
    """Conversation files routed by their names; without validation files there is no ``split``
    column yet, and the exact split makes it."""
    require_stored(spark, root, ["messages"])
    rows = read_files(spark, [root], {"messages": MESSAGES_TYPE})
    listing = file_listing(spark, root)
    if listing.filter(names_validation(F.col("path"))).limit(1).collect():
        return _keyed(split_by_filename(rows, "shard", listing=listing.drop("path")))
    routed = split_by_filename(rows, "shard", listing=listing.drop("path"))
    return _keyed(routed.drop("split"))


def load_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Files with a chosen and a rejected conversation."""
    require_stored(spark, root, ["chosen", "rejected"])
    return _keyed(
        read_files(spark, [root], {"chosen": MESSAGES_TYPE, "rejected": MESSAGES_TYPE})
    )


def load_scored(spark: SparkSession, root: str) -> DataFrame:
    """Scored JSON lines; the content is the key, with a number for equal rows."""
    path = preference_file(spark, root)
    require_fields(spark, path, ["prompt", "preference_strength"])
    rows = preference_scan(spark, path)
    content = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    return rows.withColumn(KEY, F.concat_ws(":", content, F.monotonically_increasing_id()))


def prepare_posttrain(
    spark: SparkSession,
    conversations: str,
    pairs: str,
    scored: str,
    output: str,
    seed: int = 42,
    validation_rows: int = 2_000,
    on_no_prompt: str = "fail",
) -> DataFrame:
    """Read the three inputs, normalize them, publish one data set; returns its row counts.

    The manifest of the version keeps seed, requested validation rows, system prompt and counts.
    """
    made = collections(
        load_conversations(spark, conversations),
        load_pairs(spark, pairs),
        materialize(load_scored(spark, scored), "scored"),
        KEY,
        seed,
        validation_rows,
        on_no_prompt,
    )
    details = published_details(seed, validation_rows, on_no_prompt)
    version = publish_collections(made, output, details)
    return collection_counts(published(spark, output, version))


def published_details(seed: int, validation_rows: int, on_no_prompt: str) -> dict[str, object]:
    """What a manifest says of a run besides its counts."""
    return {
        "seed": seed,
        "validation_rows": validation_rows,
        "on_no_prompt": on_no_prompt,
        "system_prompt": SYSTEM_PROMPT,
    }
