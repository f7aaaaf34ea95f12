"""Preference pairs: explicit (two conversations) and scored (two responses and a strength)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.messages import message, split_pair, valid_messages
from textloom.functions.text import is_blank
from textloom.sources.corpus import require_columns

# Fixed value: the system message in front of scored prompts.
SYSTEM_PROMPT = "You are a helpful, honest, and concise AI assistant."


def valid_conversations(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Conversations fit for supervised tuning."""
    require_columns(df, [messages])
    return df.filter(valid_messages(F.col(messages)))


def explicit_preference(df: DataFrame, on_no_prompt: str = "fail") -> DataFrame:
    """Move the longest common prefix of ``chosen`` and ``rejected`` to ``prompt``.

    A pair without a shared message fails the job, or is left out with ``on_no_prompt="drop"``
    (:func:`without_prompt` counts those).
    """
    require_columns(df, ["chosen", "rejected"])
    others = [c for c in df.columns if c not in ("prompt", "chosen", "rejected")]
    split = df.withColumn("_pair", split_pair(F.col("chosen"), F.col("rejected")))
    has_prompt = F.size("_pair.prompt") > 0
    if on_no_prompt == "drop":
        split = split.filter(has_prompt)
        prompt = F.col("_pair.prompt")
    elif on_no_prompt == "fail":
        prompt = F.when(has_prompt, F.col("_pair.prompt")).otherwise(
            F.raise_error(F.lit("chosen and rejected differ from their first message on"))
        )
    else:
        raise ValueError(f"unknown policy {on_no_prompt!r}")
    return split.select(
        *others,
        prompt.alias("prompt"),
        F.col("_pair.chosen").alias("chosen"),
        F.col("_pair.rejected").alias("rejected"),
    )


def without_prompt(df: DataFrame) -> DataFrame:
    """One row: how many pairs share no message."""
    shared = F.size(split_pair(F.col("chosen"), F.col("rejected"))["prompt"])
    return df.agg(F.count_if(shared == 0).alias("pairs_without_prompt"))


def _ends_with_assistant(messages: Column) -> Column:
    return F.coalesce(F.try_element_at(messages, F.lit(-1))["role"] == "assistant", F.lit(False))


def valid_pairs(df: DataFrame) -> DataFrame:
    """Pairs whose two sides are valid conversations."""
    require_columns(df, ["chosen", "rejected"])
    return df.filter(valid_messages(F.col("chosen")) & valid_messages(F.col("rejected")))


def complete_pairs(df: DataFrame) -> DataFrame:
    """Pairs with a prompt and two non-empty answers that end with the assistant."""
    return df.filter(
        (F.size("prompt") > 0)
        & (F.size("chosen") > 0)
        & (F.size("rejected") > 0)
        & _ends_with_assistant(F.col("chosen"))
        & _ends_with_assistant(F.col("rejected"))
    )


def explicit_pairs(df: DataFrame, on_no_prompt: str = "fail") -> DataFrame:
    """Validate both sides, take out the prompt, keep the complete pairs."""
    return complete_pairs(explicit_preference(valid_pairs(df), on_no_prompt))


def _response(df: DataFrame, number: int) -> Column:
    """``response_N``, or its older name ``responseN`` where the first is absent."""
    names = [n for n in (f"response_{number}", f"response{number}") if n in df.columns]
    if not names:
        raise ValueError(f"scored preference data is missing ['response_{number}']")
    return F.coalesce(*[F.col(n) for n in names])


def scored_filter(df: DataFrame) -> DataFrame:
    """Rows with a strength other than 0, a prompt and two responses; null counts as blank."""
    require_columns(df, ["prompt", "preference_strength"])
    return df.filter(
        (F.col("preference_strength").cast("int") != 0)
        & ~is_blank(F.col("prompt"))
        & ~is_blank(_response(df, 1))
        & ~is_blank(_response(df, 2))
    )


def normalize_scored(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Scored rows as explicit pairs: a negative strength prefers the first response."""
    require_columns(df, ["prompt", "preference_strength"])
    strength = F.col("preference_strength").cast("int")
    first, second = _response(df, 1), _response(df, 2)
    split = F.coalesce(F.col("split"), F.lit("train")) if "split" in df.columns else F.lit("train")
    return df.select(
        *(keep or []),
        F.array(message("assistant", F.when(strength < 0, first).otherwise(second))).alias("chosen"),
        F.array(message("assistant", F.when(strength < 0, second).otherwise(first))).alias("rejected"),
        F.array(
            message("system", F.lit(SYSTEM_PROMPT)), message("user", F.col("prompt"))
        ).alias("prompt"),
        F.abs(strength).alias("preference_strength"),
        split.alias("source_split"),
    )


def unique_prompts(df: DataFrame, key: str, across_splits: bool = False) -> DataFrame:
    """First occurrence (smallest ``key``) of every prompt, separately per ``split``.

    The prompt's JSON is the identity. Copies fold in the map-side aggregation, so a prompt that
    fills a third of the table leaves each task as one row. ``across_splits`` also removes
    validation prompts that occur in train.
    """
    keyed = df.withColumn("_json", F.to_json(F.col("prompt")))
    unique = keyed.groupBy("split", "_json").agg(F.min(F.col(key)).alias(key))
    # Parsing the JSON back keeps the aggregation to a number per group: no sort, no arrays.
    unique = unique.withColumn("prompt", F.from_json("_json", df.schema["prompt"].dataType))
    if across_splits:
        train = unique.filter(F.col("split") == "train").select("_json")
        held = unique.filter(F.col("split") != "train").join(train, "_json", "left_anti")
        unique = unique.filter(F.col("split") == "train").unionByName(held)
    return unique.select(key, "split", "prompt")
