"""Mergeable sketches of a tokenized corpus, one row for each group and shard.

Shards are sketched once, when they are built; reports merge stored rows and never read the texts or
tokens again. A KLL sketch of tokens per 100 characters gives quantiles whose rank is off by at most
``KLL_RANK_ERROR`` (99 % of the time), an HLL sketch of token ids the number of distinct ids with a
relative standard error of ``HLL_ERROR``. Both merge without further loss, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.tokens import distinct_ids
from textloom.operators.report import FERTILITY, fertility

KLL_K = 400
KLL_RANK_ERROR = 0.01
HLL_LG_K = 14
HLL_ERROR = 1.04 / 2 ** (HLL_LG_K / 2)


def shard_sketches(
    df: DataFrame, group: str, shard: str, tokens: Column, chars: Column, packed: str
) -> DataFrame:
    """``group, shard, documents, fertility_sketch, ids_sketch``.

    Map-side sketches fold before the shuffle, so a hot shard moves one row a task.
    """
    rows = df.select(
        group, shard, fertility(tokens, chars).cast("double").alias("_f"), distinct_ids(F.col(packed)).alias("_ids")
    )
    quantiles = rows.groupBy(group, shard).agg(
        F.count("*").alias("documents"), F.kll_sketch_agg_double("_f", F.lit(KLL_K)).alias("fertility_sketch")
    )
    ids = rows.select(group, shard, F.explode("_ids").alias("_id")).groupBy(group, shard)
    distinct = ids.agg(F.hll_sketch_agg(F.col("_id").cast("int"), HLL_LG_K).alias("ids_sketch"))
    same = quantiles[group].eqNullSafe(distinct[group]) & quantiles[shard].eqNullSafe(distinct[shard])
    return quantiles.join(distinct, same, "left").select(
        quantiles[group], quantiles[shard], "documents", "fertility_sketch", "ids_sketch"
    )


def rolled_up(sketches: DataFrame, group: str) -> DataFrame:
    """``group, documents``, the quantiles of :data:`FERTILITY` and ``observed_ids`` from stored sketches."""
    merged = sketches.groupBy(group).agg(
        F.sum("documents").cast("bigint").alias("documents"),
        F.kll_merge_agg_double("fertility_sketch", F.lit(KLL_K)).alias("_f"),
        F.hll_union_agg("ids_sketch").alias("_ids"),
    )
    return merged.select(
        group,
        "documents",
        *[F.kll_sketch_get_quantile_double("_f", F.lit(q)).alias(n) for n, q in FERTILITY.items()],
        F.hll_sketch_estimate("_ids").alias("observed_ids"),
    )
