"""Shard selection, training samples and held-out samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arith import whole_div
from textloom.functions.hashing import hash_bucket, is_validation, seeded_hash
from textloom.functions.text import cap_chars, has_min_chars, nfc
from textloom.operators.ranking import (
    bucket_counts,
    first_in_group,
    global_offsets,
    row_bucket,
    running_offsets,
)
from textloom.session import materialize

# Which corpus sources count as which evaluation domain.
DOMAINS = {
    "english": ("dclm_edu", "fineweb_edu", "cosmopedia_v2"),
    "code": ("stack_edu",),
}
# Fixed values of the shard budget: most shards, safety factor, tokens in one shard.
MAX_SHARDS = 85
BUDGET_FACTOR = 1.2
TOKENS_PER_SHARD = 117_000_000
# Leading rows of a shard that are looked at first: a multiple of its quota, and some more.
HEAD_FACTOR = 2
HEAD_ROWS = 64


def domain(source: Column, domains: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Domain of a source; null for sources that belong to none."""
    result = None
    for name, sources in (domains or DOMAINS).items():
        hit = source.isin(*sources)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result


def matching(listing: DataFrame, path: str, prefix: str = "", suffix: str = ".parquet") -> DataFrame:
    """Files of a listing by the beginning and end of their paths; raises where none matches."""
    found = listing.filter(F.col(path).startswith(prefix) & F.col(path).endswith(suffix))
    if found.isEmpty():
        raise FileNotFoundError(f"no file begins with {prefix!r} and ends with {suffix!r}")
    return found


def evenly_spaced(listing: DataFrame, path: str, count: int | Column | None) -> DataFrame:
    """An evenly spaced subset of the sorted listing, both ends included.

    ``None`` or 0 keeps everything; 1 keeps the middle one. Halves round to even.
    """
    if count is None or (isinstance(count, int) and count == 0):
        return listing
    if isinstance(count, int) and count < 1:
        raise ValueError("the number of shards must be positive")
    ranked = global_offsets(listing, path, F.lit(1), out="position")
    n = ranked.agg(F.count("*").alias("n")).scalar()
    spark = listing.sparkSession
    if isinstance(count, int):
        slots = spark.range(count).withColumn("k", F.lit(count))
    else:
        slots = spark.range(1).select(count.cast("bigint").alias("k")).select(
            "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("id")
        )
    k = F.least(F.col("k"), n)
    spread = F.bround(F.col("id") * (n - 1) / F.greatest(k - 1, F.lit(1)))
    chosen = (
        slots.filter(F.col("id") < k)
        .select(F.when(k == 1, whole_div(n, 2)).otherwise(spread).cast("bigint").alias("position"))
        .distinct()
    )
    return ranked.join(chosen, "position", "left_semi")


def shard_budget(tokens: Column, max_shards: int | Column | None = MAX_SHARDS) -> Column:
    """How many shards a token budget needs; ``max_shards`` is the number there is, None for any."""
    wanted = F.bround(tokens * BUDGET_FACTOR / TOKENS_PER_SHARD).cast("bigint")
    if max_shards is not None:
        wanted = F.least(F.lit(max_shards) if isinstance(max_shards, int) else max_shards, wanted)
    return F.greatest(F.lit(1), wanted)


def per_shard_quota(
    df: DataFrame,
    shard: str,
    row: str,
    text: str,
    max_documents: int,
    seed: int = 42,
    min_chars: int = 64,
) -> DataFrame:
    """Training sample: the same number of leading usable rows from every shard.

    The quota divides by all shards, also those without a usable row. Shards are taken in seeded
    order until ``max_documents`` rows are reached; when one pass is not enough the same prefixes
    are taken again, pass after pass. Adds ``copy`` (pass number, from 0). ``row`` counts from 0.

    The texts are scanned once: the leading rows of all shards, about twice the quota, are set aside
    and nearly always hold enough usable ones. A shard that needs more of its rows is read on; the
    others are not.
    """
    # One row per shard, from two narrow columns.
    ends = materialize(df.groupBy(shard).agg(F.max(row).alias("_end")), "shards")
    n_shards = ends.count()
    if not n_shards:
        return df.withColumn("copy", F.lit(0).cast("bigint"))
    quota = math.ceil(max_documents / n_shards)
    reach = HEAD_FACTOR * quota + HEAD_ROWS
    usable = df.filter(F.col(row) < reach).filter(has_min_chars(text, min_chars))
    usable = materialize(usable, "heads")
    filled = usable.groupBy(shard).agg(F.count("*").alias("_n")).filter(F.col("_n") >= quota)
    wanting = ends.filter(F.col("_end") >= reach).join(filled, shard, "left_anti")
    if wanting.limit(1).collect():
        rest = df.filter(F.col(row) >= reach).join(wanting.select(shard), shard, "left_semi")
        rest = rest.filter(has_min_chars(text, min_chars)).select(*df.columns)
        usable = usable.select(*df.columns).union(materialize(rest, "rest"))
    counts = bucket_counts(usable, [shard], row_bucket(F.col(row)))

    # One row per shard from here on.
    shards = counts.groupBy(shard).agg(F.sum("_rows").alias("_usable"))
    shards = shards.withColumn("_taken", F.least(F.col("_usable"), F.lit(quota)).cast("bigint"))
    one_pass = shards.agg(F.sum("_taken").alias("s")).scalar()
    full = whole_div(F.lit(max_documents), one_pass)
    rest = F.lit(max_documents) - full * one_pass
    last_order = seeded_hash((F.lit(seed) + full * one_pass), F.col(shard))
    shards = shards.withColumn("_full", full).withColumn("_h", last_order)
    shards = running_offsets(
        shards, [], ["_h", shard], F.col("_taken"), hash_bucket(F.col("_h")), "_before", 256
    )
    left = F.greatest(F.lit(0), F.least(F.col("_taken"), rest - F.col("_before")))
    shards = shards.select(shard, "_taken", "_full", left.cast("bigint").alias("_last"))

    bound = F.when(F.col("_full") > 0, F.col("_taken")).otherwise(F.col("_last"))
    limits = shards.select(shard, bound.alias("quota"), "_full", "_last")
    picked = first_in_group(
        usable, [shard], [row], row_bucket(F.col(row)), limits, rank="_rank", counts=counts
    )
    copies = F.col("_full") + (F.col("_rank") < F.col("_last")).cast("bigint")
    return (
        picked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)))
        .drop("_full", "_last", "_rank")
    )


def tail_quotas(df: DataFrame, shard: str, target: int) -> DataFrame:
    """``target`` split over the sorted shards; the first ones take the remainder."""
    names = global_offsets(df.select(shard).distinct(), shard, F.lit(1), out="_i")
    n = names.agg(F.count("*").alias("n")).scalar()
    share = whole_div(F.lit(target), n) + (F.col("_i") < F.lit(target) % n).cast("bigint")
    return names.select(shard, share.cast("bigint").alias("quota"))


def tail_sample(
    df: DataFrame,
    shard: str,
    row: str,
    text: str,
    source: str,
    target: int,
    tail_start: int,
    seed: int = 120,
    max_chars: int = 16_384,
    fraction: float = 0.001,
    method: str = "blake2b",
    domains: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """Held-out sample: per shard and domain an equal quota of random usable tail rows.

    Rows are taken in the order of a seeded digest. The texts are scanned once: rows with a small
    digest, about twice the quota of each group, are set aside and nearly always suffice; a group
    that does not get its quota from them is read on, the others are not.
    """
    group = [shard, "domain"]
    quotas = tail_quotas(df, shard, target).withColumn(
        "domain", F.explode(F.array(*[F.lit(d) for d in (domains or DOMAINS)]))
    )
    tail = (
        df.withColumn("domain", domain(F.col(source), domains))
        .filter(F.col("domain").isNotNull() & (F.col(row) >= tail_start))
        .withColumn("_h", seeded_hash(seed, F.col(shard), F.col(row)))
    )
    bucket = hash_bucket(F.col("_h"))
    fits = has_min_chars(text) & ~is_validation(F.col(text), fraction, method)

    # One row per group, from narrow columns: how far each group is read at first.
    sizes = tail.groupBy(*group).agg(F.count("*").alias("_rows"))
    share = (HEAD_FACTOR * F.col("quota") + HEAD_ROWS) / F.col("_rows")
    bound = F.least(F.lit(65_536), F.ceil(share * 65_536)).cast("bigint")
    bounds = materialize(
        quotas.join(sizes, group).select(*group, "quota", bound.alias("_bound")), "bounds"
    )
    placed = tail.withColumn("_b", bucket).join(bounds.drop("quota"), group)
    near = placed.filter(F.col("_b") < F.col("_bound")).filter(fits).select(*tail.columns)
    near = materialize(near, "near")
    found = near.groupBy(*group).agg(F.count("*").alias("_n"))
    short = bounds.join(found, group, "left").filter(
        (F.coalesce("_n", F.lit(0)) < F.col("quota")) & (F.col("_bound") < 65_536)
    )
    candidates = near
    if short.limit(1).collect():
        rest = placed.join(short.select(*group), group, "left_semi")
        rest = rest.filter(F.col("_b") >= F.col("_bound")).filter(fits).select(*tail.columns)
        candidates = near.union(materialize(rest, "rest"))
    picked = first_in_group(candidates, group, ["_h", row], bucket, quotas, fan_out=256)
    return picked.drop("_h").withColumn(text, nfc(cap_chars(text, max_chars)))


def tail_shortages(
    sample: DataFrame,
    df: DataFrame,
    shard: str,
    target: int,
    domains: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """Shards and domains whose quota was not met, with the number found."""
    wanted = tail_quotas(df, shard, target).withColumn(
        "domain", F.explode(F.array(*[F.lit(d) for d in (domains or DOMAINS)]))
    )
    found = sample.groupBy(shard, "domain").agg(F.count("*").alias("found"))
    return (
        wanted.join(found, [shard, "domain"], "left")
        .withColumn("found", F.coalesce("found", F.lit(0)))
        .filter(F.col("found") < F.col("quota"))
    )


def require_full_quotas(shortages: DataFrame) -> None:
    """Raise when any quota is short; looks at the first few only."""
    short = shortages.limit(5).collect()
    if short:
        raise RuntimeError(f"held-out quotas not met: {[r.asDict() for r in short]}")
