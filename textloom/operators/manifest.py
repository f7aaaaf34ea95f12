"""Build statistics, manifests and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.tokens import TOKEN_BYTES

FORMAT_VERSION = 2
DTYPE, BYTE_ORDER = "uint16", "little"
# What makes a built shard reusable. The chunk size and the split method belong here because they
# change the tokens and where they go.
FINGERPRINT = (
    "format_version",
    "source",
    "source_bytes",
    "source_mtime",
    "tokenizer_sha256",
    "validation_fraction",
    "split_method",
    "min_chars",
    "max_chunk_chars",
)


def shard_build_stats(
    df: DataFrame, shard: str, usable: Column, validation: Column, tokens: Column
) -> DataFrame:
    """Per shard: tokens of either split, documents, skipped documents.

    ``tokens`` counts begin and end ids. Sums fold before the shuffle, so one row per shard and
    task moves.
    """
    marked = df.select(
        shard,
        usable.alias("_u"),
        F.when(usable, validation).alias("_v"),
        F.when(usable, tokens).alias("_t"),
    )
    held = F.coalesce(F.col("_v"), F.lit(False))
    zero = F.lit(0).cast("bigint")
    return marked.groupBy(shard).agg(
        F.coalesce(F.sum(F.when(~held, F.col("_t"))), zero).cast("bigint").alias("train_tokens"),
        F.coalesce(F.sum(F.when(held, F.col("_t"))), zero).cast("bigint").alias("validation_tokens"),
        F.count_if(F.col("_u")).alias("documents"),
        F.count_if(~F.col("_u")).alias("skipped_documents"),
    )


def split_manifest(stats: DataFrame, shard: str) -> DataFrame:
    """One row per split and shard with tokens, one per split in total, one over everything.

    ``level`` tells them apart: ``shard``, ``split``, ``all``.
    """
    long = stats.select(
        shard,
        F.expr(
            "stack(2, 'train', train_tokens, 'validation', validation_tokens) as (split, tokens)"
        ),
    ).filter(F.col("tokens") > 0)
    rolled = long.rollup("split", shard).agg(
        F.sum("tokens").cast("bigint").alias("tokens"),
        F.count("*").alias("shards"),
        F.grouping_id().alias("_g"),
    )
    level = F.when(F.col("_g") == 0, "shard").when(F.col("_g") == 1, "split").otherwise("all")
    return rolled.select(level.alias("level"), "split", shard, "tokens", "shards")


def collection_counts(df: DataFrame) -> DataFrame:
    """Rows per collection and split."""
    return df.groupBy("collection", "split").agg(F.count("*").alias("rows"))


def pending_shards(
    listing: DataFrame, metadata: DataFrame, outputs: DataFrame, fingerprint: tuple[str, ...] = FINGERPRINT
) -> DataFrame:
    """Shards that have to be built: no metadata with the same fingerprint and intact outputs."""
    done = intact_metadata(metadata, outputs).select(*fingerprint)
    return listing.join(done, list(fingerprint), "left_anti")


def cached_shards(
    listing: DataFrame, metadata: DataFrame, outputs: DataFrame, fingerprint: tuple[str, ...] = FINGERPRINT
) -> DataFrame:
    """Shards that can be reused."""
    done = intact_metadata(metadata, outputs).select(*fingerprint)
    return listing.join(done, list(fingerprint), "left_semi")


def intact_metadata(metadata: DataFrame, outputs: DataFrame) -> DataFrame:
    """Metadata rows whose two output files exist with two bytes a token.

    ``outputs`` is ``path, bytes``; ``metadata`` names them in ``train_path``/``validation_path``.
    """
    for side in ("train", "validation"):
        found = outputs.select(
            F.col("path").alias(f"{side}_path"), F.col("bytes").alias(f"{side}_bytes")
        )
        metadata = metadata.join(found, f"{side}_path").filter(
            F.col(f"{side}_bytes") == F.col(f"{side}_tokens") * TOKEN_BYTES
        )
    return metadata


def manifest_upsert(previous: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Entries of ``previous`` overwritten or extended by those of ``new``."""
    values = [c for c in previous.columns if c != key]
    old = previous.select(key, F.struct(*values).alias("_old"))
    fresh = new.select(key, F.struct(*values).alias("_new"))
    merged = old.join(fresh, key, "full_outer").select(
        key, F.coalesce("_new", "_old").alias("_v")
    )
    return merged.select(key, *[F.col(f"_v.{c}").alias(c) for c in values])


def manifest_audit(
    manifests: DataFrame, shards: DataFrame, files: DataFrame, tokenizer_sha256: str | Column
) -> DataFrame:
    """One row per manifest: ``passed`` and the first broken rule.

    ``manifests``: manifest, dtype, byte_order, tokenizer_sha256, total_tokens. ``shards``:
    manifest, path, tokens. ``files``: path, bytes. Rules in the order they are checked: format,
    tokenizer, file present, file size, no shards, total.
    """
    expected = tokenizer_sha256 if isinstance(tokenizer_sha256, Column) else F.lit(tokenizer_sha256)
    checked = shards.join(files, "path", "left").groupBy("manifest").agg(
        F.count("*").alias("shards"),
        F.sum("tokens").cast("bigint").alias("counted"),
        F.count_if(F.col("bytes").isNull()).alias("missing"),
        F.count_if(F.col("bytes") != F.col("tokens") * TOKEN_BYTES).alias("wrong_size"),
    )
    joined = manifests.join(checked, "manifest", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    differs = lambda a, b: ~a.eqNullSafe(b)
    reason = (
        F.when(
            differs(F.col("dtype"), F.lit(DTYPE)) | differs(F.col("byte_order"), F.lit(BYTE_ORDER)),
            "format",
        )
        .when(differs(F.col("tokenizer_sha256"), expected), "tokenizer")
        .when(n("missing") > 0, "missing_file")
        .when(n("wrong_size") > 0, "file_size")
        .when(n("shards") == 0, "no_shards")
        .when(differs(n("counted"), F.coalesce(F.col("total_tokens"), F.lit(-1))), "total")
    )
    return joined.select(
        "manifest",
        reason.isNull().alias("passed"),
        F.coalesce(reason, F.lit("ok")).alias("reason"),
        n("shards").cast("bigint").alias("shards"),
        n("counted").cast("bigint").alias("counted_tokens"),
    )


def fingerprints(
    listing: DataFrame,
    tokenizer_sha256: str,
    validation_fraction: float,
    min_chars: int,
    max_chunk_chars: int,
    split_method: str = "blake2b",
) -> DataFrame:
    """Build fingerprint of every source file in ``path, bytes, modified``."""
    return listing.select(
        F.lit(FORMAT_VERSION).alias("format_version"),
        F.col("path").alias("source"),
        F.col("bytes").alias("source_bytes"),
        F.col("modified").alias("source_mtime"),
        F.lit(tokenizer_sha256).alias("tokenizer_sha256"),
        F.lit(float(validation_fraction)).alias("validation_fraction"),
        F.lit(split_method).alias("split_method"),
        F.lit(min_chars).alias("min_chars"),
        F.lit(max_chunk_chars).alias("max_chunk_chars"),
    )
