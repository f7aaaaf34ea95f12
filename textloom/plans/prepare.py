"""Raw documents to token shards, statistics and manifests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.hashing import is_validation
from textloom.functions.text import has_min_chars, nfc, pretokens
from textloom.functions.vocabulary import BpeModel
from textloom.operators.encode import MAX_CHUNK_CHARS, encode_documents
from textloom.operators.manifest import shard_build_stats, split_manifest
from textloom.operators.split import hash_split
from textloom.sources.sinks import token_sink


@dataclass
class PreparedCorpus:
    """What a preparation leaves behind; ``tokens`` reads the written shards."""

    tokens: DataFrame
    stats: DataFrame
    manifest: DataFrame


def pretoken_manifest(
    docs: DataFrame, shard: str, text: str, fraction: float, min_chars: int = 64
) -> DataFrame:
    """Manifest of a corpus whose tokens are its pre-tokens: one scan, one small shuffle."""
    tokens = F.size(pretokens(nfc(text))) + 2
    stats = shard_build_stats(
        docs,
        shard,
        has_min_chars(text, min_chars),
        is_validation(F.col(text), fraction),
        tokens,
    )
    return split_manifest(stats, shard)


def prepare_corpus(
    docs: DataFrame,
    shard: str,
    row: str,
    text: str,
    model: BpeModel,
    path: str,
    fraction: float = 0.001,
    min_chars: int = 64,
    max_chunk_chars: int = MAX_CHUNK_CHARS,
    method: str = "blake2b",
    shards_are_files: bool = False,
) -> PreparedCorpus:
    """Filter, split, encode and write once; statistics are read off the written shards."""
    spark: SparkSession = docs.sparkSession
    usable = docs.select(shard, row, text).filter(has_min_chars(text, min_chars))
    split = hash_split(usable, text, fraction, method)
    encoded = encode_documents(split, text, model, chunk_chars=max_chunk_chars).drop(text)
    token_sink(encoded, path, "split", shard, row, shards_are_files=shards_are_files)
    kinds = dict(encoded.dtypes)
    schema = f"`{row}` {kinds[row]}, n_tokens bigint, tokens binary, split string, `{shard}` {kinds[shard]}"
    written = spark.read.schema(schema).parquet(path)

    per_shard = written.groupBy(shard).agg(
        F.sum(F.when(F.col("split") == "train", F.col("n_tokens")).otherwise(0)).alias("train_tokens"),
        F.sum(F.when(F.col("split") != "train", F.col("n_tokens")).otherwise(0)).alias("validation_tokens"),
        F.count("*").alias("documents"),
    )
    seen = docs.groupBy(shard).agg(F.count("*").alias("_rows"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    stats = seen.join(per_shard, shard, "left").select(
        shard,
        zero("train_tokens"),
        zero("validation_tokens"),
        zero("documents"),
        (F.col("_rows") - F.coalesce(F.col("documents"), F.lit(0))).alias("skipped_documents"),
    )
    return PreparedCorpus(written, stats, split_manifest(stats, shard))
