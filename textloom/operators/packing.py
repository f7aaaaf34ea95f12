"""Fixed-length blocks over the token stream of each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arith import whole_div
from textloom.functions.tokens import TOKEN_BYTES, packed_slice, token_count
from textloom.operators.ranking import global_offsets, row_bucket, running_offsets

# Documents per bucket of the running token offsets.
BUCKET_DOCUMENTS = 256
# Blocks per bucket of the range join.
LOCATE_WIDTH = 4096


def pack_blocks(
    tokens: DataFrame, shard: str, row: str, packed: str, length: int, count: str | None = None
) -> DataFrame:
    """Concatenate the documents of a shard in row order and cut blocks of ``length`` tokens.

    Blocks cross documents, never shards; the incomplete tail of a shard is dropped. Returns
    ``shard, block, tokens`` (packed).

    A document knows its first token's position from the running offset, so it cuts itself into
    the pieces that belong to each block. Pieces meet by ``(shard, block)``: a group never holds
    more than ``length`` tokens, whatever the size of the shard. With the ``count`` column of
    written token shards, the offsets are found without reading the tokens.
    """
    n = F.col(count) if count else token_count(F.col(packed))
    docs = tokens.select(shard, row, F.col(packed).alias("_p"), n.alias("_n"))
    docs = docs.filter(F.col("_n") > 0)
    placed = running_offsets(
        docs, [shard], [row], F.col("_n"), row_bucket(F.col(row), BUCKET_DOCUMENTS), "_start"
    )
    first = whole_div(F.col("_start"), length)
    last = whole_div(F.col("_start") + F.col("_n") - 1, length)

    def piece(block: Column) -> Column:
        lo = F.greatest(block * length, F.col("_start"))
        hi = F.least((block + 1) * length, F.col("_start") + F.col("_n"))
        return F.struct(
            block.alias("block"),
            (lo - block * length).cast("int").alias("at"),
            packed_slice(F.col("_p"), lo - F.col("_start"), hi - lo).alias("piece"),
        )

    pieces = placed.select(shard, F.inline(F.transform(F.sequence(first, last), piece)))
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.struct("at", "piece"))),
        F.lit(b""),
        lambda acc, p: F.concat(acc, p["piece"]),
    )
    blocks = pieces.groupBy(shard, "block").agg(joined.alias("tokens"))
    return blocks.filter(F.octet_length("tokens") == length * TOKEN_BYTES)


def block_offsets(shards: DataFrame, shard: str, tokens: Column, length: int) -> DataFrame:
    """Per shard: number of blocks and the global index range ``[lo, hi)``, in manifest order.

    Shards without a complete block are left out.
    """
    counted = shards.select(
        shard, tokens.cast("bigint").alias("tokens"), whole_div(tokens, length).alias("blocks")
    ).filter(F.col("blocks") > 0)
    placed = global_offsets(counted, shard, F.col("blocks"), out="lo")
    return placed.select(
        shard,
        "tokens",
        "blocks",
        "lo",
        (F.col("lo") + F.col("blocks")).alias("hi"),
        (F.col("blocks") * length).alias("usable_tokens"),
    )


def block_locate(
    requests: DataFrame, index: str, offsets: DataFrame, shard: str, width: int = LOCATE_WIDTH
) -> DataFrame:
    """Global block index → shard and local block.

    The range condition ``lo <= index < hi`` is turned into an equality: each shard range is listed
    once for every bucket of ``width`` indexes it touches, so the join hashes on the bucket and
    compares ranges only inside it.
    """
    touched = F.sequence(whole_div(F.col("lo"), width), whole_div(F.col("hi") - 1, width))
    ranges = offsets.select(shard, "lo", "hi", F.explode(touched).alias("_b"))
    wanted = requests.withColumn("_b", whole_div(F.col(index), width))
    return (
        wanted.join(ranges, "_b")
        .filter((F.col(index) >= F.col("lo")) & (F.col(index) < F.col("hi")))
        .withColumn("local_block", F.col(index) - F.col("lo"))
        .drop("_b", "lo", "hi")
    )


def global_blocks(blocks: DataFrame, offsets: DataFrame, shard: str) -> DataFrame:
    """Adds the global index of every block.

    The offset table has one row per shard; where it is too large to be broadcast, a hot shard is
    split by adaptive skew handling of the sort-merge join.
    """
    return blocks.join(offsets.select(shard, "lo"), shard).select(
        *blocks.columns, (F.col("lo") + F.col("block")).alias("block_index")
    )
