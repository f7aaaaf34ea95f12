"""Stateless sample orders over blocks.

Epoch ``e`` visits block ``(a_e * i + b_e) mod n`` at position ``i``. The map is affine, so it can
be turned around: a block computes its own position in each epoch. Plans are therefore column
arithmetic over the block table, without a join between samples and blocks.
"""

from __future__ import annotations

import itertools
import json
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arith import whole_div

# Fixed value: distance between the generator seeds of two epochs.
EPOCH_STRIDE = 1_000_003
EPOCH_NUMBERS = "array<struct<epoch:bigint,inverse:bigint,offset:bigint>>"
# Products of two block indexes stay inside 64 bits up to here.
LONG_SAFE_BLOCKS = 3_037_000_499


def epoch_parameters(blocks: int, seed: int, epoch: int) -> tuple[int, int]:
    """Multiplier (coprime to ``blocks``) and offset of an epoch; two integers from Python's
    generator, which the published order is defined by."""
    if blocks < 1:
        raise ValueError("no complete block")
    if blocks == 1:
        return 1, 0
    generator = random.Random(seed + epoch * EPOCH_STRIDE)
    drawn = generator.randrange(1, blocks)
    # The first coprime from the drawn number on, going round to 1.
    candidates = itertools.chain(range(drawn, blocks), range(1, drawn))
    multiplier = next(c for c in candidates if math.gcd(c, blocks) == 1)
    return multiplier, generator.randrange(blocks)


def _affine(a: Column, x: Column, b: Column, blocks: int) -> Column:
    if blocks <= LONG_SAFE_BLOCKS:
        return F.pmod(a.cast("bigint") * x.cast("bigint") + b.cast("bigint"), F.lit(blocks))
    wide = a.cast("decimal(19,0)") * x.cast("decimal(18,0)") + b.cast("decimal(18,0)")
    return F.pmod(wide, F.lit(blocks).cast("decimal(18,0)")).cast("bigint")


def permuted_index(index: Column, blocks: int, seed: int, epoch: int, shuffle: bool = True) -> Column:
    """Block at position ``index`` of an epoch."""
    if not shuffle:
        return index
    a, b = epoch_parameters(blocks, seed, epoch)
    return _affine(F.lit(a), index, F.lit(b), blocks)


def position_in_epoch(block: Column, blocks: int, seed: int, epochs: range) -> Column:
    """Array with the position of ``block`` in each of the epochs.

    The numbers of all epochs are one literal array, so the generated code does not grow with them.
    """
    numbers = []
    for epoch in epochs:
        a, b = epoch_parameters(blocks, seed, epoch)
        inverse = pow(a, -1, blocks) if blocks > 1 else 0
        numbers.append({"epoch": epoch, "inverse": inverse, "offset": b})
    table = F.from_json(F.lit(json.dumps(numbers)), EPOCH_NUMBERS)
    return F.transform(
        table,
        lambda e: F.struct(
            e["epoch"].alias("epoch"),
            _affine(
                e["inverse"], F.pmod(block - e["offset"], F.lit(blocks)), F.lit(0), blocks
            ).alias("position"),
        ),
    )


def count_blocks(offsets: DataFrame) -> int:
    """Total number of blocks: one number on the driver."""
    total = offsets.agg(F.sum("blocks").alias("n")).first()["n"]
    if not total:
        raise ValueError("no complete block")
    return int(total)


def epoch_permutation(blocks: DataFrame, index: str, n: int, seed: int, epochs: range) -> DataFrame:
    """Every block once per epoch with its sample index."""
    return blocks.select(
        "*", F.inline(position_in_epoch(F.col(index), n, seed, epochs))
    ).withColumn("sample", F.col("epoch") * n + F.col("position"))


def training_plan(
    blocks: DataFrame,
    index: str,
    n: int,
    seed: int,
    max_tokens: int,
    length: int,
    micro_batch: int,
    accumulation: int,
    start_step: int = 0,
) -> DataFrame:
    """Which block is read at which step, accumulation round and slot, from ``start_step`` on."""
    per_step = micro_batch * accumulation
    steps = math.ceil(max_tokens / (length * per_step))
    first, end = start_step * per_step, steps * per_step
    if first >= end:
        epochs = range(0, 1)
    else:
        epochs = range(first // n, (end - 1) // n + 1)
    samples = epoch_permutation(blocks, index, n, seed, epochs).filter(
        (F.col("sample") >= first) & (F.col("sample") < end)
    )
    return samples.select(
        *blocks.columns,
        "sample",
        whole_div(F.col("sample"), per_step).alias("step"),
        whole_div(F.col("sample") % per_step, micro_batch).alias("round"),
        (F.col("sample") % micro_batch).alias("slot"),
    )


def write_training_plan(plan: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store a plan so that a reader of consecutive steps touches few files."""
    ranged = plan.repartitionByRange(partitions, "step") if partitions else plan.repartitionByRange("step")
    ranged.sortWithinPartitions("step", "round", "slot").write.mode("overwrite").parquet(path)


def eval_plan(blocks: DataFrame, index: str, n: int, batches: int, batch_size: int) -> DataFrame:
    """Validation batches in block order; a partial last batch wraps around to the first blocks."""
    used = min(batches, math.ceil(n / batch_size))
    end = used * batch_size
    wraps = max(1, math.ceil(end / n))
    repeated = blocks.withColumn("_wrap", F.explode(F.sequence(F.lit(0), F.lit(wraps - 1))))
    sample = F.col(index) + F.col("_wrap").cast("bigint") * n
    return (
        repeated.withColumn("sample", sample)
        .filter(F.col("sample") < end)
        .select(
            *blocks.columns,
            "sample",
            whole_div(F.col("sample"), batch_size).alias("batch"),
            (F.col("sample") % batch_size).alias("slot"),
        )
    )
