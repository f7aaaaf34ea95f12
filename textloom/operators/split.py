"""Train / validation splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.arith import whole_div
from textloom.functions.hashing import hash_bucket, is_validation, seeded_hash
from textloom.operators.ranking import bucket_bases
from textloom.session import materialize

VALIDATION_SOURCES = ("validation", "test")
# 4 hex digits: the bucket table has at most 65,536 rows, whatever the size of the data.
BUCKET_DIGITS = 4


def hash_split(df: DataFrame, text: str, fraction: float, method: str = "md5") -> DataFrame:
    """Adds ``split``: content-addressed, so equal texts land on the same side."""
    flag = is_validation(F.col(text), fraction, method)
    return df.withColumn("split", F.when(flag, "validation").otherwise("train"))


def validation_size(rows: Column, validation_rows: int, divisor: int = 100) -> Column:
    """``min(validation_rows, max(1, rows // divisor))``."""
    share = whole_div(rows, divisor)
    return F.least(F.lit(validation_rows), F.greatest(F.lit(1), share)).cast("bigint")


def _keys(df: DataFrame, key: str, *more: Column) -> DataFrame:
    """The keys of a frame, written once: deciding the cut reads them several times."""
    return materialize(df.select(F.col(key).alias("_k"), *more), "keys")


def _cut(keys: DataFrame, seed: int, validation_rows: int, divisor: int) -> Column:
    """The digest and key of the last validation row, as a scalar subquery."""
    hashed = keys.select(seeded_hash(seed, F.col("_k")).alias("_h"), "_k")
    hashed = hashed.withColumn("_bucket", hash_bucket(F.col("_h"), BUCKET_DIGITS))
    bases = bucket_bases(hashed, [], "_bucket", F.lit(1), fan_out=256)
    # At most 65,536 rows here: a window without partitions is bounded.
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = validation_size(F.sum("bucket_total").over(whole), validation_rows, divisor)
    bases = bases.withColumn("_size", size)
    edge = bases.filter(
        (F.col("bucket_base") < F.col("_size"))
        & (F.col("bucket_base") + F.col("bucket_total") >= F.col("_size"))
    )
    # Only the one bucket that holds the cut is sorted.
    position = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", "_k"))
    last = (
        hashed.join(edge, "_bucket")
        .withColumn("_n", position + F.col("bucket_base"))
        .filter(F.col("_n") == F.col("_size"))
    )
    return last.agg(F.max(F.struct("_h", "_k")).alias("cut")).scalar()


def _before_cut(keys: DataFrame, key: str, seed: int, validation_rows: int, divisor: int) -> Column:
    cut = _cut(keys, seed, validation_rows, divisor)
    mine = F.struct(seeded_hash(seed, F.col(key)).alias("_h"), F.col(key).alias("_k"))
    return F.coalesce(mine <= cut, F.lit(False))


def exact_validation_flag(
    df: DataFrame, key: str, seed: int, validation_rows: int, divisor: int = 100
) -> Column:
    """True for exactly ``min(validation_rows, max(1, rows // divisor))`` rows, in random order.

    The rows are those with the smallest seeded digest. The wide rows are never sorted or shuffled:
    counts per digest prefix locate the cut, and each row compares itself with it. ``key`` must be
    unique.
    """
    return _before_cut(_keys(df, key), key, seed, validation_rows, divisor)


def exact_split(
    df: DataFrame, key: str, seed: int, validation_rows: int, divisor: int = 100
) -> DataFrame:
    """Adds ``split`` with an exact validation size."""
    flag = exact_validation_flag(df, key, seed, validation_rows, divisor)
    return df.withColumn("split", F.when(flag, "validation").otherwise("train"))


def source_split(
    df: DataFrame,
    key: str,
    seed: int,
    validation_rows: int,
    divisor: int = 10,
    source: str = "source_split",
) -> DataFrame:
    """Split by the ``source`` column; a random exact split of all rows if a side is empty.

    Null counts as ``train``; any other unknown value is dropped, unless the fallback applies.
    """
    named = F.coalesce(F.col(source), F.lit("train"))
    side = F.when(named.isin(*VALIDATION_SOURCES), "validation").when(named == "train", "train")
    keys = _keys(df, key, side.alias("_side"))
    both = keys.agg((F.count_distinct("_side") == 2).alias("both")).scalar()
    flag = _before_cut(keys, key, seed, validation_rows, divisor)
    fallback = F.when(flag, "validation").otherwise("train")
    return df.withColumn("split", F.when(both, side).otherwise(fallback)).filter(
        F.col("split").isNotNull()
    )


def evaluation_subset(df: DataFrame, key: str, rows: int = 1_000) -> DataFrame:
    """The first ``rows`` rows in key order (a small top-k: 1,000, or 128 for online tuning)."""
    return df.orderBy(key).limit(rows)


def heldout(
    df: DataFrame,
    text: str,
    row: str,
    tail_start: int,
    fraction: float = 0.001,
    method: str = "md5",
) -> DataFrame:
    """Rows from ``tail_start`` on that are not validation documents."""
    return df.filter(
        (F.col(row) >= tail_start) & ~is_validation(F.col(text), fraction, method)
    )
