"""Running totals and ranks that never pull a whole group into one task.

A plain window over a shard puts that shard, however large, into one task. Here rows are first put
in buckets that follow the order; only the small bucket table is summed across buckets (itself in
two steps), and the window over rows runs inside one bucket. A hot group is thereby spread over as
many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.arith import whole_div
from textloom.session import checkpointed, materialize

BUCKET_ROWS = 1024
FAN_OUT = 1024


def row_bucket(order: Column, width: int = BUCKET_ROWS) -> Column:
    """Bucket of an integer position; holds at most ``width`` rows if positions are unique."""
    return whole_div(order, width)


def _sum_before(value: str, partition: list[str], order: list[str]) -> Column:
    window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def bucket_bases(
    df: DataFrame,
    group: list[str],
    bucket: str,
    value: Column,
    fan_out: int = FAN_OUT,
    total: str = "bucket_total",
    base: str = "bucket_base",
) -> DataFrame:
    """``group + bucket`` → total of the bucket and the sum of all buckets before it."""
    totals = df.groupBy(*group, bucket).agg(F.sum(value).cast("bigint").alias(total))
    totals = totals.withColumn("_outer", whole_div(F.col(bucket), fan_out))
    outer = totals.groupBy(*group, "_outer").agg(F.sum(total).alias("_outer_total"))
    outer = outer.select(
        *group, "_outer", _sum_before("_outer_total", group, ["_outer"]).alias("_outer_base")
    )
    inner = totals.withColumn("_inner_base", _sum_before(total, [*group, "_outer"], [bucket]))
    return inner.join(outer, [*group, "_outer"]).select(
        *group,
        bucket,
        total,
        (F.col("_inner_base") + F.col("_outer_base")).cast("bigint").alias(base),
    )


def running_offsets(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: Column,
    bucket: Column,
    out: str = "start",
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the group.

    ``bucket`` is an integer column that rises with ``order`` inside a group.
    """
    bucketed = df.withColumn("_bucket", bucket).withColumn("_value", value.cast("bigint"))
    bases = bucket_bases(bucketed, group, "_bucket", F.col("_value"), fan_out)
    local = bucketed.withColumn("_local", _sum_before("_value", [*group, "_bucket"], order))
    return (
        local.join(bases.drop("bucket_total"), [*group, "_bucket"])
        .withColumn(out, (F.col("_local") + F.col("bucket_base")).cast("bigint"))
        .drop("_bucket", "_value", "_local", "bucket_base")
    )


def bucket_counts(df: DataFrame, group: list[str], bucket: Column) -> DataFrame:
    """Rows per ``group + _bucket``, written once: a small table that is read several times."""
    counted = df.select(*group, bucket.alias("_bucket")).groupBy(*group, "_bucket")
    return materialize(counted.agg(F.count("*").alias("_rows")), "counts")


def first_in_group(
    df: DataFrame,
    group: list[str],
    order: list[str],
    bucket: Column,
    quota: DataFrame | int | Column,
    rank: str = "rank",
    fan_out: int = FAN_OUT,
    counts: DataFrame | None = None,
) -> DataFrame:
    """The first ``quota`` rows of every group, ranked from 0.

    ``quota`` is a number, a scalar column, or a frame ``group + quota``, whose further columns the
    rows take with them. ``counts`` is the result
    of :func:`bucket_counts`, for callers that need it themselves. So the rows are read twice: once
    to be counted, once to be picked. The second time, buckets that lie wholly past the quota are
    dropped before any row is moved or sorted.
    """
    bucketed = df.withColumn("_bucket", bucket)
    if counts is None:
        counts = bucket_counts(df, group, bucket)
    bases = bucket_bases(counts, group, "_bucket", F.col("_rows"), fan_out)
    if isinstance(quota, DataFrame):
        bases = bases.join(quota.withColumnRenamed("quota", "_quota"), group)
    else:
        bases = bases.withColumn("_quota", quota if isinstance(quota, Column) else F.lit(quota))
    wanted = bases.filter(F.col("bucket_base") < F.col("_quota")).drop("bucket_total")
    last_bucket = wanted.agg(F.max("_bucket").alias("b")).scalar()
    window = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        bucketed.filter(F.col("_bucket") <= last_bucket)
        .join(wanted, [*group, "_bucket"])
        .withColumn(rank, (F.row_number().over(window) - 1 + F.col("bucket_base")).cast("bigint"))
        .filter(F.col(rank) < F.col("_quota"))
        .drop("_bucket", "_quota", "bucket_base")
    )


def global_offsets(df: DataFrame, order: str, value: Column, out: str = "start") -> DataFrame:
    """Sum of ``value`` over all rows that sort before this one, over the whole frame.

    For orders without a natural integer bucket (file names): range partitions serve as buckets.
    They are checkpointed, so that every later reading sees the same partitions.
    """
    ranged = (
        df.withColumn("_value", value.cast("bigint"))
        .repartitionByRange(order)
        .withColumn("_part", F.spark_partition_id())
    )
    ranged = checkpointed(ranged)
    # One row per range partition.
    parts = ranged.groupBy("_part").agg(F.sum("_value").alias("_part_total"))
    parts = parts.select("_part", _sum_before("_part_total", [], ["_part"]).alias("_part_base"))
    local = ranged.withColumn("_local", _sum_before("_value", ["_part"], [order]))
    return (
        local.join(parts, "_part")
        .withColumn(out, (F.col("_local") + F.col("_part_base")).cast("bigint"))
        .drop("_part", "_value", "_local", "_part_base")
    )
