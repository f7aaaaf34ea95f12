"""Training-log roll-up over a growing log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.logs import closes_window, finished_windows, window_rows, window_values
from textloom.streaming.sinks import read_batches, run_batches

PARTIAL = "w long, step long, steps long, loss_sum double, _first timestamp, _last timestamp"


def stream_interval_rollup(
    log: DataFrame,
    step: str,
    loss: str,
    time: str,
    every: int,
    tokens_per_step: int,
    start_step: int = 0,
    late_windows: int = 0,
) -> DataFrame:
    """:func:`textloom.operators.logs.interval_rollup` over a stream, in append mode.

    The number of a window serves as event time, one second each. The closing step is also the first
    record of the next window, so its arrival moves the watermark past its own window, which then
    comes out, repeated steps and all; a window is a few numbers of state until then. Records of
    windows that are out are late; ``late_windows`` keeps windows open for that many more.
    """
    rows = window_rows(log, step, loss, time, every, start_step)
    rows = rows.withColumn("_at", F.timestamp_seconds("w"))
    late = rows.withWatermark("_at", f"{late_windows} seconds")
    grouped = late.groupBy(F.window("_at", "1 second")).agg(*window_values())
    return finished_windows(grouped, every, tokens_per_step)


def dropped_rows(query: StreamingQuery) -> int:
    """Records that the watermark has dropped, in the batches that the query still remembers."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )


def rollup_available(
    log: DataFrame,
    output: str,
    checkpoint: str,
    step: str,
    loss: str,
    time: str,
    every: int,
    start_step: int = 0,
) -> StreamingQuery:
    """Add what has arrived of a log, in whatever order, to the partial windows below ``output``.

    A micro-batch leaves one row for each window it has records of: sums and bounds that merge with
    those of other batches. So no record is late, a resumed run may log steps again, and a batch that
    is run again replaces its own rows.
    """

    def write(batch: DataFrame, name: str) -> None:
        rows = window_rows(batch, step, loss, time, every, start_step)
        own = F.col("own")
        partial = rows.groupBy("w").agg(
            F.max(F.when(own, F.col("_s"))).cast("bigint").alias("step"),
            F.count_if(own).alias("steps"),
            F.sum(F.when(own, F.col("_l"))).cast("double").alias("loss_sum"),
            F.min("_t").cast("timestamp").alias("_first"),
            F.max("_t").cast("timestamp").alias("_last"),
        )
        partial.write.mode("overwrite").parquet(f"{output}/batch={name}")

    return run_batches(log, checkpoint, write)


def rolled_windows(
    spark: SparkSession, output: str, every: int, tokens_per_step: int
) -> DataFrame:
    """:func:`textloom.operators.logs.interval_rollup` of all records so far, and ``late_steps``: records
    that came in a batch after the one that closed their window."""
    parts = read_batches(spark, output, PARTIAL)
    closed = F.min(F.when(closes_window(F.col("step"), every), F.col("batch")))
    grouped = parts.groupBy("w").agg(
        F.max("step").alias("step"),
        F.sum("steps").cast("bigint").alias("steps"),
        (F.sum("loss_sum") / F.sum("steps")).alias("loss"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        closed.alias("_closed"),
        F.collect_list(F.struct("batch", "steps")).alias("_parts"),
    )
    late = F.aggregate(
        F.filter("_parts", lambda p: p["batch"] > F.col("_closed")),
        F.lit(0).cast("bigint"),
        lambda held, p: held + p["steps"],
    )
    told = grouped.select(F.col("step").alias("_step"), late.alias("late_steps"))
    done = finished_windows(grouped, every, tokens_per_step)
    return done.join(told, F.col("step") == F.col("_step")).drop("_step")
