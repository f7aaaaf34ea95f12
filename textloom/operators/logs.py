"""Roll-up of a training log into count-based windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arith import whole_div


def window_id(step: Column, every: int) -> Column:
    """Step 1 is a window of its own; later windows close at multiples of ``every``."""
    return F.when(step == 1, F.lit(0)).otherwise(whole_div(step + every - 1, every)).cast("bigint")


def closes_window(step: Column, every: int) -> Column:
    return (step == 1) | (step % every == 0)


def _seconds(interval: Column) -> Column:
    """A day-time interval in seconds; the same for timestamps with and without time zone."""
    part = lambda name: F.extract(F.lit(name), interval)
    whole = part("DAY") * 86_400 + part("HOUR") * 3_600 + part("MINUTE") * 60
    return whole + part("SECOND").cast("double")


def window_rows(
    log: DataFrame, step: str, loss: str, time: str, every: int, start_step: int = 0
) -> DataFrame:
    """Records by window ``w``. A closing step is listed twice: as the end of its window and, with
    ``own`` false, as the start of the next."""
    s = F.col(step)
    own = F.struct(window_id(s, every).alias("w"), F.lit(True).alias("own"))
    opens_next = closes_window(s, every) | (s == start_step)
    following = F.struct(window_id(s + 1, every).alias("w"), F.lit(False).alias("own"))
    both = F.array(F.when(s > start_step, own), F.when(opens_next, following))
    return log.filter(s >= start_step).select(
        s.alias("_s"),
        F.col(loss).alias("_l"),
        F.col(time).alias("_t"),
        F.inline(F.filter(both, lambda x: x.isNotNull())),
    )


def window_values() -> list[Column]:
    """What is known of a window."""
    return [
        F.max(F.when(F.col("own"), F.col("_s"))).alias("step"),
        F.count_if(F.col("own")).alias("steps"),
        F.avg(F.when(F.col("own"), F.col("_l"))).alias("loss"),
        F.min("_t").alias("_first"),
        F.max("_t").alias("_last"),
    ]


def finished_windows(grouped: DataFrame, every: int, tokens_per_step: int) -> DataFrame:
    """Closed windows with their rates."""
    closed = grouped.filter(closes_window(F.col("step"), every)).withColumn(
        "elapsed_seconds", _seconds(F.col("_last") - F.col("_first"))
    )
    return closed.select(
        "step",
        (F.col("step") * tokens_per_step).cast("bigint").alias("tokens"),
        "steps",
        "loss",
        "elapsed_seconds",
        F.when(
            F.col("elapsed_seconds") > 0,
            F.col("steps") * tokens_per_step / F.col("elapsed_seconds"),
        ).alias("tokens_per_second"),
    )


def interval_rollup(
    log: DataFrame,
    step: str,
    loss: str,
    time: str,
    every: int,
    tokens_per_step: int,
    start_step: int = 0,
) -> DataFrame:
    """Mean loss and tokens per second of every closed window after ``start_step``.

    A window opens at the time the one before it closed. One aggregation does it all; there is no
    window over the whole log. Without a record at ``start_step`` the first window opens at its own
    first step. Repeated steps count as often as they are logged. Steps after the last closed window
    are not reported.
    """
    rows = window_rows(log, step, loss, time, every, start_step)
    return finished_windows(rows.groupBy("w").agg(*window_values()), every, tokens_per_step)
