"""Sinks that a repeated micro-batch does not change: each batch owns a folder and writes it whole."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

BatchWriter = Callable[[DataFrame, str], None]


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """Identity of a stream, as its checkpoint keeps it over restarts."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def run_batches(stream: DataFrame, checkpoint: str, write: BatchWriter) -> StreamingQuery:
    """Process everything that has arrived since the last run, batch by batch, and stop.

    ``write`` gets a batch and the name of its folder, which is the same whenever the batch is run
    again after a failure. The name tells streams apart, so one that starts anew with an empty
    checkpoint does not write over the batches of its predecessor.
    """

    def run(batch: DataFrame, number: int) -> None:
        write(batch, f"{stream_id(batch.sparkSession, checkpoint)}-{number:012d}")

    query = (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batch folders below ``path``, with ``batch``; empty where no batch was written."""
    try:
        return spark.read.schema(f"{schema}, batch string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch string")
