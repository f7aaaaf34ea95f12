"""Incremental preparation of files that arrive in a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions.text import has_min_chars
from textloom.functions.tokens import token_count
from textloom.functions.vocabulary import BpeModel
from textloom.operators.encode import encode_documents
from textloom.operators.split import hash_split
from textloom.streaming.sinks import read_batches, run_batches

COUNTS = "shard string, split string, documents long, tokens long"


def prepared_stream(
    spark: SparkSession,
    source: str,
    schema: str,
    fraction: float,
    model: BpeModel | None = None,
    text: str = "text",
    min_chars: int = 64,
    method: str = "blake2b",
    pattern: str = "*.parquet",
    files_per_batch: int = 1000,
) -> DataFrame:
    """Filter, split and (with a model) encode; stateless, so no watermark is needed.

    A micro-batch of few files is few splits, so its rows are spread over all cores before they are
    encoded.
    """
    stream = (
        spark.readStream.schema(schema)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
    )
    usable = hash_split(stream.filter(has_min_chars(text, min_chars)), text, fraction, method)
    if model is None:
        return usable
    return encode_documents(usable.repartition(spark.sparkContext.defaultParallelism), text, model)


def run_available(
    stream: DataFrame, output: str, checkpoint: str, partition: str | None = "split"
) -> StreamingQuery:
    """Process everything that has arrived since the last run and stop.

    The checkpoint remembers the files, so a file is prepared once however often this runs.
    """
    writer = (
        stream.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    query = (writer.partitionBy(partition) if partition else writer).start()
    query.awaitTermination()
    return query


def prepare_available(
    stream: DataFrame, output: str, checkpoint: str, shard: str, row: str
) -> StreamingQuery:
    """Process what has arrived: token rows and their manifest, a folder each for every micro-batch.

    ``stream`` is a :func:`prepared_stream` with a model. A batch writes its tokens, counts what is
    stored, and then writes its part of the manifest. Run again after a failure, it replaces both by
    the same, so nothing is counted twice, and tokens without a manifest part are not counted at all.
    """

    def write(batch: DataFrame, name: str) -> None:
        rows = batch.select(
            F.col(shard).alias("shard"),
            F.col(row).cast("bigint").alias("row"),
            "split",
            token_count(F.col("tokens")).alias("n_tokens"),
            "tokens",
        )
        rows.write.mode("overwrite").parquet(f"{output}/tokens/batch={name}")
        stored = batch.sparkSession.read.schema(rows.schema).parquet(f"{output}/tokens/batch={name}")
        counts = stored.groupBy("shard", "split").agg(
            F.count("*").alias("documents"), F.sum("n_tokens").cast("bigint").alias("tokens")
        )
        counts.write.mode("overwrite").parquet(f"{output}/manifest/batch={name}")

    return run_batches(stream, checkpoint, write)


def stream_counts(spark: SparkSession, output: str) -> DataFrame:
    """``shard, split, documents, tokens`` over all batches that are done."""
    parts = read_batches(spark, f"{output}/manifest", COUNTS)
    return parts.groupBy("shard", "split").agg(
        F.sum("documents").cast("bigint").alias("documents"),
        F.sum("tokens").cast("bigint").alias("tokens"),
    )


def stream_tokens(spark: SparkSession, output: str) -> DataFrame:
    """Token rows of all batches that are done."""
    schema = "shard string, row long, split string, n_tokens long, tokens binary"
    done = read_batches(spark, f"{output}/manifest", COUNTS).select("batch").distinct()
    return read_batches(spark, f"{output}/tokens", schema).join(done, "batch", "left_semi")
