"""Writing token shards and normalized collections."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.arith import whole_div
from textloom.functions.tokens import token_count

# Rows of one shard that go to one output task, so that a hot shard is written by many.
ROWS_PER_TASK = 100_000
PUBLISHED = "version string, details string, counts array<struct<collection:string,split:string,rows:bigint>>"


def token_sink(
    tokens: DataFrame,
    path: str,
    split: str,
    shard: str,
    row: str,
    packed: str = "tokens",
    shards_are_files: bool = False,
) -> None:
    """Parquet data set partitioned by split, sorted by shard and row inside a file; the commit
    protocol publishes it whole. Shards are a column, so their number and names do not matter.

    Rows meet by ``(split, shard, block of rows)``: a shard is in few files, and none of the writers
    holds a whole hot shard. As a rebalance, adaptive execution also splits what is still too large
    for a file and joins what is too small. Where a shard is an input file, a task has the rows of few shards as it
    is, and ``shards_are_files`` writes without a shuffle.
    """
    rows = tokens.select(split, shard, row, token_count(F.col(packed)).alias("n_tokens"), packed)
    if not shards_are_files:
        rows = rows.withColumn("_block", whole_div(F.col(row), ROWS_PER_TASK))
        rows = rows.hint("rebalance", split, shard, "_block").drop("_block")
        rows = rows.sortWithinPartitions(split, shard, row)
    rows.write.mode("overwrite").partitionBy(split).parquet(path)


def normalized_sink(collections: dict[str, DataFrame], path: str) -> None:
    """All collections in one data set, partitioned by collection and split.

    Collections may differ in columns; a column that one of them lacks is null there.
    """
    union = None
    for name, frame in collections.items():
        named = frame.withColumn("collection", F.lit(name))
        union = named if union is None else union.unionByName(named, allowMissingColumns=True)
    union.write.mode("overwrite").partitionBy("collection", "split").parquet(path)


def publish_collections(
    collections: dict[str, DataFrame], path: str, details: dict[str, object]
) -> str:
    """Write all collections as a new version below ``path``; returns its name.

    The data go to a folder of their own. One manifest row (``details`` such as seed and requested
    rows, and the rows of each collection and split, counted in what was written) is the last write and
    makes the version the current one, so a run that breaks off leaves the previous version as it was.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    data = f"{path}/versions/{version}"
    normalized_sink(collections, data)
    spark = next(iter(collections.values())).sparkSession
    rows = spark.read.parquet(data).groupBy("collection", "split").agg(F.count("*").alias("rows"))
    # One row for each collection and split.
    entry = rows.agg(F.sort_array(F.collect_list(F.struct("collection", "split", "rows"))).alias("counts"))
    entry.select(
        F.lit(version).alias("version"), F.lit(json.dumps(details, sort_keys=True)).alias("details"), "counts"
    ).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def manifest_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest of every version, or None where nothing was published."""
    try:
        return spark.read.schema(PUBLISHED).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def published(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The collections of a version, the last one by default."""
    if version is None:
        log = manifest_rows(spark, path)
        last = log.agg(F.max("version").alias("v")).first().v if log is not None else None
        if last is None:
            raise FileNotFoundError(f"nothing was published below {path}")
        version = last
    return spark.read.parquet(f"{path}/versions/{version}")
