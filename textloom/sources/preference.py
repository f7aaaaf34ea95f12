"""Finding and reading scored preference data in JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.corpus import file_listing, file_name

# The two response columns have an older spelling without the underscore.
PREFERENCE_SCHEMA = (
    "prompt string, response_1 string, response_2 string, response1 string, response2 string, "
    "preference_strength string, split string"
)


def preference_file(spark: SparkSession, root: str) -> str:
    """First non-empty ``preference*.jsonl*`` in path order, else any ``*.jsonl*`` whose path says
    ``preference``; nothing below a ``.cache…`` folder.

    A folder written by Spark whose name has ``.jsonl`` in it counts as one file.
    """
    parts = F.split("path", "/")
    parent, last = F.element_at(parts, -2), file_name(F.col("path"))
    in_dataset = F.contains(parent, F.lit(".jsonl"))
    files = (
        file_listing(spark, root, "*.json*")
        .filter((F.col("bytes") > 0) & ~F.col("path").rlike(r"/\.cache[^/]*/"))
        .filter(in_dataset | F.contains(last, F.lit(".jsonl")))
        .select(
            F.when(in_dataset, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.col("path")).alias("path"),
            F.when(in_dataset, parent).otherwise(last).alias("name"),
        )
    )
    named = F.startswith(F.col("name"), F.lit("preference"))
    found = (
        files.filter(named | F.contains(F.col("path"), F.lit("preference")))
        .select("path", (~named).alias("second_choice"))
        .orderBy("second_choice", "path")
        .first()
    )
    if found is None:
        raise FileNotFoundError(f"no preference JSON lines below {root}")
    return found.path


def require_fields(spark: SparkSession, path: str, names: list[str]) -> None:
    """Raise for fields that no record has. The scan itself has a fixed schema, in which an absent
    field would only show as null."""
    keys = spark.read.text(path).select(F.json_object_keys("value").alias("keys"))
    has = [F.bool_or(F.array_contains("keys", name)).alias(name) for name in names]
    found = keys.agg(*has).first().asDict()
    missing = sorted(name for name, there in found.items() if not there)
    if missing:
        raise ValueError(f"missing columns {missing}")


def whole_number(value: Column) -> Column:
    """An integer from JSON text such as ``2``, ``2.0`` or ``"2"``; anything else fails the job, so
    that no row is lost to a null."""
    number = value.try_cast("double")
    fine = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 2**31)
    text = F.concat(F.lit("preference strength is not an integer: "), F.coalesce(value, F.lit("null")))
    return F.when(fine, number.cast("int")).otherwise(F.raise_error(text).cast("int"))


def preference_scan(
    spark: SparkSession, path: str, partitions: int | None = None, schema: str = PREFERENCE_SCHEMA
) -> DataFrame:
    """Read JSON lines. A gzip file arrives in one task, so it is spread out right after.

    A line that is not JSON, or a strength that is not an integer, fails the job.
    """
    frame = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if path.endswith(".gz"):
        frame = frame.repartition(partitions or spark.sparkContext.defaultParallelism)
    return frame.withColumn("preference_strength", whole_number(F.col("preference_strength")))
