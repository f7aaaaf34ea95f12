"""Session helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20
UNITS = {"": 0, "k": 1, "m": 2, "g": 3, "t": 4}


def build_session(
    app: str = "textloom", cpus: int = 8, memory: str = "16g", shared: str | None = None
) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own.

    ``shared`` is the folder for intermediate tables; a new temporary one by default.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(CHECKPOINT_KEY, shared or tempfile.mkdtemp(prefix="textloom-"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may do without that setting: there the driver and the tasks share one
    machine, and a temporary folder will do. Anywhere else executors would write to their own disks,
    so a missing setting is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY, None)
    configured = configured or context.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="textloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call uses."""
    return os.path.join(shared_dir(spark), "textloom-tables", f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage, survives the loss of executors, and lets later readers prune columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of about 2 MB from now on in this session; a lower setting stays.

    So a worker holds the same for a table of any size: by default a batch of 10,000 texts grows to
    64 MB, and what is made of it to several times that. The setting is read when a frame runs, later
    than the caller can tell, so it is not put back.
    """
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(BATCH_KEY).lower()).groups()
    most = int(number) << 10 * UNITS[unit]
    if most > BATCH_BYTES:
        spark.conf.set(BATCH_KEY, f"{BATCH_BYTES}b")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: keeps partition layout and cuts lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
