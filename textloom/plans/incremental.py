"""A token corpus that follows its source files: incremental builds, snapshots, compaction, audit.

Below ``output``:

* ``tokens/run=<id>/split=<name>``: rows of one build run; only ever added as a whole.
* ``snapshots/<id>``: the live build of every source file, one row each, with the run that holds it.
* ``log``: one row for each committed snapshot. That row is the last write of a change, and the only
  thing that makes the rest count: a job that breaks off leaves files behind that nobody reads.

A change builds on the snapshot it has read. If two jobs commit the same version, the one whose
snapshot id is smaller wins, for every reader; the other one fails with :class:`LostRace` and may run
again. Readers name a version, or get the last one, and keep seeing it while later ones are written.

The driver holds numbers, and the paths of one run: at most about ``files_per_run`` of them. More
files are built in several runs, each of which is committed, so a long build that dies goes on where it
stopped.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import has_min_chars
from textloom.functions.tokens import TOKEN_BYTES, token_count
from textloom.functions.vocabulary import BpeModel
from textloom.operators.encode import MAX_CHUNK_CHARS, encode_documents
from textloom.operators.manifest import (
    BYTE_ORDER,
    DTYPE,
    FINGERPRINT,
    fingerprints,
    intact_metadata,
    manifest_audit,
    split_manifest,
)
from textloom.operators.split import hash_split
from textloom.session import materialize
from textloom.sources.corpus import file_listing, read_files, require_text, spread

FILES_PER_RUN = 10_000
SPLITS = ("train", "validation")
BUILD = (*FINGERPRINT, "run", "train_tokens", "validation_tokens", "documents", "skipped_documents")
LOG = "version long, snapshot string, committed long"


class LostRace(RuntimeError):
    """Another job has committed the version that this one was to become."""


@dataclass
class Snapshot:
    """A committed state: its version, and the live build of every source file."""

    version: int
    name: str
    builds: DataFrame


def _new_id() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def _log(spark: SparkSession, output: str) -> DataFrame | None:
    try:
        return spark.read.schema(LOG).parquet(f"{output}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def snapshot(spark: SparkSession, output: str, version: int | None = None) -> Snapshot | None:
    """The last committed snapshot, or the given version; None where nothing was committed."""
    log = _log(spark, output)
    if log is None:
        return None
    if version is not None:
        log = log.filter(F.col("version") == version)
    found = log.orderBy(F.desc("version"), "snapshot").first()
    if found is None:
        return None
    builds = spark.read.parquet(f"{output}/snapshots/{found.snapshot}")
    return Snapshot(found.version, found.snapshot, builds)


def _commit(spark: SparkSession, output: str, builds: DataFrame, before: Snapshot | None) -> Snapshot:
    """Writes the builds, then the row that makes them the next version."""
    version = (before.version if before else 0) + 1
    name = _new_id()
    builds.select(*BUILD).write.parquet(f"{output}/snapshots/{name}")
    entry = spark.createDataFrame([(version, name, time.time_ns() // 1000)], LOG)
    entry.coalesce(1).write.mode("append").parquet(f"{output}/log")
    now = snapshot(spark, output, version)
    if now.name != name:
        raise LostRace(f"version {version} was committed by another job")
    return now


def _tokens(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(
        "shard string, row_index long, n_tokens long, tokens binary, run string, split string"
    ).parquet(f"{output}/tokens")


def _with_paths(builds: DataFrame) -> DataFrame:
    paths = {f"{s}_path": F.concat_ws("/", "run", F.lit(s), "source") for s in SPLITS}
    return builds.withColumns(paths)


def _stored_sides(builds: DataFrame, tokens: DataFrame) -> DataFrame:
    """``path, bytes`` of either side of every build, counted in the stored rows of its run."""
    live = builds.select("run", F.col("source").alias("shard"))
    sides = live.withColumn("split", F.explode(F.array(*[F.lit(s) for s in SPLITS])))
    sums = tokens.groupBy("run", "shard", "split").agg(F.sum("n_tokens").alias("_n"))
    held = sides.join(sums, ["run", "shard", "split"], "left")
    return held.select(
        F.concat_ws("/", "run", "split", "shard").alias("path"),
        (F.coalesce("_n", F.lit(0)) * TOKEN_BYTES).alias("bytes"),
    )


def _built(
    spark: SparkSession,
    paths: list[str],
    prints: DataFrame,
    model: BpeModel,
    output: str,
    fraction: float,
    min_chars: int,
    max_chunk_chars: int,
    method: str,
) -> DataFrame:
    """Writes the tokens of some files as one run; the builds of these files."""
    run = _new_id()
    docs = read_files(spark, paths)
    usable = spread(docs).filter(has_min_chars("text", min_chars))
    encoded = encode_documents(
        hash_split(usable, "text", fraction, method), "text", model, chunk_chars=max_chunk_chars
    )
    encoded.select(
        F.lit(run).alias("run"),
        "split",
        "shard",
        "row_index",
        token_count(F.col("tokens")).alias("n_tokens"),
        "tokens",
    ).write.mode("append").partitionBy("run", "split").parquet(f"{output}/tokens")

    # Empty where no document of the run was long enough.
    rows = docs.groupBy("shard").agg(F.count("*").alias("_rows"))
    counted = prints.join(rows.withColumnRenamed("shard", "source"), "source", "left")
    try:
        written = _tokens(spark, output).filter(F.col("run") == run)
    except AnalysisException:
        written = spark.createDataFrame([], "shard string, n_tokens long, split string")
    sums = written.groupBy(F.col("shard").alias("source")).agg(
        *[
            F.sum(F.when(F.col("split") == s, F.col("n_tokens")).otherwise(0)).alias(f"{s}_tokens")
            for s in SPLITS
        ],
        F.count("*").alias("documents"),
    )
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return counted.join(sums, "source", "left").select(
        *FINGERPRINT,
        F.lit(run).alias("run"),
        *[number(f"{s}_tokens").alias(f"{s}_tokens") for s in SPLITS],
        number("documents").alias("documents"),
        (number("_rows") - number("documents")).alias("skipped_documents"),
    )


def prepare_incremental(
    spark: SparkSession,
    root: str,
    model: BpeModel,
    output: str,
    fraction: float = 0.001,
    min_chars: int = 64,
    max_chunk_chars: int = MAX_CHUNK_CHARS,
    method: str = "blake2b",
    files_per_run: int = FILES_PER_RUN,
) -> Snapshot | None:
    """Bring the corpus up to the files below ``root``; returns the snapshot that holds then.

    A file is left alone while its fingerprint is the same and its stored tokens add up. New and
    changed files are built, files that are gone leave the snapshot; where nothing changed, nothing is
    committed. A file without a ``text`` column is an error, found before anything is built.
    """
    listing = materialize(file_listing(spark, root), "listing")
    prints = fingerprints(
        listing.select(F.col("shard").alias("path"), "bytes", "modified"),
        model.sha256(),
        fraction,
        min_chars,
        max_chunk_chars,
        method,
    )
    now = snapshot(spark, output)
    todo = prints
    if now is not None:
        held = _with_paths(now.builds)
        good = intact_metadata(held, _stored_sides(now.builds, _tokens(spark, output)))
        todo = prints.join(good.select(*FINGERPRINT), list(FINGERPRINT), "left_anti")
    files = listing.select("path", F.col("shard").alias("source"))
    todo = materialize(todo.join(files, "source"), "pending")
    changed = todo.count()
    require_text(todo.select("path"))

    runs = -(-changed // files_per_run)
    part = F.pmod(F.xxhash64("source"), F.lit(max(runs, 1)))
    for nth in range(runs):
        mine = todo.filter(part == nth)
        paths = sorted(r.path for r in mine.select("path").collect())
        if not paths:
            continue
        new = _built(
            spark, paths, mine.drop("path"), model, output, fraction, min_chars, max_chunk_chars, method
        )
        if now is not None:
            kept = now.builds.join(mine.select("source"), "source", "left_anti")
            kept = kept.join(files.select("source"), "source", "left_semi")
            new = new.unionByName(kept.select(*BUILD))
        now = _commit(spark, output, new, now)
    if now is not None and not changed:
        present = now.builds.join(files.select("source"), "source", "left_semi")
        if present.count() < now.builds.count():
            now = _commit(spark, output, present, now)
    return now


def live_tokens(spark: SparkSession, output: str, version: int | None = None) -> DataFrame:
    """The stored rows of a snapshot."""
    live = snapshot(spark, output, version).builds.select(F.col("source").alias("shard"), "run")
    return _tokens(spark, output).join(live, ["shard", "run"], "left_semi")


def live_manifest(spark: SparkSession, output: str, version: int | None = None) -> DataFrame:
    """:func:`split_manifest` of a snapshot."""
    return split_manifest(snapshot(spark, output, version).builds, "source")


def audit_snapshot(
    spark: SparkSession, output: str, tokenizer_sha256: str, version: int | None = None
) -> DataFrame:
    """:func:`manifest_audit` of both splits of a snapshot, against the bytes that are stored."""
    builds = _with_paths(snapshot(spark, output, version).builds)
    shards = builds.select(
        "tokenizer_sha256",
        F.expr(
            "stack(2, 'train', train_path, train_tokens, "
            "'validation', validation_path, validation_tokens) as (manifest, path, tokens)"
        ),
    ).filter(F.col("tokens") > 0)
    manifests = shards.groupBy("manifest").agg(
        F.lit(DTYPE).alias("dtype"),
        F.lit(BYTE_ORDER).alias("byte_order"),
        # Null, and so a mismatch, when the shards come from different tokenizers.
        F.when(
            F.min("tokenizer_sha256") == F.max("tokenizer_sha256"), F.min("tokenizer_sha256")
        ).alias("tokenizer_sha256"),
        F.sum("tokens").cast("bigint").alias("total_tokens"),
    )
    stored = live_tokens(spark, output, version).groupBy(
        F.concat_ws("/", "run", "split", "shard").alias("path")
    )
    files = stored.agg(F.sum(F.octet_length("tokens")).cast("bigint").alias("bytes"))
    return manifest_audit(manifests, shards.drop("tokenizer_sha256"), files, tokenizer_sha256)


def compact(spark: SparkSession, output: str, dead_share: float = 0.2) -> Snapshot:
    """Rewrites the live rows of runs of which more than ``dead_share`` of the tokens are superseded.

    The new snapshot has the same builds with their tokens in one new run; older snapshots stay
    readable until :func:`vacuum` takes their runs. Nothing is committed where no run is that dead.
    """
    now = snapshot(spark, output)
    held = _tokens(spark, output).groupBy("run").agg(F.sum("n_tokens").alias("_held"))
    live = now.builds.groupBy("run").agg(F.sum(F.expr("train_tokens + validation_tokens")).alias("_live"))
    dead = live.join(held, "run").filter(F.col("_held") - F.col("_live") > F.col("_held") * dead_share)
    dead = materialize(dead.select("run"), "dead")
    if dead.isEmpty():
        return now
    run = _new_id()
    moved = live_tokens(spark, output).join(dead, "run", "left_semi")
    # Rows of a source meet again, whatever runs and files they were in; large ones are split.
    moved.select(F.lit(run).alias("run"), "split", "shard", "row_index", "n_tokens", "tokens").hint(
        "rebalance", "split", "shard"
    ).write.mode("append").partitionBy("run", "split").parquet(f"{output}/tokens")
    marked = now.builds.join(dead.withColumn("_dead", F.lit(True)), "run", "left")
    builds = marked.withColumn("run", F.when(F.col("_dead"), F.lit(run)).otherwise(F.col("run")))
    return _commit(spark, output, builds, now)


def vacuum(spark: SparkSession, output: str, keep: int = 2) -> list[str]:
    """Removes runs that none of the last ``keep`` snapshots names; returns their ids.

    No other job may be writing: its run is in no snapshot yet. The driver sees one row for each run.
    """
    now = snapshot(spark, output)
    named: set[str] = set()
    for version in range(max(1, now.version - keep + 1), now.version + 1):
        builds = snapshot(spark, output, version).builds
        named |= {r.run for r in builds.select("run").distinct().collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(f"{output}/tokens")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("run=") and name.removeprefix("run=") not in named:
            files.delete(status.getPath(), True)
            gone.append(name.removeprefix("run="))
    return sorted(gone)
