from pyspark.sql import functions as F

from textloom.operators import manifest

HASH = "tok"


def audit(spark, head, shards, files, expected=HASH):
    manifests = spark.createDataFrame(
        [head], "manifest string, dtype string, byte_order string, tokenizer_sha256 string, total_tokens long"
    )
    listed = spark.createDataFrame(shards, "manifest string, path string, tokens long")
    present = spark.createDataFrame(files, "path string, bytes long")
    row = manifest.manifest_audit(manifests, listed, present, expected).first()
    return row.passed, row.reason


def test_audit_rules(spark):
    good = ("m", "uint16", "little", HASH, 2)
    shard, file = [("m", "a", 2)], [("a", 4)]
    assert audit(spark, good, shard, file) == (True, "ok")
    assert audit(spark, good, shard, file, "wrong") == (False, "tokenizer")
    assert audit(spark, good, shard, [("a", 2)]) == (False, "file_size")
    assert audit(spark, good, shard, [("b", 4)]) == (False, "missing_file")
    assert audit(spark, ("m", "int32", "little", HASH, 2), shard, file) == (False, "format")
    assert audit(spark, ("m", "uint16", None, HASH, 2), shard, file) == (False, "format")
    assert audit(spark, ("m", "uint16", "little", None, 2), shard, file) == (False, "tokenizer")
    assert audit(spark, ("m", "uint16", "little", HASH, 3), shard, file) == (False, "total")
    assert audit(spark, ("m", "uint16", "little", HASH, None), shard, file) == (False, "total")
    assert audit(spark, good, [("other", "a", 2)], file) == (False, "no_shards")


def test_stats_and_manifest(spark):
    rows = [("a", True, False, 5), ("a", True, True, 7), ("a", False, True, 100), ("b", False, None, None), ("c", True, False, 2)]
    df = spark.createDataFrame(rows, "shard string, u boolean, v boolean, t long")
    stats = manifest.shard_build_stats(df, "shard", F.col("u"), F.col("v"), F.col("t"))
    assert {tuple(r) for r in stats.collect()} == {
        ("a", 5, 7, 2, 1),
        ("b", 0, 0, 0, 1),
        ("c", 2, 0, 1, 0),
    }
    found = {tuple(r) for r in manifest.split_manifest(stats, "shard").collect()}
    assert found == {
        ("shard", "train", "a", 5, 1),
        ("shard", "train", "c", 2, 1),
        ("shard", "validation", "a", 7, 1),
        ("split", "train", None, 7, 2),
        ("split", "validation", None, 7, 1),
        ("all", None, None, 14, 3),
    }


def test_upsert(spark):
    schema = "key string, a int, b string"
    old = spark.createDataFrame([("x", 1, "old"), ("y", 2, "old")], schema)
    new = spark.createDataFrame([("y", None, "new"), ("z", 3, "new")], schema)
    assert {tuple(r) for r in manifest.manifest_upsert(old, new, "key").collect()} == {
        ("x", 1, "old"),
        ("y", None, "new"),
        ("z", 3, "new"),
    }


def test_only_unchanged_shards_with_intact_outputs_are_reused(spark):
    listing = spark.createDataFrame(
        [(f"f{i}", 10 + i, 100 + i) for i in range(5)], "path string, bytes long, modified long"
    )
    prints = manifest.fingerprints(listing, HASH, 0.001, 64, 1_000_000)
    meta = prints.select(
        "*",
        F.concat("source", F.lit(".t")).alias("train_path"),
        F.concat("source", F.lit(".v")).alias("validation_path"),
        F.lit(3).cast("long").alias("train_tokens"),
        F.lit(0).cast("long").alias("validation_tokens"),
    ).filter("source <> 'f4'")
    meta = meta.withColumn(
        "source_mtime", F.col("source_mtime") + F.when(F.col("source") == "f1", 1).otherwise(0)
    )
    outputs = spark.createDataFrame(
        [(f"f{i}.t", 5 if i == 2 else 6) for i in range(5)] + [(f"f{i}.v", 0) for i in (0, 1, 2, 4)],
        "path string, bytes long",
    )
    todo = manifest.pending_shards(prints, meta, outputs)
    done = manifest.cached_shards(prints, meta, outputs)
    assert {r.source for r in todo.collect()} == {"f1", "f2", "f3", "f4"}
    assert {r.source for r in done.collect()} == {"f0"}
    other = manifest.fingerprints(listing, HASH, 0.001, 64, 5)
    assert manifest.cached_shards(other, meta, outputs).count() == 0
