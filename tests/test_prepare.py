import hashlib
import os
import random

from pyspark.sql import functions as F

from textloom.functions.tokens import unpack_ids
from textloom.functions.vocabulary import BpeModel, ID_OF_BYTE
from textloom.operators import packing
from textloom.plans import prepare
from textloom.streaming.prepare import (
    prepare_available,
    prepared_stream,
    run_available,
    stream_counts,
    stream_tokens,
)
from textloom.streaming.rollup import rolled_windows, rollup_available, stream_interval_rollup
from textloom.operators import logs

LONG = "some text that is long enough to be kept by the filter, in every case: "


def documents(spark, n=400):
    generator = random.Random(1)
    rows = [
        ("hot" if i % 3 else f"s{i % 4}", i, LONG + str(generator.random()) if i % 7 else "short")
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "shard string, row long, text string").repartition(3)


def held(text, fraction):
    digest = hashlib.md5((text + str(len(text))).encode()).hexdigest()
    return int(digest[:13], 16) / 2**52 < fraction


def test_prepare_corpus(spark, tmp_path):
    rows, df = documents(spark)
    done = prepare.prepare_corpus(df, "shard", "row", "text", BpeModel(), str(tmp_path / "t"), 0.09, method="md5")
    want = {}
    for shard, row, text in rows:
        if len(text) >= 64:
            ids = [0] + [ID_OF_BYTE[b] for b in text.encode()] + [1]
            want[shard, row] = ("validation" if held(text, 0.09) else "train", ids)
    found = done.tokens.withColumn("ids", unpack_ids(F.col("tokens"))).collect()
    assert {(r.shard, r.row): (r.split, r.ids) for r in found} == want
    assert all(r.n_tokens * 2 == len(r.tokens) for r in found)
    stats = {r.shard: r for r in done.stats.collect()}
    for shard in {s for s, _, _ in rows}:
        mine = [v for (s, _), v in want.items() if s == shard]
        assert stats[shard].documents == len(mine)
        assert stats[shard].skipped_documents == sum(s == shard for s, _, _ in rows) - len(mine)
        assert stats[shard].validation_tokens == sum(len(i) for v, i in mine if v == "validation")
    total = done.manifest.filter("level = 'all'").first().tokens
    assert total == sum(len(i) for _, i in want.values())

    train = done.tokens.filter("split = 'train'")
    blocks = packing.pack_blocks(train, "shard", "row", "tokens", 64, "n_tokens")
    stream = {}
    for (shard, _), (split, ids) in sorted(want.items()):
        if split == "train":
            stream.setdefault(shard, []).extend(ids)
    expected = {
        (s, b): ids[b * 64 : b * 64 + 64] for s, ids in stream.items() for b in range(len(ids) // 64)
    }
    rows = blocks.withColumn("ids", unpack_ids(F.col("tokens"))).collect()
    assert {(r.shard, r.block): r.ids for r in rows} == expected


def test_flagship_equals_written_corpus_on_bytes(spark):
    _, df = documents(spark)
    manifest = prepare.pretoken_manifest(df, "shard", "text", 0.09)
    assert manifest.filter("level = 'all'").count() == 1


def test_stream_prepares_every_file_once(spark, tmp_path):
    rows, df = documents(spark)
    landing, out, mark = (str(tmp_path / p) for p in ("in", "out", "mark"))
    df.filter("row < 200").write.parquet(landing + "/one")

    def run():
        stream = prepared_stream(
            spark, landing, "shard string, row long, text string", 0.09, BpeModel(), files_per_batch=2
        )
        run_available(stream, out, mark)
        return sorted(r.row for r in spark.read.parquet(out).collect())

    kept = lambda n: [r for _, r, t in rows[:n] if len(t) >= 64]
    assert run() == kept(200)
    assert run() == kept(200)
    df.filter("row >= 200").write.parquet(landing + "/two")
    assert run() == kept(400)


def test_stream_rollup_equals_batch(spark, tmp_path):
    # A log that was resumed: steps 15 to 20 are there twice.
    steps = [*range(1, 21), *range(15, 58)]
    log = [(s, float(s % 7), 100 + i) for i, s in enumerate(steps)]
    frame = spark.createDataFrame(log, "step long, loss double, t long").withColumn(
        "t", F.timestamp_seconds("t")
    )
    for start in (0, 5, 10):
        source, mark = str(tmp_path / f"log{start}"), str(tmp_path / f"mark{start}")
        for part in ("step <= 13", "step > 13 AND step <= 33", "step > 33"):
            frame.filter(part).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema("step long, loss double, t timestamp").option("maxFilesPerTrigger", 1).json(source)
        query = (
            stream_interval_rollup(stream, "step", "loss", "t", 10, 4, start)
            .writeStream.format("memory").queryName(f"rolled{start}").outputMode("append")
            .option("checkpointLocation", mark).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        got = {tuple(r) for r in spark.table(f"rolled{start}").collect()}
        batch = logs.interval_rollup(frame, "step", "loss", "t", 10, 4, start)
        assert got == {tuple(r) for r in batch.collect()}
        assert {r[0] for r in got} == {s for s in (1, 10, 20, 30, 40, 50) if s > start}


def test_stream_batches_are_idempotent(spark, tmp_path):
    rows, df = documents(spark)
    landing, out, mark = (str(tmp_path / p) for p in ("in", "out", "mark"))
    schema = "shard string, row long, text string"

    def run():
        stream = prepared_stream(spark, landing, schema, 0.09, BpeModel(), files_per_batch=1)
        prepare_available(stream, out, mark, "shard", "row")
        counts = stream_counts(spark, out)
        stored = stream_tokens(spark, out).agg(F.sum("n_tokens"), F.count("*")).first()
        total = counts.agg(F.sum("tokens"), F.sum("documents")).first()
        assert tuple(stored) == tuple(total)
        return tuple(total)

    want = lambda n: (
        sum(len(t.encode()) + 2 for _, _, t in rows[:n] if len(t) >= 64),
        sum(len(t) >= 64 for _, _, t in rows[:n]),
    )
    df.filter("row < 200").repartition(2).write.parquet(landing + "/one")
    assert run() == want(200) and run() == want(200)
    df.filter("row >= 200").repartition(2).write.parquet(landing + "/two")
    assert run() == want(400)
    # The last batch runs again, as after a crash before its commit was noted.
    commits = sorted(int(n) for n in os.listdir(mark + "/commits") if n.isdigit())
    for name in (f"{commits[-1]}", f".{commits[-1]}.crc"):
        os.remove(f"{mark}/commits/{name}")
    assert run() == want(400)


def test_log_in_any_order_equals_batch(spark, tmp_path):
    steps = [*range(1, 21), *range(15, 58)]
    log = [(s, float(s % 7), 100 + i) for i, s in enumerate(steps)]
    random.Random(3).shuffle(log)
    schema = "step long, loss double, t long"
    frame = spark.createDataFrame(log, schema).withColumn("t", F.timestamp_seconds("t"))
    for start in (0, 10):
        source, mark, out = (str(tmp_path / f"{n}{start}") for n in ("log", "mark", "out"))
        for i in range(4):
            part = spark.createDataFrame(log[i::4], schema).withColumn("t", F.timestamp_seconds("t"))
            part.coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema("step long, loss double, t timestamp").option("maxFilesPerTrigger", 1).json(source)
        for _ in range(2):
            rollup_available(stream, out, mark, "step", "loss", "t", 10, start)
        rolled = rolled_windows(spark, out, 10, 4)
        got = {tuple(r)[:-1] for r in rolled.collect()}
        batch = logs.interval_rollup(frame, "step", "loss", "t", 10, 4, start)
        rounded = lambda rows: {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows}
        assert rounded(got) == rounded(tuple(r) for r in batch.collect())
        late = rolled.agg(F.sum("late_steps")).first()[0]
        assert 0 < late < len(log)


def test_stream_spreads_a_batch_before_encoding(spark, tmp_path):
    spark.createDataFrame([("a",)], "text string").write.parquet(str(tmp_path / "in"))
    plans = [
        prepared_stream(spark, str(tmp_path / "in"), "text string", 0.09, model)._jdf.queryExecution().analyzed().toString()
        for model in (None, BpeModel())
    ]
    assert ["Repartition" in p for p in plans] == [False, True]
