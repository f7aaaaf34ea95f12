import bisect
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions.tokens import pack_ids, token_count
from textloom.operators import logs, report, sketches


@pytest.mark.parametrize("n", [1, 2, 3, 100, 5001])
def test_percentiles_equal_numpy(spark, n):
    generator = random.Random(n)
    values = {
        "spread": [generator.uniform(-5, 50) for _ in range(n)],
        "ties": [generator.choice([1.0, 2.5, 2.5004]) for _ in range(n)],
        "one": [7.0] * n,
    }
    data = [(g, v) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(data, "g string, x double").repartition(4)
    found = {
        r.g: r
        for r in report.exact_percentiles(
            df, "g", F.col("x"), {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}
        ).collect()
    }
    for g, vs in values.items():
        want = np.percentile(vs, [0, 50, 90, 100])
        assert [found[g].p0, found[g].p50, found[g].p90, found[g].p100] == pytest.approx(list(want))


def test_sketch_is_close(spark):
    df = spark.range(10_000).select(F.lit("g").alias("g"), "id", F.lit(100).alias("c"))
    row = report.approximate_fertility(df, "g", F.col("id"), F.col("c")).first()
    assert row.fertility_p50 == pytest.approx(5000, abs=3)


def test_summary(spark):
    df = spark.createDataFrame(
        [("d", "ab cd", 3, 0, 0), ("d", "é" * 10, 3000, 2, 1)], "d string, t string, n int, u int, f int"
    )
    row = report.domain_summary(df, "d", "t", F.col("n"), F.col("u"), F.col("f")).first()
    assert (row.documents, row.characters, row.utf8_bytes, row.words, row.tokens) == (2, 15, 25, 3, 3003)
    assert row.tokens_per_100_characters == pytest.approx(3003 * 100 / 15)
    assert row.characters_per_context == pytest.approx(15 / 3003 * 2048)
    assert row.documents_over_context_percent == 50.0
    assert (row.unknown_tokens, row.roundtrip_failures) == (2, 1)


def test_coverage(spark):
    df = spark.createDataFrame([("d", [1, 2, 2]), ("d", [2, 9]), ("e", [1])], "d string, ids array<int>")
    packed = df.withColumn("p", pack_ids(F.col("ids")))
    rows = {r.d: r for r in report.vocab_coverage(packed, "d", "p", 10).collect()}
    assert rows["d"].observed_ids == 3 and rows["d"].observed_percent == 30.0
    assert rows["e"].observed_ids == 1


def test_paired_comparison(spark):
    a = spark.createDataFrame([(1, "d", 10, 4), (2, "d", 10, 5), (3, "d", 20, 6)], "k int, d string, chars int, tokens int")
    b = spark.createDataFrame([(1, 3), (2, 5), (3, 7)], "k int, tokens int")
    row = report.paired_compare(a, b, "k", "d").first()
    assert (row.a_wins, row.b_wins, row.ties) == (1, 1, 1)
    assert row.token_reduction_percent == 0.0 and row.context_gain_percent == pytest.approx(0.0)


def test_perplexity_is_capped(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 100.0)], "g string, loss double")
    rows = {r.g: r for r in report.eval_perplexity(df, F.col("loss"), "g").collect()}
    assert rows["a"].mean_loss == 2.0 and rows["a"].perplexity == pytest.approx(np.exp(2))
    assert rows["b"].perplexity == pytest.approx(np.exp(20))
    assert report.eval_perplexity(df, F.col("loss")).count() == 1


def rollup_by_hand(log, every, per_step, start):
    out, opened, losses = [], None, []
    times = {s: t for s, _, t in log}
    for step, loss, t in sorted(log):
        if step <= start:
            continue
        if opened is None:
            opened = times.get(start, t)
        losses.append(loss)
        if step == 1 or step % every == 0:
            elapsed = t - opened
            rate = len(losses) * per_step / elapsed if elapsed else None
            out.append((step, step * per_step, len(losses), sum(losses) / len(losses), elapsed, rate))
            opened, losses = t, []
    return out


@pytest.mark.parametrize("every", [1, 4, 10])
@pytest.mark.parametrize("start", [0, 1, 7, 20])
def test_rollup(spark, every, start):
    log = [(s, float(s % 5), 10 * s + s % 3) for s in range(1, 44)]
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(log, "step long, loss double, t long").withColumn(
            "t", F.timestamp_seconds("t").cast(kind)
        )
        rows = logs.interval_rollup(df, "step", "loss", "t", every, 8, start).orderBy("step").collect()
        expected = rollup_by_hand(log, every, 8, start)
        assert [tuple(r)[:3] for r in rows] == [e[:3] for e in expected]
        for row, want in zip(rows, expected):
            assert row.loss == pytest.approx(want[3])
            assert row.elapsed_seconds == pytest.approx(want[4])
            assert row.tokens_per_second == (None if want[5] is None else pytest.approx(want[5]))


def test_sketches_merge_within_their_bounds(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(6000):
        chars = rnd.randint(50, 400)
        tokens = [rnd.randrange(5000) for _ in range(rnd.randint(1, 40))]
        rows.append((f"d{i % 2}", None if i % 3 == 0 else f"s{i % 5}", chars, struct.pack(f"<{len(tokens)}H", *tokens)))
    df = spark.createDataFrame(rows, "domain string, shard string, chars int, tokens binary").repartition(6)
    n = token_count(F.col("tokens"))
    stored = sketches.shard_sketches(df, "domain", "shard", n, F.col("chars"), "tokens")
    assert stored.count() == len({r[:2] for r in rows})
    for domain, *rolled in sketches.rolled_up(stored, "domain").collect():
        own = [r for r in rows if r[0] == domain]
        values = sorted(len(r[3]) / 2 * 100 / r[2] for r in own)
        ids = {i for r in own for i in struct.unpack(f"<{len(r[3]) // 2}H", r[3])}
        documents, *quantiles, estimate = rolled
        assert documents == len(own)
        for q, value in zip(report.FERTILITY.values(), quantiles):
            assert bisect.bisect_left(values, value) / len(own) <= q + 2 * sketches.KLL_RANK_ERROR
            assert bisect.bisect_right(values, value) / len(own) >= q - 2 * sketches.KLL_RANK_ERROR
        assert abs(estimate - len(ids)) <= 4 * sketches.HLL_ERROR * len(ids)
