import math

import pytest
from pyspark.sql import functions as F

from textloom.operators import order


def visited(n, seed, sample):
    epoch, i = divmod(sample, n)
    a, b = order.epoch_parameters(n, seed, epoch)
    return (a * i + b) % n


@pytest.mark.parametrize("n", [1, 2, 12, 961])
def test_every_epoch_is_a_permutation(spark, n):
    df = spark.range(n).withColumnRenamed("id", "block")
    rows = order.epoch_permutation(df, "block", n, 7, range(0, 3)).collect()
    assert {(r.sample, r.block) for r in rows} == {(s, visited(n, 7, s)) for s in range(3 * n)}
    assert sorted(r.sample for r in rows) == list(range(3 * n))


def test_epochs_differ():
    first = [visited(12, 7, s) for s in range(12)]
    assert sorted(first) == list(range(12)) and first != [visited(12, 7, 12 + s) for s in range(12)]


def test_forward_and_backward_agree_beyond_64_bits(spark):
    n = 10_000_000_019
    indexes = [0, 1, n // 2, n - 1, 9_876_543_210]
    df = spark.createDataFrame([(i,) for i in indexes], "i long")
    ahead = df.select("i", order.permuted_index(F.col("i"), n, 3, 2).alias("block"))
    assert {r.i: r.block for r in ahead.collect()} == {i: visited(n, 3, 2 * n + i) for i in indexes}
    back = ahead.select("i", F.inline(order.position_in_epoch(F.col("block"), n, 3, range(2, 3))))
    assert all(r.i == r.position and r.epoch == 2 for r in back.collect())


def test_identity_without_shuffle(spark):
    rows = spark.range(5).select("id", order.permuted_index(F.col("id"), 5, 1, 0, False).alias("b"))
    assert all(r.id == r.b for r in rows.collect())


@pytest.mark.parametrize("start", [0, 4, 20, 1000])
def test_training_plan(spark, start):
    n, length, micro, rounds = 37, 8, 3, 2
    max_tokens = 8 * 6 * 25 - 5
    steps = math.ceil(max_tokens / (length * micro * rounds))
    df = spark.range(n).withColumnRenamed("id", "block")
    plan = order.training_plan(df, "block", n, 11, max_tokens, length, micro, rounds, start)
    expected = {
        (s // 6, s % 6 // 3, s % 3, visited(n, 11, s)) for s in range(start * 6, steps * 6)
    }
    assert {(r.step, r["round"], r.slot, r.block) for r in plan.collect()} == expected


@pytest.mark.parametrize("n,batches,size", [(10, 2, 4), (10, 99, 4), (3, 99, 8), (8, 99, 4)])
def test_eval_plan_wraps_around(spark, n, batches, size):
    df = spark.range(n).withColumnRenamed("id", "block")
    used = min(batches, math.ceil(n / size))
    expected = {(s // size, s % size, s % n) for s in range(used * size)}
    rows = order.eval_plan(df, "block", n, batches, size).collect()
    assert {(r.batch, r.slot, r.block) for r in rows} == expected and len(rows) == used * size


def test_written_plan_is_in_step_order(spark, tmp_path):
    df = spark.range(50).withColumnRenamed("id", "block")
    plan = order.training_plan(df, "block", 50, 1, 50 * 8, 8, 2, 1)
    order.write_training_plan(plan, str(tmp_path / "plan"), 3)
    assert spark.read.parquet(str(tmp_path / "plan")).count() == 50


def test_many_epochs(spark):
    df = spark.range(5).withColumnRenamed("id", "block")
    rows = order.epoch_permutation(df, "block", 5, 3, range(0, 10_000))
    assert rows.count() == 50_000
    picked = rows.filter("epoch = 9999").collect()
    assert {(r.sample, r.block) for r in picked} == {(s, visited(5, 3, s)) for s in range(49_995, 50_000)}
