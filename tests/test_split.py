import hashlib

import pytest
from pyspark.sql import functions as F

from textloom.functions import hashing
from textloom.operators import split


def brute(keys, seed, rows, divisor=100):
    size = min(rows, max(1, len(keys) // divisor))
    order = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))
    return set(order[:size])


@pytest.mark.parametrize("n,rows", [(1, 2000), (50, 2000), (5000, 2000), (5000, 20), (30000, 60000)])
def test_exact_split(spark, n, rows):
    df = spark.range(n).repartition(5)
    done = split.exact_split(df, "id", 42, rows, 10).collect()
    assert len(done) == n
    assert {r.id for r in done if r.split == "validation"} == brute(range(n), 42, rows, 10)


def test_empty_input(spark):
    assert split.exact_split(spark.range(0), "id", 1, 10).count() == 0


def test_hash_split_is_by_content(spark):
    df = spark.createDataFrame([(i, f"text {i % 500}") for i in range(1000)], "i int, text string")
    done = split.hash_split(df, "text", 0.09).groupBy("text").agg(F.count_distinct("split").alias("n"))
    assert done.filter("n > 1").count() == 0
    share = split.hash_split(df, "text", 0.09).filter("split = 'validation'").count() / 1000
    assert 0.03 < share < 0.16
    for fraction in (0.0, 0.1, 0.5):
        with pytest.raises(ValueError):
            split.hash_split(df, "text", fraction)


def test_blake2b_address(spark):
    texts = ["", "a", "é" * 20_000, "é" * 20_001, "x" * 16_384, "x" * 16_385, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = [
        r.v
        for r in df.select("i", hashing.unit_interval(F.col("text"), "blake2b").alias("v")).orderBy("i").collect()
    ]
    assert found.pop() is None
    for t, v in zip(texts, found):
        state = hashlib.blake2b(t[:16_384].encode(), digest_size=8)
        state.update(b"%d" % len(t))
        assert v == int(state.digest()[::-1].hex(), 16) / 2**64


def frame(spark, sources):
    return spark.createDataFrame(list(enumerate(sources)), "i int, source_split string")


def test_source_split(spark):
    df = frame(spark, ["train", "validation", "test", None, "other"])
    done = {r.i: r.split for r in split.source_split(df, "i", 1, 10).collect()}
    assert done == {0: "train", 1: "validation", 2: "validation", 3: "train"}


def test_source_split_falls_back_on_all_rows(spark):
    df = frame(spark, ["train"] * 30 + ["other"] * 10)
    done = split.source_split(df, "i", 1, 100).collect()
    assert len(done) == 40
    assert sum(r.split == "validation" for r in done) == 4


def test_evaluation_subset(spark):
    done = split.evaluation_subset(spark.range(5000).repartition(7), "id", 128).collect()
    assert [r.id for r in done] == list(range(128))
