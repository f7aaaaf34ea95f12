import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import ranking


def data(seed):
    """One group holds most rows; positions have gaps."""
    generator = random.Random(seed)
    rows = []
    for group, n in (("hot", 1500), ("a", 40), ("b", 1), ("c", 333)):
        positions = generator.sample(range(4 * n + 5), n)
        rows += [(group, p, generator.randint(0, 9)) for p in positions]
    generator.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, p long, v long").repartition(6)


@pytest.mark.parametrize("width,fan_out", [(1, 2), (7, 3), (1024, 1024), (10_000, 2)])
def test_running_offsets(spark, width, fan_out):
    rows = data(width)
    found = ranking.running_offsets(
        frame(spark, rows), ["g"], ["p"], F.col("v"), ranking.row_bucket(F.col("p"), width), "s", fan_out
    ).collect()
    want, total = {}, {}
    for g, p, v in sorted(rows):
        want[g, p] = total.get(g, 0)
        total[g] = want[g, p] + v
    assert {(r.g, r.p): r.s for r in found} == want
    assert len(found) == len(rows)


@pytest.mark.parametrize("quota", [0, 1, 40, 700, 99_999])
def test_first_in_group(spark, quota):
    rows = data(quota)
    kinds = [quota, F.lit(quota), spark.createDataFrame([(g, quota) for g in ("hot", "a", "b", "c")], "g string, quota long")]
    want = {
        (g, p, k)
        for name in ("hot", "a", "b", "c")
        for k, (g, p, _) in enumerate(sorted(r for r in rows if r[0] == name)[:quota])
    }
    for kind in kinds:
        found = ranking.first_in_group(
            frame(spark, rows), ["g"], ["p"], ranking.row_bucket(F.col("p"), 16), kind, fan_out=4
        )
        assert {(r.g, r.p, r["rank"]) for r in found.collect()} == want


def test_global_offsets(spark):
    rows = [(f"name-{i:05d}", i % 7) for i in range(2000)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "name string, v long").repartition(5)
    found = ranking.global_offsets(df, "name", F.col("v"), "lo").collect()
    want, total = {}, 0
    for name, v in sorted(rows):
        want[name] = total
        total += v
    assert {r.name: r.lo for r in found} == want
