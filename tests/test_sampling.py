import hashlib
import math

import pytest
from pyspark.sql import functions as F

from textloom.operators import sampling

LONG = "word " * 20


def listing(spark, n):
    return spark.createDataFrame([(str(i).zfill(3), i) for i in range(n)], "path string, size int")


def chosen(df):
    return sorted(r.path for r in df.collect())


def test_evenly_spaced_includes_the_ends(spark):
    files = listing(spark, 10)
    assert chosen(sampling.evenly_spaced(files, "path", 3)) == ["000", "004", "009"]
    assert len(chosen(sampling.evenly_spaced(files, "path", 20))) == 10
    assert len(chosen(sampling.evenly_spaced(files, "path", 10))) == 10
    assert chosen(sampling.evenly_spaced(files, "path", 1)) == ["005"]
    assert len(chosen(sampling.evenly_spaced(files, "path", 0))) == 10
    assert len(chosen(sampling.evenly_spaced(files, "path", None))) == 10
    with pytest.raises(ValueError):
        sampling.evenly_spaced(files, "path", -1)


@pytest.mark.parametrize("n,k", [(1, 1), (7, 4), (85, 10), (64, 33)])
def test_evenly_spaced_rounds_half_to_even(spark, n, k):
    want = {round(i * (n - 1) / (k - 1)) for i in range(k)} if k > 1 else {n // 2}
    assert chosen(sampling.evenly_spaced(listing(spark, n), "path", k)) == [
        str(i).zfill(3) for i in sorted(want)
    ]


def test_shard_budget(spark):
    budgets = [0, 1_000_000, 10**9, 10**11]
    df = spark.createDataFrame([(b,) for b in budgets], "b long")
    found = [r.k for r in df.select("b", sampling.shard_budget(F.col("b")).alias("k")).orderBy("b").collect()]
    assert found == [max(1, min(85, round(b * 1.2 / 117_000_000))) for b in budgets]


def quota_by_hand(rows, limit, seed):
    """rows: shard -> list of (row, usable)."""
    quota = math.ceil(limit / len(rows))
    prefix = {s: [r for r, ok in sorted(v) if ok][:quota] for s, v in rows.items()}
    order = lambda seed: sorted(
        prefix, key=lambda s: (hashlib.md5(f"{seed}:{s}".encode()).hexdigest(), s)
    )
    out = []
    while len(out) < limit:
        taken_before = len(out)
        for s in order(seed + taken_before):
            out += [(s, r) for r in prefix[s]][: limit - len(out)]
    return sorted(out)


@pytest.mark.parametrize("limit", [1, 10, 37, 100, 333, 2000])
def test_per_shard_quota(spark, limit):
    rows = {"hot": [(r, r % 5 != 0) for r in range(3000)], "empty": [(0, False), (1, False)]}
    rows |= {f"s{k}": [(r, r % (k + 2) != 0) for r in range(10 * k + 3)] for k in range(6)}
    data = [(s, r, LONG if ok else "short") for s, v in rows.items() for r, ok in v]
    df = spark.createDataFrame(data, "shard string, row long, text string").repartition(4)
    sample = sampling.per_shard_quota(df, "shard", "row", "text", limit, 42)
    # In the hand-made loop a pass is seeded with what was emitted before it.
    assert sorted((r.shard, r.row) for r in sample.collect()) == quota_by_hand(rows, limit, 42)


def test_tail_sample_quotas_and_shortage(spark):
    data = [
        (f"f{k}", r, f"{LONG}{k}{r}", "dclm_edu" if r % 2 else "stack_edu")
        for k in range(3)
        for r in range(100 if k else 40)
    ] + [("f1", 200 + r, LONG, "unknown") for r in range(50)]
    df = spark.createDataFrame(data, "shard string, row long, text string, source string")
    sample = sampling.tail_sample(df, "shard", "row", "text", "source", 31, 20, fraction=1e-9)
    counts = {(r.shard, r.domain): r["count"] for r in sample.groupBy("shard", "domain").count().collect()}
    # 31 over three shards: 11, 10, 10; the first has ten rows of each domain in its tail.
    assert counts == {
        (f"f{k}", d): min(10, 11 if k == 0 else 10) for k in range(3) for d in ("english", "code")
    }
    assert sample.filter("row < 20").count() == 0
    short = sampling.tail_shortages(sample, df, "shard", 31)
    assert {(r.shard, r.domain, r.quota, r.found) for r in short.collect()} == {
        ("f0", "english", 11, 10),
        ("f0", "code", 11, 10),
    }
    with pytest.raises(RuntimeError, match="quotas not met"):
        sampling.require_full_quotas(short)


@pytest.mark.parametrize("rows,extra", [(64, 0), (64, 1), (0, 0)])
def test_tail_sample_is_the_same_from_near_rows(spark, monkeypatch, rows, extra):
    monkeypatch.setattr(sampling, "HEAD_ROWS", rows)
    data = [
        (f"f{k}", r, LONG + str(r) if r % 3 else "short", "dclm_edu" if r % 2 else "stack_edu")
        for k in range(3)
        for r in range(1500)
    ] + [("tiny", r, LONG, "stack_edu") for r in range(20 * extra)]
    df = spark.createDataFrame(data, "shard string, row long, text string, source string")
    shards = 3 + extra
    sample = sampling.tail_sample(df, "shard", "row", "text", "source", 9 * shards, 100, 5, fraction=1e-9)
    order = lambda d: hashlib.md5(f"5:{d[0]}:{d[1]}".encode()).hexdigest()
    want = set()
    for shard in {d[0] for d in data}:
        for source in ("dclm_edu", "stack_edu"):
            fit = [d for d in data if d[0] == shard and d[3] == source and d[1] >= 100 and len(d[2]) > 9]
            want |= {d[:2] for d in sorted(fit, key=order)[:9]}
    assert {(r.shard, r.row) for r in sample.collect()} == want


def test_matching_files(spark):
    files = spark.createDataFrame([("a/1.parquet",), ("a/2.json",), ("b/3.parquet",)], "path string")
    assert [r.path for r in sampling.matching(files, "path", "a/").collect()] == ["a/1.parquet"]
    assert sampling.matching(files, "path", suffix="").count() == 3
    with pytest.raises(FileNotFoundError, match="begins with 'c/'"):
        sampling.matching(files, "path", "c/")
