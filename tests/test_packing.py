import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.tokens import pack_ids, unpack_ids
from textloom.operators import packing


def tokens(spark, docs):
    df = spark.createDataFrame(docs, "shard string, row long, ids array<int>").repartition(5)
    return df.withColumn("tokens", pack_ids(F.col("ids")))


def packed(df, length):
    blocks = packing.pack_blocks(df, "shard", "row", "tokens", length)
    rows = blocks.withColumn("ids", unpack_ids(F.col("tokens"))).collect()
    return {(r.shard, r.block): r.ids for r in rows}


def by_hand(docs, length):
    streams = {}
    for shard, _, ids in sorted(docs, key=lambda d: d[:2]):
        streams.setdefault(shard, []).extend(ids)
    return {
        (s, b): ids[b * length : (b + 1) * length]
        for s, ids in streams.items()
        for b in range(len(ids) // length)
    }


def test_pack_and_unpack(spark):
    rows = [[], [0, 1, 65_534], None, [300]]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, ids array<int>")
    back = df.withColumn("p", pack_ids(F.col("ids"))).withColumn("u", unpack_ids(F.col("p")))
    found = back.orderBy("i").collect()
    assert [r.u for r in found] == rows
    assert bytes(found[1].p) == b"\x00\x00\x01\x00\xfe\xff"
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([([65_535],)], "ids array<int>").select(pack_ids("ids")).collect()


def test_one_stream(spark):
    docs = [("s", 0, list(range(30))), ("s", 1, list(range(30, 48)))]
    assert packed(tokens(spark, docs), 4) == by_hand(docs, 4)


@pytest.mark.parametrize("length", [1, 5, 64])
def test_random_documents(spark, length):
    generator = random.Random(length)
    docs = [
        (f"s{generator.randint(0, 3)}", row, [generator.randint(0, 65_534) for _ in range(generator.choice([0, 1, 3, 40, 500]))])
        for row in range(200)
    ] + [("tiny", 0, [1, 2])]
    assert packed(tokens(spark, docs), length) == by_hand(docs, length)


def test_hot_shard_runs_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_DOCUMENTS", 4)
    generator = random.Random(0)
    docs = [("hot", row, [row % 60_000] * generator.randint(0, 9)) for row in range(0, 9000, 3)]
    assert packed(tokens(spark, docs), 16) == by_hand(docs, 16)


def test_offsets_and_locate(spark, monkeypatch):
    sizes = {"a": 100, "b": 3, "c": 4, "d": 9, "e": 4000}
    df = spark.createDataFrame(list(sizes.items()), "shard string, n long")
    offsets = packing.block_offsets(df, "shard", F.col("n"), 4)
    rows = {r.shard: (r.lo, r.hi) for r in offsets.collect()}
    assert rows == {"a": (0, 25), "c": (25, 26), "d": (26, 28), "e": (28, 1028)}
    assert offsets.agg(F.sum("usable_tokens")).first()[0] == 1028 * 4
    for width in (1, 7, 4096):
        found = packing.block_locate(spark.range(1028), "id", offsets, "shard", width).collect()
        assert {(r.id, r.shard, r.local_block) for r in found} == {
            (i, s, i - lo) for s, (lo, hi) in rows.items() for i in range(lo, hi)
        }
