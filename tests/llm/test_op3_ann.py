"""Graph search against brute force."""

import math

import numpy as np

from textloom.llm import op3_ann as op

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double"


def brute(rows, k):
    fine = {}
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        fine.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for q, own in fine.items():
        if q % 20:
            continue
        scores = [(-float(x @ own[0]), i) for i, some in fine.items() for x in some[:1] if i != q and len(x) == len(own[0])]
        out[q] = sorted(scores)[:k]
    return out


def found(frame, k):
    out = {}
    for r in sorted(op.search(frame, (frame["vec_id"] % 20) == 0, k).collect(), key=lambda r: (r[0], r[1])):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_on_the_given_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want, got = brute(rows, 20), found(table, 20)
    assert set(got) == set(want)
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values()))


def test_odd_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=4).astype(np.float32).tolist(), 1, 1, 0.0) for i in range(45)]
    rows += [(100 + i, rows[7][1], 1, 1, 0.0) for i in range(30)]  # copies
    rows += [(20, rows[20][1], 2, 1, 0.0), (200, None, 1, 1, 0.0), (220, [0.0] * 4, 1, 1, 0.0)]
    rows += [(240, [1.0, None, 1.0, 1.0], 1, 1, 0.0), (260, [float("nan"), 1.0, 1.0, 1.0], 1, 1, 0.0)]
    rows += [(None, [1.0] * 4, 1, 1, 0.0), (280, [], 1, 1, 0.0), (300, [1.0, 2.0], 1, 1, 0.0), (301, [3.0, 1.0], 1, 1, 0.0)]
    want, got = brute(rows, 20), found(spark.createDataFrame(rows, SCHEMA), 20)
    assert set(got) == {q for q in want if want[q]}
    for q in got:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])


def test_several_shards(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist(), 1, 1, 0.0) for i in range(600)]
    frame = spark.createDataFrame(rows, SCHEMA)
    index = op.build_index(frame.selectExpr("vec_id AS id", "CAST(embedding AS array<double>) AS vector", "8 AS dim"), 5, 100)
    assert index.count() == 6
    assert sum(len(r["ids"]) for r in index.collect()) == 600


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert op.search(frame, frame["vec_id"] % 20 == 0).count() == 0
