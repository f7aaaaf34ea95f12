"""Pivot index against all pairs."""

import math

import numpy as np

from textloom.llm import op6_pivot_dedup as op

SCHEMA = "vec_id long, embedding array<float>, label int, kept boolean, root long"


def brute(rows):
    fine = [
        (i, np.array(v, np.float32).astype(float), label)
        for i, v, label, *_ in rows
        if i is not None and label is not None and v
        and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    units = [v / np.linalg.norm(v) for _, v, _ in fine]
    links = [0] * len(fine)
    root = {i: i for i, _, _ in fine}
    pairs = []
    for a in range(len(fine)):
        for b in range(a):
            if fine[a][2] == fine[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.93:
                links[a] += 1
                links[b] += 1
                pairs.append((fine[a][0], fine[b][0]))
    for _ in fine:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    out = [(i, n, root[i], i == root[i]) for (i, _, _), n in zip(fine, links)]
    taken = list(fine)
    for i, v, label, *_ in rows:
        if taken and taken[0][0] == i and label is not None and v is not None and len(v) == len(taken[0][1]) and np.array_equal(np.array(v, np.float32).astype(float), taken[0][1]):
            taken.pop(0)
        else:
            out.append((i, 0, i, i is not None))
    return sorted(out, key=str)


def test_given_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    got = sorted((tuple(r) for r in op.near_duplicates(table).collect()), key=str)
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_odd_rows(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(5, 16))
    rows = []
    for i in range(120):
        v = base[i % 5] + draw.normal(size=16) * 0.03
        rows.append((i, v.astype(np.float32).tolist(), i % 2, True, 1))
    rows += [(200 + i, rows[3][1], 1, True, 1) for i in range(5)] + [rows[3]]
    rows += [(300, None, 1, True, 1), (301, [0.0] * 16, 1, True, 1), (302, rows[1][1], None, True, 1)]
    rows += [(303, [None] * 16, 1, True, 1), (304, [float("inf")] * 16, 1, True, 1), (None, rows[1][1], 1, True, 1)]
    rows += [(305, [], 1, True, 1), (306, [1.0, 1.0], 1, True, 1), (307, [2.0, 2.0], 1, True, 1)]
    got = sorted((tuple(r) for r in op.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert op.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
