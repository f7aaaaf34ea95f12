"""Sharded Lloyd against a plain one."""

import hashlib
import math
import random

import pytest

from textloom.llm import op11_sharded_lloyd as op

SCHEMA = "vec_id long, embedding array<float>, label int, chunk string, shard string"


def expected(rows, k, rounds, dims):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        labels = [c for c, _ in assign()]
        for c in set(labels):
            own = [v for (_, v), x in zip(kept, labels) if x == c]
            centroids[c] = [sum(col) // len(own) for col in zip(*own)]
    final = assign()
    inertia = [sum(d for c, d in final if c == i) for i in range(len(centroids))]
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        (str(i), c, d, inertia[c], sum(inertia), named[c]) for (i, _), (c, d) in zip(kept, final)
    )


def got(spark, rows, k, rounds, dims):
    frame = spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA)
    return sorted((str(r[0]), *r[1:]) for r in op.digests(frame, k, rounds, dims=dims).collect())


def floats(values):
    import numpy as np

    return [float(np.float32(x)) for x in values]


def test_random_vectors(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 32)
    rnd = random.Random(3)
    rows = [(i, floats(rnd.gauss(i % 7, 1) for _ in range(20))) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    assert got(spark, rows, 12, 3, 20) == expected(rows, 12, 3, 20)


def test_ties_nulls_and_odd_vectors(spark):
    same = [(i, [0.5, -0.5, 0.0]) for i in range(9)]
    odd = [(20, None), (21, [1.0, 2.0]), (22, [1.0, None, 0.0]), (23, [float("nan"), 0.0, 0.0]), (24, [])]
    odd += [(25, [float("inf"), 0.0, 0.0]), (None, [3.0, 0.0, -1e-9]), (4, [0.5, -0.5, 0.0]), (4, [100.25, 7.0, 1.0])]
    assert got(spark, same + odd, 5, 2, 3) == expected(same + odd, 5, 2, 3)
    assert got(spark, odd[-2:], 40, 5, 3) == expected(odd[-2:], 40, 5, 3)
    assert got(spark, odd[:6], 5, 2, 3) == []
    wide = [(i, [5e5 - i, -5e5 + 2 * i, 0.001]) for i in range(12)]
    assert got(spark, wide, 3, 2, 3) == expected(wide, 3, 2, 3)


def test_too_large(spark):
    with pytest.raises(Exception, match="beyond"):
        got(spark, [(1, [1e30, 0.0, 0.0])], 2, 1, 3)
