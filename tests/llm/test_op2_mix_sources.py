"""Mixing against plain arithmetic, and its SQL."""

import collections
import hashlib

import duckdb
import pytest

from textloom.llm import op2_mix_sources as op

ROWS = [
    (1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, "one\ttwo  three\nfour", "y"), (5, "w " * 90, "z"),
    (6, "p q", None), (7, "p q r", None), (1, "a b c", "x"), (8, "n " * 40, "é"), (9, "k " * 7, "w"),
    (10, "", "empty"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "0 AS size", "0 AS target"
    )


def expected(rows):
    words = [len((t or "").encode().split()) for _, t, _ in rows]
    sizes = collections.Counter()
    for (_, _, s), w in zip(rows, words):
        sizes[s] += w
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: op.WEIGHTS[i % 3] for i, s in enumerate(order)}
    goal, open_ = dict.fromkeys(order, 0.0), set(order)
    left = sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            goal.update(share)
            break
        for s in over:
            goal[s] = 3.0 * sizes[s]
            left -= goal[s]
        open_ -= over
    out = []
    for (i, _, s), w in zip(rows, words):
        rate = goal[s] / sizes[s] if sizes[s] else 0.0
        u = int(hashlib.md5(f"{op.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        out.append((i, w, sizes[s], goal[s], w * (int(rate) + (u < rate - int(rate)))))
    return sorted(out)


def test_report(spark):
    got = sorted(tuple(r) for r in op.report(frame(spark, ROWS)).collect())
    for g, w in zip(got, expected(ROWS), strict=True):
        assert g == pytest.approx(w)
        assert g[4] <= 3 * g[1]


def test_mix_repeats_rows(spark):
    docs = frame(spark, ROWS)
    counts = collections.Counter(r["doc_id"] for r in op.mix(docs).collect())
    assert op.mix(docs).columns == docs.columns
    want = collections.Counter()
    for i, size, _, _, taken in expected(ROWS):
        want[i] += taken // size if size else 0
    assert {k: v for k, v in counts.items() if k not in (2, 3, 10)} == {k: v for k, v in want.items() if v}


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", ROWS)
    rows = sorted(con.execute(op.SQL).fetchall())
    assert rows == sorted(tuple(r) for r in op.report(frame(spark, ROWS)).collect())


def test_empty_table(spark):
    assert op.report(frame(spark, []).limit(0)).count() == 0
    assert op.mix(frame(spark, []).limit(0)).count() == 0
