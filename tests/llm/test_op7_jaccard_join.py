"""Jaccard join against all pairs."""

import random

import pytest

from textloom.llm import op7_jaccard_join as op

SCHEMA = "doc_id long, text string, key string, n int, comp long"


def brute(rows, percent=80, width=5):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return sorted(
        ((row[0], len(sets[i]), least.get(find(i)) if sets[i] else row[0]) for i, row in enumerate(rows)),
        key=str,
    )


def got(frame, **options):
    return sorted((tuple(r) for r in op.near_duplicates(frame, **options).collect()), key=str)


def edited(rnd, words, share):
    return [rnd.choice("xyzuvw") + str(rnd.randint(0, 99)) if rnd.random() < share else w for w in words]


def rows_of(seed, bases, copies):
    rnd = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "É a b c d"), (6, "é a b c d")]
    passage = [f"p{i}" for i in range(12)]
    for base in range(bases):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([6, 40, 150]))] + passage
        for _ in range(copies):
            rows.append((len(rows), " ".join(edited(rnd, words, rnd.choice([0, 0.005, 0.01, 0.03])))))
    rows += [(rows[9][0], rows[9][1]), (None, rows[9][1]), (None, "only null ids here at all")]
    return [(i, t, "k", 1, 5) for i, t in rows]


@pytest.mark.parametrize("bases,copies", [(30, 6), (2, 90)])
def test_random(spark, bases, copies):
    rows = rows_of(bases, bases, copies)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_blocks_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(op, "SHORT_LIST", 4)
    monkeypatch.setattr(op, "BLOCK", 8)
    monkeypatch.setattr(op, "BATCH_TOKENS", 700)
    rows = rows_of(7, 3, 40)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_packing():
    import numpy as np

    for tokens in ([], [5], [1, 2, 2, 9], [1, 1 << 40], [9, 3]):
        tokens = np.array(tokens, dtype=np.uint64)
        if len(tokens):
            assert (op._unpack(op._pack(tokens)) == tokens).all()


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
