"""Hidden Markov scores: counts and recursions against plain Python."""

import collections
import itertools
import math
import zlib

import numpy as np

from textloom.llm import op10_hmm_score as op

SCHEMA = "doc_id long, text string, batch string, ids int"


def tiny_model(draw, states, symbols):
    model = op.Model(10, 3, np.zeros(0, np.uint64), np.ones(op.CLASSES), np.ones(op.CLASSES))
    model.start = draw.dirichlet(np.ones(states))
    model.move = draw.dirichlet(np.ones(states), states)
    model.emit = draw.dirichlet(np.ones(symbols), states)
    return model


def paths(model, seq):
    for path in itertools.product(range(op.STATES), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[path[0], seq[0]]
        for a, b, s in zip(path, path[1:], seq[1:]):
            p *= model.move[a, b] * model.emit[b, s]
        yield path, p


def test_recursions_against_all_paths(monkeypatch):
    monkeypatch.setattr(op, "STATES", 3)
    draw = np.random.default_rng(1)
    model = tiny_model(draw, 3, 4)
    seqs = [[0, 1, 2, 3, 0], [2], [3, 3, 1]]
    flat, lengths = np.array(sum(seqs, [])), np.array([5, 1, 3])
    logs = op.log_likelihood(model, flat, lengths)
    want = {"start": np.zeros(3), "move": np.zeros((3, 3)), "emit": np.zeros((3, 4))}
    for seq, log in zip(seqs, logs):
        weights = list(paths(model, seq))
        total = sum(p for _, p in weights)
        assert math.isclose(log, math.log10(total))
        for path, p in weights:
            want["start"][path[0]] += p / total
            for a, b in zip(path, path[1:]):
                want["move"][a, b] += p / total
            for s, x in zip(path, seq):
                want["emit"][s, x] += p / total
    got = {"start": np.zeros(3), "move": np.zeros((3, 3)), "emit": np.zeros((3, 4))}
    op.expected(model, flat, lengths, got)
    for key in want:
        assert np.allclose(got[key], want[key], atol=1e-4)


def test_runs():
    assert op.runs_of(np.array([1, op.RUN, op.RUN + 2])).tolist() == [1, op.RUN, op.RUN, 2]


def check(rows, got):
    counts = collections.Counter()
    for i, text, *_ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*(text or "").encode().lower().split(), None])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, text, *_ in rows:
        words = [*(text or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        want.append((str(i), held, len(words), sum(counts[w] > 0 for w in words), total, round(base, 6)))
    assert sorted((str(r[0]), *r[1:5], round(r[5], 6)) for r in got) == sorted(want)


def test_odd_rows(spark):
    texts = [None, "", " \n", "One two THREE", "É é", "w " * 3000, "a b c d e f g " * 40]
    rows = [(i, texts[i % len(texts)], "b", 1) for i in range(40)] + [(None, "x y", "b", 1), (3, texts[3], "b", 1)]
    got = op.score(spark.createDataFrame(rows, SCHEMA), 2).collect()
    check(rows, got)
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)


def test_small_batches_and_held_out_gain(spark, sf, monkeypatch):
    monkeypatch.setattr(op, "BATCH_TOKENS", 5000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op.score(docs, 4).collect()
    check([(r["doc_id"], r["text"]) for r in docs.collect()], got)
    held = [r for r in got if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.2


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = op.score(spark.createDataFrame([(held, "a b", "b", 1)], SCHEMA)).collect()
    assert [(r["n_known"], r["train_tokens"], r["score"] == r["base_score"]) for r in got] == [(0, 0, True)]
    assert op.score(spark.createDataFrame([], SCHEMA)).count() == 0
