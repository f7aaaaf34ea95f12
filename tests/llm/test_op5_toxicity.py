"""The recurrent network: gradients, windows, held-out accuracy, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import op5_toxicity as op


def test_gradients():
    draw = np.random.default_rng(0)
    words = [b"aa", b"bb", b"idiot", b"cc"]
    net = op.Network.fresh(words, np.zeros(4, np.float32), 3)
    rows = draw.integers(0, 4, (5, 6))
    mask = (np.arange(6) < np.array([6, 6, 3, 1, 6])[:, None]).astype(np.float32)
    label = np.array([1, 0, 1, 0, 1], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    grad = net.gradients(words, rows, mask, label, np.ones(5))

    def loss():
        z = net.logits(*net.gates(net.inputs(words)[0]), rows, mask)
        return float(np.mean(np.logaddexp(0, z) - label * z))

    for name in ("wf", "ub", "wa", "va", "wo", "bo", "word", "char", "bb"):
        spot = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        kept = net.p[name][spot]
        net.p[name][spot] = kept + 1e-3
        up = loss()
        net.p[name][spot] = kept - 1e-3
        down = loss()
        net.p[name][spot] = kept
        assert abs((up - down) / 2e-3 - grad[name][spot]) < 2e-4 + 0.02 * abs(grad[name][spot])


def test_windows_cover_all_words():
    counts = np.array([0, 1, 24, 25, 100])
    index, mask, run, _ = op.windows(counts)
    assert set(index[mask]) == set(range(counts.sum()))
    assert (mask.sum(1) == np.minimum(counts[run], op.WINDOW)).all()


def test_long_texts_in_pieces(monkeypatch):
    net = op.Network.fresh([b"idiot"], np.ones(1, np.float32) * 9, 1)
    net.p["wo"] *= 5
    scorer = op.Scorer(net)
    text = "mild words here " * 400 + "idiot idiot idiot " + "more words " * 300
    whole = op.score_texts(scorer, [text])
    monkeypatch.setattr(op, "PIECE_CHARS", 300)
    assert abs(op.score_texts(scorer, [text])[0] - whole[0]) < 1.5
    assert op.score_texts(scorer, ["", None, " \n"]).tolist() == [-np.inf] * 3


def test_held_out_accuracy_and_odd_rows(spark):
    draw = np.random.default_rng(5)
    bad = ["vile", "nasty", "rotten"]
    rows, labels = [], []
    for i in range(700):
        words = [f"w{draw.integers(0, 300)}" for _ in range(draw.integers(20, 120))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words[draw.integers(0, len(words))] = bad[draw.integers(0, 3)] + draw.choice([",", ".", ""])
        rows.append((i, " ".join(words), "z", 0.5))
        labels.append((i, int(toxic)))
    rows += [(9000, None, "z", 0.5), (9001, "", "z", 0.5), (None, "w1 w2", "z", 0.5), (0, rows[0][1], "z", 0.5)]
    labels += [(None, 1), (5, 7), (9001, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    frame = op.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), epochs=6)
    got = [r.asDict() for r in frame.collect()]
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and (r["doc_id"] or 9999) < 700]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(r["score"] == 0.0 and r["predicted"] == 0 for r in got if r["doc_id"] in (9000, 9001))
    assert all(r["held_out"] for r in got if r["doc_id"] is None)


def test_one_class_or_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    for label, want in ((0, [0.0, 0.0]), (1, [1.0, 0.0])):
        labels = spark.createDataFrame([(2, label), (1, label), (3, label)], "doc_id long, toxic int")
        assert [r["score"] for r in op.toxicity(docs, labels).orderBy("doc_id").collect()] == want
    blank = spark.createDataFrame([(i, " \n") for i in range(1, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, toxic int")
    assert {r["score"] for r in op.toxicity(blank, labels).collect()} == {0.0}
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert op.toxicity(docs.filter(F.lit(False)), labels).count() == 0
