"""Scores of a hidden Markov language model.

Words of the training documents are counted over the whole corpus. A word that makes up at least one
in ``HEAVY`` of all tokens is an emission of its own; the others share emissions by the hash of their
last characters, and within such a class a word has its smoothed share of the class. So the latent
part of the model is bounded (``STATES`` x ``HEAVY + CLASSES``) whatever the vocabulary, and

    P(text) = P(classes of its tokens | hidden Markov model) * prod P(word | class).

Baum-Welch runs over all training tokens: tasks add up expected counts over their documents, cut
into runs of ``RUN`` tokens for this, tables are summed slice by slice over partitions, and the
driver only holds the bounded parameters. Scoring is the exact scaled forward recursion over the
whole document.

Counting does not move texts. Documents are cut into batches of about ``BATCH_TOKENS`` tokens, each
with a dictionary; dictionary entries (64-bit word hash, count) go to the fragment of their hash, and
come back with the corpus count. A word is thus sent once for a batch, so no common word gathers in
a task. Batches, with words as numbers, are written once.

Defined results: a null or empty text is its end token alone; a null id belongs to the learning part;
repeated rows are scored (and learned from) as often as they come; without a training document every
count is 0 and both scores are equal; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import fold, lower_words, slices
from textloom.session import materialize

STATES, HEAVY, CLASSES = 8, 20_000, 4_096
BATCH_TOKENS, RUN, ITERATIONS = 256_000, 64, 8
HELD_FOLD = 1
PIECE_CHARS = 1 << 20
SLICES = 32
SEED = 23

BATCHES = "batch string, learned bigint, ids array<bigint>, held array<boolean>, lengths binary, words binary, wide boolean, parts array<struct<frag:int,entries:binary,counts:binary,forms:binary>>"
FOUND = "batch string, frag int, totals binary, forms binary, heavy_at binary, heavy binary, sums array<struct<form:int,total:bigint,kinds:bigint>>, tops array<struct<hash:bigint,total:bigint>>"


def tokens_of(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text, piece by piece; pieces end at white space."""
    start, size = 0, len(text or "")
    while start < size:
        end = min(size, start + PIECE_CHARS)
        while end < size and text[end] not in " \t\n\r\x0b\f":
            end += 1
        yield lower_words(text[start:end])
        start = end


def form_of(word: bytes) -> int:
    """Class of a word that has no emission of its own: its last characters."""
    tail = word.decode("utf-8", "replace").rstrip(".,;:!?")[-2:] or word.decode("utf-8", "replace")[-1:]
    return xxhash.xxh32_intdigest(tail.encode()) % (CLASSES - 1) + 1


END_HASH, END_FORM = 0, 0


def _cut(fragments: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents to batches with dictionaries. Entry 0 of a dictionary is the end token."""

    def flush(rows: list, words: dict[bytes, int]) -> dict:
        hashes = np.fromiter(
            (END_HASH if w is None else xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)
        )
        forms = np.fromiter(
            (END_FORM if w is None else form_of(w) for w in words), np.uint16, len(words)
        )
        learned = [r[2] for r in rows if not r[1]]
        flat = np.concatenate(learned) if learned else np.zeros(0, np.int64)
        counts = np.bincount(flat, minlength=len(words)).astype(np.uint32)
        frag = ((hashes >> np.uint64(40)) * np.uint64(fragments)) >> np.uint64(24)
        order = np.argsort(frag, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(frag[order])) + 1, len(order)]
        parts = []
        # Numbers follow the fragments from here on.
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            at = order[lo:hi]
            parts.append(
                {
                    "frag": int(frag[at[0]]),
                    "entries": hashes[at].astype("<u8").tobytes(),
                    "counts": counts[at].astype("<u4").tobytes(),
                    "forms": forms[at].astype("<u2").tobytes(),
                }
            )
        wide = len(words) > 65_535
        sequence = place[np.concatenate([r[2] for r in rows])]
        return {
            "batch": uuid.UUID(bytes=xxhash.xxh3_128_digest(sequence.tobytes() + repr([r[0] for r in rows]).encode() + hashes.tobytes())).hex,
            "learned": int(counts.sum()),
            "ids": [r[0] for r in rows],
            "held": [r[1] for r in rows],
            "lengths": np.array([len(r[2]) for r in rows], "<u8").tobytes(),
            "words": sequence.astype("<u4" if wide else "<u2").tobytes(),
            "wide": wide,
            "parts": parts,
        }

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        rows, words, held = [], {None: 0}, 0
        for batch in batches:
            ids, folds, texts = (batch.column(i).to_pylist() for i in range(3))
            for doc, mod, text in zip(ids, folds, texts):
                if held >= BATCH_TOKENS:
                    schema = schema or _batch_schema()
                    yield pa.RecordBatch.from_pylist([flush(rows, words)], schema=schema)
                    rows, words, held = [], {None: 0}, 0
                numbers = [
                    np.fromiter(
                        (words.setdefault(w, len(words)) for w in piece), np.int64, len(piece)
                    )
                    for piece in tokens_of(text)
                ]
                numbers.append(np.zeros(1, np.int64))
                numbers = np.concatenate(numbers)
                rows.append((doc, mod == HELD_FOLD, numbers))
                held += len(numbers)
        if rows:
            yield pa.RecordBatch.from_pylist([flush(rows, words)], schema=_batch_schema())

    return cut


def _batch_schema() -> pa.Schema:
    part = pa.struct(
        [("frag", pa.int32()), ("entries", pa.binary()), ("counts", pa.binary()), ("forms", pa.binary())]
    )
    return pa.schema(
        [
            ("batch", pa.string()), ("learned", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
            ("lengths", pa.binary()), ("words", pa.binary()), ("wide", pa.bool_()),
            ("parts", pa.list_(part)),
        ]
    )


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one fragment: distinct hashes, their totals and forms; for each entry its place among
    them; row ends."""
    entries = [np.frombuffer(b, "<u8") for b in table.column("entries").to_pylist()]
    counts = np.concatenate([np.frombuffer(b, "<u4") for b in table.column("counts").to_pylist()])
    forms = np.concatenate([np.frombuffer(b, "<u2") for b in table.column("forms").to_pylist()])
    distinct, first, place = np.unique(np.concatenate(entries), return_index=True, return_inverse=True)
    totals = np.bincount(place, weights=counts).astype(np.int64)
    return distinct, totals, forms[first], place, np.cumsum([len(e) for e in entries])


def _fragment(tokens: int) -> Callable[[pa.Table], pa.Table]:
    """Corpus counts of one fragment's words: back to each batch, and their sums.

    Words that make up one in ``HEAVY`` of all tokens are named by hash, wherever they occur.
    """

    def run(table: pa.Table) -> pa.Table:
        distinct, totals, forms, place, ends = _summed(table)
        is_heavy = (totals > 0) & (totals * HEAVY >= tokens)
        out = []
        for row, (batch, frag, own) in enumerate(
            zip(table.column("batch").to_pylist(), table.column("frag").to_pylist(), np.split(place, ends[:-1]))
        ):
            at = np.flatnonzero(is_heavy[own])
            out.append(
                {
                    "batch": batch,
                    "frag": frag,
                    "totals": totals[own].astype("<u8").tobytes(),
                    "forms": forms[own].astype("<u2").tobytes(),
                    "heavy_at": at.astype("<u4").tobytes(),
                    "heavy": distinct[own[at]].astype("<u8").tobytes(),
                }
            )
        light = (totals > 0) & ~is_heavy
        sums = np.bincount(forms[light], weights=totals[light], minlength=CLASSES)
        kinds = np.bincount(forms[light], minlength=CLASSES)
        out[0]["sums"] = [
            {"form": int(f), "total": int(sums[f]), "kinds": int(kinds[f])} for f in np.flatnonzero(kinds)
        ]
        out[0]["tops"] = [
            {"hash": int(h), "total": int(t)}
            for h, t in zip(distinct[is_heavy].astype(np.int64), totals[is_heavy])
        ]
        return pa.Table.from_pylist(out, schema=_found_schema())

    return run


def _found_schema() -> pa.Schema:
    sums = pa.struct([("form", pa.int32()), ("total", pa.int64()), ("kinds", pa.int64())])
    tops = pa.struct([("hash", pa.int64()), ("total", pa.int64())])
    return pa.schema(
        [
            ("batch", pa.string()), ("frag", pa.int32()), ("totals", pa.binary()), ("forms", pa.binary()),
            ("heavy_at", pa.binary()), ("heavy", pa.binary()), ("sums", pa.list_(sums)),
            ("tops", pa.list_(tops)),
        ]
    )


class Model:
    """Start, transitions and emissions; heavy words, class totals."""

    def __init__(self, tokens: int, distinct: int, heavy: np.ndarray, totals, kinds):
        self.tokens, self.distinct = tokens, distinct
        self.heavy = np.sort(heavy.astype(np.uint64))
        self.totals, self.kinds = totals, kinds
        size = len(self.heavy) + CLASSES
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 1 / STATES)
        self.emit = np.full((STATES, size), 1 / size)

    def fresh(self, heavy_totals: np.ndarray) -> None:
        """Emissions near the corpus shares, each state pushed a little its own way; states last."""
        draw = np.random.default_rng(SEED)
        shares = np.concatenate([heavy_totals, self.totals]) + 0.5
        noisy = shares * np.exp(0.5 * draw.normal(size=(STATES, len(shares))))
        self.emit = noisy / noisy.sum(1, keepdims=True)
        self.move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(self.move, 0.9)

    def place(self, found: dict) -> np.ndarray:
        """Emissions of the words of one answer."""
        out = len(self.heavy) + np.frombuffer(found["forms"], "<u2").astype(np.int64)
        at = np.frombuffer(found["heavy_at"], "<u4")
        out[at] = np.searchsorted(self.heavy, np.frombuffer(found["heavy"], "<u8"))
        return out

    def inside(self, emission: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | emission)."""
        form = np.maximum(emission - len(self.heavy), 0)
        share = (counts + 0.5) / (self.totals[form] + 0.5 * (self.kinds[form] + 1))
        return np.where(emission < len(self.heavy), 0.0, np.log10(share))


def lanes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences from the longest to the shortest, and how many are alive at each step."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]]) if len(order) else 0
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    return order, alive


def log_likelihood(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 P(symbols) of each sequence, the sequences laid end to end: exact scaled forward."""
    out = np.zeros(len(lengths))
    order, alive = lanes(lengths)
    begin = (np.cumsum(lengths) - lengths)[order]
    emit = np.ascontiguousarray(model.emit.T)
    state = None
    logs = np.zeros(len(lengths))
    for t, count in enumerate(alive):
        now = emit[symbols[begin[:count] + t]]
        state = now * (model.start if t == 0 else state[:count] @ model.move)
        scale = state.sum(1)
        state /= scale[:, None]
        logs[:count] += np.log10(scale)
    out[order] = logs
    return out


def expected(model: Model, symbols: np.ndarray, lengths: np.ndarray, out: dict) -> None:
    """Adds the expected counts of all runs to ``out`` (forward and backward, scaled)."""
    order, alive = lanes(lengths)
    begin = (np.cumsum(lengths) - lengths)[order]
    emit = np.ascontiguousarray(model.emit.T).astype(np.float32)
    move, start = model.move.astype(np.float32), model.start.astype(np.float32)
    forward, seen = [], []
    for t, count in enumerate(alive):
        now = emit[symbols[begin[:count] + t]]
        state = now * (start if t == 0 else forward[-1][:count] @ move)
        state /= state.sum(1, keepdims=True)
        forward.append(state)
        seen.append(now)
    back = np.ones((0, STATES), np.float32)
    tail = np.zeros((STATES, STATES))
    gammas = np.empty((len(symbols), STATES), np.float32)
    for t in range(len(alive) - 1, -1, -1):
        count = alive[t]
        if len(back) < count:
            back = np.vstack([back, np.ones((count - len(back), STATES), np.float32)])
        gamma = forward[t] * back
        gamma /= gamma.sum(1, keepdims=True)
        gammas[begin[:count] + t] = gamma
        if t == 0:
            out["start"] += gamma.sum(0)
            break
        ahead = seen[t] * back
        before = forward[t - 1][:count]
        joint = before @ move * ahead
        ahead = ahead / joint.sum(1, keepdims=True)
        tail += (before.T @ ahead) * move
        back = ahead @ move.T
    out["move"] += tail
    for s in range(STATES):
        out["emit"][s] += np.bincount(symbols, weights=gammas[:, s], minlength=out["emit"].shape[1])


def runs_of(lengths: np.ndarray) -> np.ndarray:
    """Lengths of the runs that sequences are cut into."""
    whole, rest = lengths // RUN, lengths % RUN
    per = whole + (rest > 0)
    out = np.full(per.sum(), RUN, np.int64)
    ends = np.cumsum(per) - 1
    out[ends[rest > 0]] = rest[rest > 0]
    return out


def _learn(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Expected counts of a partition, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {"start": np.zeros(STATES), "move": np.zeros((STATES, STATES)), "emit": np.zeros_like(model.emit)}
        any_row = False
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<u8").astype(np.int64)
                symbols = np.frombuffer(row["symbols"], "<u2").astype(np.int64)
                learned = ~np.array(row["held"], bool)
                symbols = symbols[np.repeat(learned, lengths)]
                if len(symbols):
                    any_row = True
                    expected(model, symbols, runs_of(lengths[learned]), sums)
        if any_row:
            flat = np.concatenate([sums["start"], sums["move"].ravel(), sums["emit"].ravel()])
            cuts = np.array_split(flat, SLICES)
            yield pa.RecordBatch.from_pydict(
                {
                    "slice": pa.array(range(SLICES), pa.int32()),
                    "counts": pa.array([c.tobytes() for c in cuts], pa.binary()),
                }
            )

    return run


def _added(table: pa.Table) -> pa.Table:
    """One slice, summed over partitions."""
    total = np.sum([np.frombuffer(c) for c in table.column("counts").to_pylist()], axis=0)
    return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def baum_welch(model: Model, encoded: DataFrame, iterations: int) -> None:
    """Trains in place; each iteration is one pass over all encoded batches."""
    columns = encoded.select("lengths", "symbols", "held")
    for _ in range(iterations):
        pieces = columns.mapInArrow(_learn(model), "slice int, counts binary")
        summed = pieces.groupBy("slice").applyInArrow(_added, "slice int, counts binary").collect()
        if not summed:
            return
        flat = np.concatenate([np.frombuffer(r["counts"]) for r in sorted(summed, key=lambda r: r["slice"])])
        start, move, emit = np.split(flat, [STATES, STATES + STATES**2])
        start, move = start + 1e-3, move.reshape(STATES, STATES) + 1e-3
        emit = emit.reshape(STATES, -1)
        # Each emission keeps a little of its overall share, so none becomes impossible.
        shares = (emit.sum(0) + 0.5) / (emit.sum() + 0.5 * emit.shape[1])
        emit = emit + 5.0 * shares
        model.start = start / start.sum()
        model.move = move / move.sum(1, keepdims=True)
        model.emit = emit / emit.sum(1, keepdims=True)


def _encode(model: Model) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A batch with its counts: emissions, base score and P(word | emission) of each document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {r["frag"]: r for r in right.to_pylist()}
        out = []
        for row in left.to_pylist():
            parts = [found[f] for f in row["frags"]]
            counts = np.concatenate([np.frombuffer(p["totals"], "<u8") for p in parts]).astype(float)
            emission = np.concatenate([model.place(p) for p in parts])
            base = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
            lengths = np.frombuffer(row["lengths"], "<u8").astype(np.int64)
            words = np.frombuffer(row["words"], "<u4" if row["wide"] else "<u2").astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            add = lambda values: np.add.reduceat(values[words], starts)
            out.append(
                {
                    "ids": row["ids"],
                    "held": row["held"],
                    "lengths": row["lengths"],
                    "symbols": emission[words].astype("<u2").tobytes(),
                    "known": add((counts > 0).astype(np.int64)).tolist(),
                    "base": add(base).tolist(),
                    "inside": add(model.inside(emission, counts)).tolist(),
                }
            )
        return pa.Table.from_pylist(out, schema=_encoded_schema())

    return run


ENCODED = "ids array<bigint>, held array<boolean>, lengths binary, symbols binary, known array<bigint>, base array<double>, inside array<double>"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _encoded_schema() -> pa.Schema:
    return pa.schema(
        [
            ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.binary()),
            ("symbols", pa.binary()), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())),
            ("inside", pa.list_(pa.float64())),
        ]
    )


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for lo, hi in slices(rows, lambda r: len(r["symbols"]), 2_000_000):
                some = rows[lo:hi]
                lengths = np.concatenate([np.frombuffer(r["lengths"], "<u8") for r in some]).astype(np.int64)
                symbols = np.concatenate([np.frombuffer(r["symbols"], "<u2") for r in some]).astype(np.int64)
                flat = {k: [x for r in some for x in r[k]] for k in ("ids", "held", "known", "base", "inside")}
                base = np.array(flat["base"])
                score = base
                if model.tokens:
                    score = log_likelihood(model, symbols, lengths) + np.array(flat["inside"])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(flat["ids"], pa.int64()),
                        "held_out": pa.array(flat["held"], pa.bool_()),
                        "n_tokens": pa.array(lengths),
                        "n_known": pa.array(flat["known"], pa.int64()),
                        "base_score": pa.array(base),
                        "score": pa.array(score),
                    }
                )

    return run


def _fit(answers: DataFrame, tokens: int) -> Model:
    """The untrained model: heavy words and class sums reach the driver, both of bounded size."""
    heavy = answers.select(F.explode("tops").alias("t")).select("t.*").collect()  # HEAVY at most
    forms = answers.select(F.explode("sums").alias("s")).select("s.*").groupBy("form").agg(
        F.sum("total").alias("total"), F.sum("kinds").alias("kinds")
    )
    totals, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in forms.collect():  # CLASSES rows at most
        totals[row["form"]], kinds[row["form"]] = row["total"], row["kinds"]
    names = np.array([r["hash"] for r in heavy], np.int64).astype(np.uint64)
    model = Model(tokens, len(heavy) + int(kinds.sum()), names, totals, kinds)
    order = np.argsort(names, kind="stable")
    model.fresh(np.array([r["total"] for r in heavy], float)[order] if heavy else np.zeros(0))
    return model


def score(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    rows = docs.select(F.col("doc_id").cast("bigint"), fold(F.col("doc_id")).alias("mod"), "text")
    fragments = max(8, -(-docs.count() // 4096))
    batches = materialize(rows.mapInArrow(_cut(fragments), BATCHES), "batches")
    entries = batches.select("batch", F.explode("parts").alias("p")).select("batch", "p.*")
    tokens = batches.agg(F.sum("learned").alias("n")).first()["n"] or 0
    answers = materialize(entries.groupBy("frag").applyInArrow(_fragment(tokens), FOUND), "answers")
    model = _fit(answers, tokens)
    left = batches.select(
        "batch", "ids", "held", "lengths", "words", "wide", F.col("parts.frag").alias("frags")
    )
    right = answers.drop("sums", "tops")
    encoded = left.groupBy("batch").cogroup(right.groupBy("batch")).applyInArrow(_encode(model), ENCODED)
    encoded = materialize(encoded, "encoded")
    if model.tokens:
        baum_welch(model, encoded, iterations)
    scored = encoded.mapInArrow(_score(model), SCORED)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
