"""Training of a byte-level BPE vocabulary on a distributed word table.

The corpus is read once, to count its distinct pre-tokens. From then on the state is that word
table. Merges are learned in rounds of many merges each:

1. Adjacent pairs are counted over all words; the best ``hot`` pairs come to the driver.
2. Words fall into fragments: the longest runs of symbols that hot pairs link. Equal fragments are
   counted together, and these counts come to the driver, which learns merges from them one at a time.
3. It goes on while the best pair it sees ranks no lower than the last hot pair did, and then the
   fragments of all words are replaced by what they became.

That gives exactly the list of one-at-a-time merging over the whole corpus. A pair made in a round
either lies in a fragment, so its count is known, or goes over a link that is not hot; it then counts
no more than that link does, and ranks after the last hot pair (on equal counts the smaller ids go
first, and new ids are the largest). Only a merge whose text already names a token could raise the
count of such a pair, so a round ends with it.

The number of fragments is what the driver holds. It is bounded by ``FRAGMENTS``: with more of them a
round is begun again with half as many hot pairs (one hot pair has one fragment, or, of two equal
symbols, one for each length of a run). The bound sets the number of rounds, never the result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import nfc, pretokens
from textloom.functions.tokens import MAX_VOCAB
from textloom.functions.vocabulary import FIRST_MERGE_ID, ID_OF_BYTE, BpeModel
from textloom.session import materialize, small_batches

# Plane 1 and up: clear of surrogates, and code point order equals id order.
SYMBOL_BASE = 0x10000
SYMBOL_BYTES = 4
# Hot pairs of the first round and of any, fragments that the driver takes, rounds between two rewrites
# of the word table, and entries that a task sums up before it passes them on.
FIRST_HOT, MOST_HOT = 32, 16_384
FRAGMENTS = 200_000
LINEAGE_ROUNDS = 8
TASK_PAIRS = 1_000_000
ID_BITS = 16

PACKED = "w binary, n bigint"
Batches = Iterator[pa.RecordBatch]


def symbol(token_id: int) -> str:
    return chr(SYMBOL_BASE + token_id)


def pretoken_counts(df: DataFrame, text: str, normalize: bool = True) -> DataFrame:
    """Corpus-wide frequency of every pre-token: ``word, n``."""
    small_batches(df.sparkSession)
    source = nfc(text) if normalize else F.col(text)

    def count(batches: Batches) -> Batches:
        for batch in batches:
            found = batch.column(0).flatten().value_counts()
            yield pa.RecordBatch.from_arrays(found.flatten(), names=["word", "n"])

    # Words of a batch are counted before they move; the sum is that of all words.
    counted = df.select(pretokens(source).alias("words")).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def word_symbols(word: Column) -> Column:
    """A word's UTF-8 bytes, one symbol each."""
    byte_chars = "".join(chr(b) for b in range(256))
    symbols = "".join(symbol(ID_OF_BYTE[b]) for b in range(256))
    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    return F.translate(latin, byte_chars, symbols)


def word_table(counts: DataFrame) -> DataFrame:
    """``s, n`` for all words that can still be merged."""
    longer = counts.filter(F.octet_length("word") > 1)
    return longer.select(word_symbols(F.col("word")).alias("s"), "n")


def pair_counts(words: DataFrame) -> DataFrame:
    """Weighted counts of adjacent symbol pairs: ``pair, n``.

    Positions are exploded and the pair is cut from the bytes (four a symbol), so the whole step is
    one generated-code stage with sums before the shuffle.
    """
    # A slice instead of a filter: a filter would be pushed below the replacements of a round and
    # make them run twice.
    size = F.length("s")
    starts = F.slice(F.sequence(F.lit(1), size), F.lit(1), size - 1)
    placed = words.select(F.col("s").cast("binary").alias("b"), "n", F.explode(starts).alias("i"))
    pair = F.col("b").substr((F.col("i") - 1) * SYMBOL_BYTES + 1, F.lit(2 * SYMBOL_BYTES))
    return placed.groupBy(pair.alias("pair")).agg(F.sum("n").cast("bigint").alias("n"))


def pair_ids(pairs: DataFrame) -> DataFrame:
    """``pair, n`` with readable ids: ``left_id, right_id, n``."""
    text = F.decode("pair", "UTF-8")
    return pairs.select(
        symbol_id(F.substring(text, 1, 1)).alias("left_id"),
        symbol_id(F.substring(text, 2, 1)).alias("right_id"),
        "n",
    )


def symbol_id(c: Column) -> Column:
    """Token id of a one-symbol string."""
    return (F.ascii(c) - SYMBOL_BASE).cast("int")


def merge_ids(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Ids of one word: always apply the earliest learned merge that is present."""
    while ranks and len(ids) > 1:
        best = min((ranks[pair] for pair in zip(ids, ids[1:]) if pair in ranks), default=None)
        if best is None:
            break
        rank, new = best
        merged, i = [], 0
        while i < len(ids):
            if i + 1 < len(ids) and ranks.get((ids[i], ids[i + 1]), (-1, 0))[0] == rank:
                merged.append(new)
                i += 2
            else:
                merged.append(ids[i])
                i += 1
        ids = merged
    return ids


class MergeTable:
    """Merges by pair, for many words at once."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, merges: list[tuple[int, int, int, int]]):
        first: dict[int, tuple[int, int]] = {}
        for rank, (left, right, new, _) in enumerate(merges):
            first.setdefault((left << ID_BITS) | right, (rank, new))
        self.keys = np.array(sorted(first), dtype=np.int64)
        self.ranks = np.array([first[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.new = np.array([first[k][1] for k in self.keys.tolist()], dtype=np.int64)

    def merged(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What :func:`merge_ids` makes of every word: ids of all words, and where each begins and the
        last ends. In a round each word applies the earliest learned merge that is present in it;
        words without one are done and leave."""
        rows = len(ends) - 1
        ids, word = ids.astype(np.int64), np.repeat(np.arange(rows), np.diff(ends))
        done = [(ids[:0], word[:0])]
        if not len(self.keys):
            done, ids = [(ids, word)], ids[:0]
        while len(ids):
            keys = (ids[:-1] << ID_BITS) | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            present = (self.keys[at] == keys) & (word[:-1] == word[1:])
            rank = np.r_[np.where(present, self.ranks[at], self.NONE), self.NONE]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            best = np.repeat(best, np.diff(np.r_[starts, len(ids)]))
            left = best == self.NONE
            done.append((ids[left], word[left]))
            chosen = np.flatnonzero((rank == best) & ~left)
            # Of neighbours that overlap (equal symbols in a row) every second one, from the left.
            opens = np.flatnonzero(np.r_[True, np.diff(chosen) != 1])[: len(chosen)]
            run = np.repeat(opens, np.diff(np.r_[opens, len(chosen)]))
            chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
            ids[chosen] = self.new[at[chosen]]
            keep = ~left
            keep[chosen + 1] = False
            ids, word = ids[keep], word[keep]
        ids, word = (np.concatenate(x) for x in zip(*done))
        sizes = np.bincount(word, minlength=rows)
        return ids[np.argsort(word, kind="stable")], np.r_[0, np.cumsum(sizes)].astype(np.int64)


def packed_words(counts: DataFrame) -> DataFrame:
    """``w, n``: words that can be merged, as packed ids of their bytes."""
    table = np.array([ID_OF_BYTE[b] for b in range(256)], dtype="<u2")

    def pack(batches: Batches) -> Batches:
        for batch in batches:
            data, ends = _flat(batch.column(0), np.uint8)
            yield _word_batch(table[data], ends, batch.column(1))

    longer = counts.filter(F.octet_length("word") > 1)
    return longer.select(F.col("word").cast("binary").alias("w"), "n").mapInArrow(pack, PACKED)


def _flat(words: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of binary rows, and where each row begins and the last ends."""
    cuts = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    held = words.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[cuts[0] : cuts[-1]] if held else np.empty(0, np.uint8)
    width = np.dtype(kind).itemsize
    return data.view(kind), (cuts.astype(np.int64) - cuts[0]) // width


def _binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of packed ids, cut at ``ends``."""
    cuts = (ends * 2).astype(np.int32)
    data = np.ascontiguousarray(ids.astype("<u2"))
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data.tobytes())]
    )


def _word_batch(ids: np.ndarray, ends: np.ndarray, n: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_binary(ids, ends), n], names=["w", "n"])


def _linked(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all neighbours, and which of them stand in one word."""
    wide = ids.astype(np.int64)
    keys = (wide[:-1] << ID_BITS) | wide[1:]
    same = np.ones(len(keys), dtype=bool)
    inner = ends[1:-1]
    same[inner[(inner > 0) & (inner < len(ids))] - 1] = False
    return keys, same


def _sum_pairs(batches: Batches) -> Batches:
    """Weighted counts of the pairs of one task's words."""
    held: list[pa.Table] = []
    size = 0

    def summed() -> pa.Table:
        table = pa.concat_tables(held).group_by("pair").aggregate([("n", "sum")])
        return table.rename_columns(["pair", "n"])

    for batch in batches:
        ids, ends = _flat(batch.column(0), np.uint16)
        if not len(ids):
            continue
        keys, same = _linked(ids, ends)
        weights = np.repeat(batch.column(1).to_numpy(), np.diff(ends))[:-1]
        held.append(pa.table({"pair": keys[same], "n": weights[same]}))
        size += held[-1].num_rows
        if size > TASK_PAIRS:
            held = [summed()]
            size = held[0].num_rows
            if size > TASK_PAIRS // 2:
                yield from held[0].to_batches()
                held, size = [], 0
    if held:
        yield from summed().to_batches()


def _hot_pieces(ids: np.ndarray, ends: np.ndarray, hot: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words cut wherever two neighbours are no hot pair; places where pieces begin."""
    keys, same = _linked(ids, ends)
    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    cuts = np.flatnonzero(np.r_[True, ~(same & (hot[at] == keys))])
    return _binary(ids, np.r_[cuts, len(ids)]), cuts


def _sum_fragments(hot: np.ndarray) -> Callable[[Batches], Batches]:
    """Fragments of more than one symbol, counted for each batch."""

    def count(batches: Batches) -> Batches:
        for batch in batches:
            ids, ends = _flat(batch.column(0), np.uint16)
            if not len(ids):
                continue
            pieces, cuts = _hot_pieces(ids, ends, hot)
            word = np.searchsorted(ends, cuts, side="right") - 1
            long = np.diff(np.r_[cuts, len(ids)]) > 1
            table = pa.table(
                {"w": pieces.filter(pa.array(long)), "n": batch.column(1).to_numpy()[word[long]]}
            )
            summed = table.group_by("w").aggregate([("n", "sum")]).rename_columns(["w", "n"])
            yield from summed.to_batches()

    return count


def _replace_fragments(
    hot: np.ndarray, merges: list[tuple[int, int, int, int]]
) -> Callable[[Batches], Batches]:
    """Words after the merges of a round; words of one symbol are done and left out."""
    table = MergeTable(merges)

    def replace(batches: Batches) -> Batches:
        for batch in batches:
            ids, ends = _flat(batch.column(0), np.uint16)
            if not len(ids):
                continue
            pieces, cuts = _hot_pieces(ids, ends, hot)
            coded = pieces.dictionary_encode()
            parts = _binary(*table.merged(*_flat(coded.dictionary, np.uint16)))
            joined, at = _flat(parts.take(coded.indices), np.uint16)
            ends = at[np.searchsorted(cuts, ends)]
            longer = np.diff(ends) > 1
            words = _binary(joined, ends).filter(pa.array(longer))
            yield pa.RecordBatch.from_arrays(
                [words, batch.column(1).filter(pa.array(longer))], names=["w", "n"]
            )

    return replace


class _Learner:
    """One-at-a-time merging over counted fragments."""

    def __init__(self, fragments: list[tuple[list[int], int]]):
        self.fragments = fragments
        self.counts: dict[tuple[int, int], int] = defaultdict(int)
        self.places: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, (ids, n) in enumerate(fragments):
            for pair in zip(ids, ids[1:]):
                self.counts[pair] += n
                self.places[pair].add(i)
        self.heap = [(-n, *pair) for pair, n in self.counts.items()]
        heapq.heapify(self.heap)

    def best(self) -> tuple[int, int, int] | None:
        """``-count, left, right`` of the pair that goes next."""
        while self.heap:
            n, left, right = self.heap[0]
            if -n == self.counts.get((left, right), 0) and n:
                return self.heap[0]
            heapq.heappop(self.heap)
        return None

    def merge(self, left: int, right: int, new: int) -> None:
        changed = set()
        for i in self.places.pop((left, right), ()):
            ids, n = self.fragments[i]
            merged, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and ids[k] == left and ids[k + 1] == right:
                    merged.append(new)
                    k += 2
                else:
                    merged.append(ids[k])
                    k += 1
            for pair in zip(ids, ids[1:]):
                self.counts[pair] -= n
                changed.add(pair)
            for pair in zip(merged, merged[1:]):
                self.counts[pair] += n
                self.places[pair].add(i)
                changed.add(pair)
            self.fragments[i] = (merged, n)
        for pair in changed:
            if self.counts[pair]:
                heapq.heappush(self.heap, (-self.counts[pair], *pair))
            else:
                del self.counts[pair]
                self.places.pop(pair, None)


def _learn(
    learner: _Learner,
    last_hot: tuple[int, int, int] | None,
    table: list[bytes],
    ids: dict[bytes, int],
    room: int,
    min_frequency: int,
) -> list[tuple[int, int, int, int]]:
    """Merges of one round; ``last_hot`` is None where every pair of the corpus is hot."""
    merges = []
    while room > 0:
        best = learner.best()
        if best is None or -best[0] < min_frequency or (last_hot is not None and best > last_hot):
            break
        n, left, right = best
        text = table[left] + table[right]
        known = text in ids
        new = ids.setdefault(text, len(table))
        if not known:
            table.append(text)
            room -= 1
        merges.append((left, right, new, -n))
        learner.merge(left, right, new)
        if known:
            break
    return merges


def train_bpe(
    counts: DataFrame, vocab_size: int = 32_768, min_frequency: int = 2, fragments: int = FRAGMENTS
) -> BpeModel:
    """Learn merges from ``word, n`` until the vocabulary has ``vocab_size`` entries.

    Pairs are taken by count, ties by smaller left and then right id. ``fragments`` bounds what the
    driver holds; see the head of this module.
    """
    if not FIRST_MERGE_ID <= vocab_size <= MAX_VOCAB:
        raise ValueError(f"vocabulary size must be {FIRST_MERGE_ID} to {MAX_VOCAB}")
    spark = counts.sparkSession
    small_batches(spark)
    parts = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    words = materialize(packed_words(counts).repartition(parts), "words")
    model = BpeModel()
    table = model.token_bytes()
    ids = {text: i for i, text in enumerate(table)}
    hot, rounds = FIRST_HOT, 0
    cached: list[DataFrame] = []
    while len(table) < vocab_size:
        pairs = words.mapInArrow(_sum_pairs, "pair bigint, n bigint").groupBy("pair")
        ranked = (
            pairs.agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(hot + 1).collect()
        )
        for frame in cached[:-1]:
            frame.unpersist()
        del cached[:-1]
        if not ranked or ranked[0].n < min_frequency:
            break
        while True:
            chosen = ranked[:hot]
            keys = np.array(sorted(r.pair for r in chosen), dtype=np.int64)
            found = words.mapInArrow(_sum_fragments(keys), PACKED).groupBy("w")
            rows = found.agg(F.sum("n").alias("n")).limit(fragments + 1).collect()
            if len(rows) <= fragments or hot == 1:
                break
            hot = max(1, hot // 2)
        last = chosen[-1]
        bound = (-last.n, last.pair >> ID_BITS, last.pair & ((1 << ID_BITS) - 1))
        learner = _Learner([(np.frombuffer(r.w, dtype="<u2").tolist(), r.n) for r in rows])
        everything = len(ranked) == len(chosen)
        merges = _learn(
            learner, None if everything else bound, table, ids, vocab_size - len(table), min_frequency
        )
        model.merges.extend(merges)
        if len(rows) < fragments // 2:
            hot = min(MOST_HOT, hot * 2)
        rounds += 1
        words = words.mapInArrow(_replace_fragments(keys, merges), PACKED)
        if rounds % LINEAGE_ROUNDS == 0:
            words = materialize(words, "words")
        else:
            # Filled by the next count; a lost block is rebuilt from the last rewrite.
            words = words.persist()
            cached.append(words)
    for frame in cached:
        frame.unpersist()
    return model
