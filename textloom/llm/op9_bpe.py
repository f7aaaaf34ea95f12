"""Byte-level BPE as a streaming transducer with bounded lookahead.

*Sufficient lookahead.* Let a text be cut after byte ``i``. The tokens of the prefix and those of any
longer text can differ only in a zone at the end of the prefix. Merges are applied by rank; the zone
grows to the left only when a merge ``(u, v)`` takes a token ``u`` that ends where the zone begins,
and then by the length of ``u``. The next growth needs a later merge ``(u', v')`` whose right part
starts with ``u``. So the zone is no longer than the heaviest chain of such merges, which
``lookahead`` computes from the merge list in one pass over the ranks. A token that ends further to
the left than that is stable and can be emitted; what is left of a piece is encoded from there on.

*Transducer.* Text is split by the public pre-tokenization pattern at places that no later text can
change. Pieces up to ``BUFFER`` bytes are merged at once (and remembered, up to a bound); longer
ones pass through a buffer of that size, from which stable tokens are emitted. Counts and digests are
updated as tokens come, so apart from the row itself memory does not grow with the text.

*Decoding.* Token bytes go through an incremental UTF-8 decoder, which holds back the bytes of a
character that is not complete yet.

Defined results: a null text is empty; an empty text has no tokens; the strings of special tokens in
a text become their ids, as in the public library; lone surrogates cannot occur in Spark strings.
Rows are mapped one by one: repeated rows and null ids come out as they are, further columns stay.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from operator import add

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the public pre-tokenization pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BUFFER = 4096
SHORT = 64
SLICE_CHARS = 1 << 16
CACHE_PIECES, CACHE_WORDS = 200_000, 800_000


def byte_alphabet() -> dict[str, int]:
    """The published character of each byte: printable ones stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """A vocabulary file: bytes of each id, rank and result of each merge, special tokens."""

    def __init__(self, text: str):
        stored = json.loads(text)
        alphabet = byte_alphabet()
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.ids = {to_bytes(t): i for t, i in stored["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in stored["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in stored["model"]["merges"]]
        self.pairs = [(self.ids[to_bytes(a)], self.ids[to_bytes(b)]) for a, b in pairs]
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.merged = {
            (a, b): (rank, self.ids[self.bytes_of[a] + self.bytes_of[b]])
            for rank, (a, b) in reversed(list(enumerate(self.pairs)))
        }
        self.bytes_of |= {i: t.encode() for t, i in self.specials.items()}
        self.of_byte = [self.ids[bytes([b])] for b in range(256)]
        self.lookahead = lookahead(self)


def lookahead(merges: Merges) -> int:
    """Bytes after which a token is stable, whatever follows: the heaviest chain of merges in which
    the right part of each begins with the left part of the one before (ranks rising)."""
    spine: dict[int, tuple[int, ...]] = {}  # a token, its left part, the left part of that, …
    best: dict[int, int] = {}  # heaviest chain that ends with a merge of this left part
    longest = 1
    for a, b in merges.pairs:
        whole = merges.merged[a, b][1]
        reach = len(merges.bytes_of[a]) + max(
            (best.get(t, 0) for t in (b, *spine.get(b, ()))), default=0
        )
        best[a] = max(best.get(a, 0), reach)
        longest = max(longest, reach)
        spine[whole] = (a, *spine.get(a, ()))
    return longest


Found = tuple[int, str, bytes]


def joined(found: list[Found]) -> Found:
    counts, names, spans = zip(*found)
    return sum(counts), ",".join(names), b"".join(spans)


class SpacedWords(dict):
    """What lies between two single spaces, the first of them included, encoded; bounded."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> Found:
        found = joined([self.encoder.piece(p) for p in self.encoder.find(" " + word)])
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


class Encoder:
    """Encodes texts; remembers pieces up to a bound, then starts afresh."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.pieces: dict[str, Found] = {}
        self.words = SpacedWords(self)
        if max(merges.bytes_of) >= 0xD800:
            raise ValueError("vocabularies of more than 55,296 entries are not supported")
        self.first = {b: chr(i) for b, i in enumerate(merges.of_byte)}
        self.pair = [chr(a) + chr(b) for a, b in merges.pairs]
        self.whole = [chr(merges.merged[p][1]) for p in merges.pairs]
        self.none = len(self.pair)
        self.rank = {p: i for i, p in reversed(list(enumerate(self.pair)))}.get
        self.find = regex.compile(PATTERN).findall
        self.blank = regex.compile(r"\s ").search
        self.cut = regex.compile(r"(?<=\S)\s").search
        specials = sorted(merges.specials, key=len, reverse=True)
        self.special = (
            regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        )

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a bounded piece, held as characters so that a pair is a two-letter string: the
        pair of lowest rank first, leftmost first; a merge changes the ranks beside it only."""
        if len(data) > SHORT:
            return self.merge_long(data)
        rank, none, whole = self.rank, self.none, self.whole
        tokens = list(data.decode("latin-1").translate(self.first))
        ranks = [rank(p, none) for p in map(add, tokens, tokens[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            token = tokens[i] = whole[low]
            del tokens[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(tokens[i - 1] + token, none)
            if i < len(ranks):
                ranks[i] = rank(token + tokens[i + 1], none)
        return [ord(c) for c in tokens]

    def merge_long(self, data: bytes) -> list[int]:
        """The same for longer pieces: candidate merges wait in a heap by rank and place."""
        merged, size = self.merges.merged, len(data)
        ids = [self.merges.of_byte[b] for b in data]
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            found = merged.get((ids[i], ids[i + 1]))
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= size or ids[j] != right:
                continue  # one of the two is gone
            ids[i], ids[j] = merged[left, right][1], -1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                found = merged.get((ids[i], ids[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0:
                found = merged.get((ids[h], ids[i]))
                if found:
                    heapq.heappush(heap, (found[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def stream(self, data: Iterator[bytes]) -> Iterator[list[int]]:
        """Tokens of a piece of any length that comes in parts: stable tokens are emitted, the rest
        of the buffer waits for what follows."""
        held, size = b"", max(BUFFER, 4 * self.merges.lookahead)
        for part in data:
            for at in range(0, len(part), size):
                held += part[at : at + size]
                if len(held) < size:
                    continue
                limit, done, stable = len(held) - self.merges.lookahead, 0, []
                for token in self.merge(held):
                    end = done + len(self.merges.bytes_of[token])
                    if end > limit:
                        break
                    stable.append(token)
                    done = end
                held = held[done:]
                yield stable
        if held:
            yield self.merge(held)

    def piece(self, text: str) -> Found:
        """Token count, ids joined by commas, decoded bytes of a piece."""
        found = self.pieces.get(text)
        if found is None:
            data = text.encode("utf-8")
            if len(data) <= BUFFER:
                ids = self.merge(data)
            else:
                view = (data[i : i + BUFFER] for i in range(0, len(data), BUFFER))
                ids = [t for part in self.stream(view) for t in part]
            token = self.merges.bytes_of
            found = (len(ids), ",".join(map(str, ids)), b"".join([token[i] for i in ids]))
            if len(data) <= 64:
                if len(self.pieces) >= CACHE_PIECES:
                    self.pieces.clear()
                self.pieces[text] = found
        return found

    def runs(self, text: str) -> Iterator[tuple[bool, str]]:
        """Slices that can be split into pieces one by one; true marks a special token."""
        parts = self.special.split(text) if self.special else [text]
        for nth, part in enumerate(parts):
            if nth % 2:
                yield True, part
                continue
            start = 0
            while start < len(part):
                # No piece holds white space after something else, so a cut there is final.
                end = self.cut(part, start + SLICE_CHARS) if len(part) - start > SLICE_CHARS else None
                stop = end.start() if end else len(part)
                yield False, part[start:stop]
                start = stop

    def split(self, part: str) -> list[Found]:
        """Pieces of a slice, encoded. A space after something that is not white space always begins
        a piece; where all single spaces are such, the words between them are looked up whole."""
        if self.blank(part):
            return [self.piece(p) for p in self.find(part)]
        head, *rest = part.split(" ")
        found = [self.piece(p) for p in self.find(head)]
        return found + list(map(self.words.__getitem__, rest))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids, SHA-256 of the decoded text."""
        count, ids, decoder = 0, hashlib.sha256(), Decoder()
        begun = False
        for special, part in self.runs(text or ""):
            if special:
                token = self.merges.specials[part]
                found = [(1, str(token), self.merges.bytes_of[token])]
            else:
                found = self.split(part)
            if not found:
                continue
            tokens, names, span = joined(found)
            count += tokens
            ids.update((b"," if begun else b"") + names.encode())
            begun = True
            decoder.feed(span)
        decoder.close()
        return count, ids.hexdigest(), decoder.sha.hexdigest()

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text."""
        out: list[int] = []
        for special, part in self.runs(text or ""):
            names = [str(self.merges.specials[part])] if special else [
                f[1] for f in self.split(part)
            ]
            out += [int(i) for i in ",".join(names).split(",")] if names else []
        return out


class Decoder:
    """Bytes to text, piece by piece; bytes that are not UTF-8 become U+FFFD."""

    def __init__(self):
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.sha = hashlib.sha256()

    def feed(self, data: bytes) -> str:
        text = self.state.decode(data)
        self.sha.update(text.encode("utf-8"))
        return text

    def close(self) -> str:
        text = self.state.decode(b"", True)
        self.sha.update(text.encode("utf-8"))
        return text


def decode(merges: Merges, ids: Iterator[int]) -> str:
    """Text of a stream of ids, specials included."""
    decoder = Decoder()
    out = [decoder.feed(merges.bytes_of[i]) for i in ids]
    return "".join(out) + decoder.close()


def vocabulary_file(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _digests(vocabulary: str, text_at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merges(vocabulary))
        for batch in batches:
            texts = batch.column(text_at)
            out = [encoder.digest(texts[i].as_py()) for i in range(len(texts))]
            arrays = [c for i, c in enumerate(batch.columns) if i != text_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != text_at]
            yield pa.RecordBatch.from_arrays(
                [
                    *arrays,
                    pa.array([o[0] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.string()),
                    pa.array([o[2] for o in out], pa.string()),
                ],
                names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def bpe_digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens, ids_sha256, decoded_sha256`` (columns of these
    names are replaced). ``path`` is the vocabulary file, as the driver sees it; its content goes
    along with the tasks."""
    added = ["n_tokens", "ids_sha256", "decoded_sha256"]
    rows = docs.drop(*added)
    fields = [f for f in rows.schema.fields if f.name != text_col]
    schema = T.StructType(
        [*fields, T.StructField("n_tokens", T.LongType())]
        + [T.StructField(n, T.StringType()) for n in added[1:]]
    )
    run = _digests(vocabulary_file(path), rows.columns.index(text_col))
    return rows.mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of the text in a column ``out``."""
    vocabulary, rows = vocabulary_file(path), docs.drop(out)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merges(vocabulary))
        for batch in batches:
            ids = [encoder.encode(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.list_(pa.int32()))],
                names=[*batch.schema.names, out],
            )

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)


def bpe_decode(tokens: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its ids in a column ``out``; null ids give null."""
    vocabulary, rows = vocabulary_file(path), tokens.drop(out)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(vocabulary)
        for batch in batches:
            found = [None if r is None else decode(merges, r) for r in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, out]
            )

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``."""
    return bpe_digests(docs.select("doc_id", F.col("text")), path)
