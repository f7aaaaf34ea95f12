"""Jaccard join on word shingles by vertical partitioning.

The global order of all shingles (that of their 64-bit hashes) is cut into fragments of equal width;
every document is thereby cut into segments, one for each fragment it touches. A segment names its
document by the number of the batch that cut it and a number in that batch, so what travels is
about the shingles themselves, however many fragments there are.

1. In each fragment, only shingles that some other document has can count in an overlap. They are
   found there, segments are cut down to them, and a document whose shared shingles cannot reach the
   threshold against its own size drops out. No document pair is looked at so far.
2. What is left is put in the order *rare first*. Two linked documents share a shingle among the
   first ``n - ceil(t * n) + 1`` of each (prefix filter); lists of documents by such a shingle are
   the candidates.
3. Lists are not paired out. Rounds compare the members of a list with one leader each: the overlap
   of a pair is counted in each fragment separately and summed. Linked documents merge into
   components; a list whose members are all in one component is done.
4. In the lists that are still mixed, members outside the list's largest component are compared with
   all members: in lists of up to ``SHORT_LIST`` as pairs; for longer ones, with all of the component
   and with each other, in blocks of bounded size, which give one link for each component they
   touch. So no link between different components is missed, and no group is paired out.

Documents with equal sets are one node throughout. Results: documents without words (null and empty
texts too) have size 0 and stay alone; a null id is allowed and never names a component; repeated
rows are returned as often as they come; an empty table gives an empty result. Further columns of
the input do not matter. Numbers of batches come from the partitions of ``docs``, so a task
that runs again must find its rows in the same order: ``docs`` should come from files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import WordHashes, components, lower_words, slices
from textloom.session import materialize, small_batches

TEXT_BYTES = 4 << 20
# A task holds one fragment: this many for each core, more where a fragment would have too many documents.
FRAGMENTS_PER_CORE, DOCS_PER_FRAGMENT = 16, 8192
BATCH_TOKENS = 1_000_000
# Words whose hash a task remembers.
KNOWN_WORDS = 250_000
TOLD_KEYS = 1_000_000
BLOCK = 256
SHORT_LIST = 64
BITMAP_WORDS = 8
VERIFY_FRAGMENTS = 8
# Numbers of sets: those of the task, of its batch, and of the set in the batch.
BATCH_BITS, SET_BITS = 24, 16

PIECES = "frag int, kind int, batch bigint, at binary, toks binary, ids array<bigint>, keys array<binary>, sizes array<int>"
SEGMENTS = "is_doc boolean, id bigint, key binary, n int, set bigint, toks array<bigint>"
OPEN, SEEN, SHARED, DOCS = range(4)
NO_SET = 65_535


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str | None], width: int, words: WordHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    runs = [lower_words(t) for t in texts]
    sizes = [len(r) for r in runs]
    flat = np.fromiter(
        (words[w] for run in runs for w in run), dtype=np.uint64, count=sum(sizes)
    )
    rolled = np.full(max(0, len(flat) - width + 1), width, dtype=np.uint64)
    for i in range(width if len(rolled) else 0):
        rolled = _mix(rolled + flat[i : i + len(rolled)])
    sets, start = [], 0
    for size in sizes:
        if size >= width:
            sets.append(np.unique(rolled[start : start + size - width + 1]))
        elif size:
            whole = np.full(1, size, dtype=np.uint64)
            for i in range(size):
                whole = _mix(whole + flat[start + i : start + i + 1])
            sets.append(whole)
        else:
            sets.append(flat[:0])
        start += size
    return sets


def _pack(tokens: np.ndarray) -> bytes:
    """The first token in eight bytes, then the steps between neighbours in four or six bytes each
    where they fit, which they do in a full batch of sorted tokens; otherwise all in eight bytes."""
    if len(tokens) > 1 and (tokens[1:] >= tokens[:-1]).all():
        steps = np.diff(tokens).astype("<u8")
        for width in (4, 6):
            if steps.max() < 1 << 8 * width:
                low = steps.view(np.uint8).reshape(-1, 8)[:, :width]
                return bytes([width]) + tokens[:1].astype("<u8").tobytes() + low.tobytes()
    return bytes([8]) + tokens.astype("<u8").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    width = packed[0]
    if width == 8:
        return np.frombuffer(packed, dtype="<u8", offset=1)
    low = np.frombuffer(packed, dtype=np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(low), 8), dtype=np.uint8)
    steps[:, :width] = low
    first = np.frombuffer(packed, dtype="<u8", offset=1, count=1)
    return np.cumsum(np.r_[first, steps.reshape(-1).view("<u8")], dtype=np.uint64)


def _fragment_of(tokens: np.ndarray, fragments: int) -> np.ndarray:
    """Equal ranges of the token order."""
    return ((tokens >> np.uint64(40)) * np.uint64(fragments)) >> np.uint64(24)


def _cut(width: int, fragments: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents to segments. A token that occurs in two documents of the same batch is known to be
    shared; its fragment only learns that it exists, so no common token gathers in one task."""

    schema = pa.schema(
        [
            ("frag", pa.int32()),
            ("kind", pa.int32()),
            ("batch", pa.int64()),
            ("at", pa.binary()),
            ("toks", pa.binary()),
            ("ids", pa.list_(pa.int64())),
            ("keys", pa.list_(pa.binary())),
            ("sizes", pa.list_(pa.int32())),
        ]
    )

    def rows_of(kind, batch, token, at, frag) -> list[dict]:
        """A row for each run of equal ``frag`` (ascending)."""
        out = []
        cuts = np.flatnonzero(np.diff(frag)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(frag)]):
            if hi == lo:
                continue
            row = {"frag": int(frag[lo]), "kind": kind, "toks": _pack(token[lo:hi])}
            if at is not None:
                row |= {"batch": batch, "at": at[lo:hi].astype("<u2").tobytes()}
            out.append(row)
        return out

    def flush(batch, ids, keys, sizes, sets, told) -> pa.RecordBatch:
        salt = int.from_bytes(keys[0][:6], "little") % fragments
        # Sets that an earlier batch of this task has cut stand for these too.
        distinct = [i for k, i in {k: i for i, k in enumerate(keys)}.items() if k not in told]
        number = np.full(len(keys), NO_SET)
        number[distinct] = np.arange(len(distinct))
        out = [
            {
                "frag": (salt + i) % fragments,
                "kind": DOCS,
                "batch": batch,
                "at": number[i : i + 1024].astype("<u2").tobytes(),
                "ids": ids[i : i + 1024],
                "keys": keys[i : i + 1024],
                "sizes": sizes[i : i + 1024],
            }
            for i in range(0, len(ids), 1024)
        ]
        if len(told) + len(distinct) > TOLD_KEYS:
            told.clear()
        told.update(keys[i] for i in distinct)
        token = np.concatenate([np.empty(0, np.uint64), *[sets[i] for i in distinct]])
        at = np.repeat(
            np.arange(len(distinct), dtype=np.int64), [len(sets[i]) for i in distinct]
        )
        order = np.argsort(token, kind="stable")
        token, at = token[order], at[order]
        if len(token):
            first = np.r_[True, token[1:] != token[:-1]]
            alone = first & np.r_[first[1:], True]
            frag = _fragment_of(token, fragments).astype(np.int64)
            out += rows_of(OPEN, batch, token[alone], at[alone], frag[alone])
            seen = first & ~alone
            out += rows_of(SEEN, batch, token[seen], None, frag[seen])
            shared = np.flatnonzero(~alone)
            shared = shared[np.argsort(at[shared], kind="stable")]
            lot = (salt + at[shared] // 1024) % fragments
            back = np.argsort(lot, kind="stable")
            shared, lot = shared[back], lot[back]
            out += rows_of(SHARED, batch, token[shared], at[shared], lot)
        return pa.RecordBatch.from_pylist(out, schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, told = WordHashes(KNOWN_WORDS), set()
        batch_number = TaskContext.get().partitionId() << BATCH_BITS
        ids, keys, sizes, sets, held = [], [], [], [], 0
        for batch in batches:
            batch_ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts, lambda t: len(t or ""), TEXT_BYTES):
                for doc, tokens in zip(
                    batch_ids[lo:hi], shingle_sets(texts[lo:hi], width, words)
                ):
                    ids.append(doc)
                    keys.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                    sizes.append(len(tokens))
                    sets.append(tokens)
                    held += len(tokens)
                    if held >= BATCH_TOKENS or len(ids) >= NO_SET:
                        yield flush(batch_number, ids, keys, sizes, sets, told)
                        batch_number += 1
                        ids, keys, sizes, sets, held = [], [], [], [], 0
        if ids:
            yield flush(batch_number, ids, keys, sizes, sets, told)

    return cut


def _by_set(tokens: np.ndarray, sets: np.ndarray) -> list[pa.Table]:
    """One row for each set with its tokens."""
    if not len(tokens):
        return []
    order = np.argsort(sets, kind="stable")
    tokens, sets = tokens[order], sets[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(sets)) + 1]
    rows = len(cuts)
    return [
        pa.table(
            {
                "is_doc": pa.array(np.zeros(rows, dtype=bool)),
                "id": pa.nulls(rows, pa.int64()),
                "key": pa.nulls(rows, pa.binary()),
                "n": pa.nulls(rows, pa.int32()),
                "set": pa.array(sets[cuts]),
                "toks": pa.ListArray.from_arrays(
                    pa.array(np.r_[cuts, len(tokens)], pa.int32()), pa.array(tokens.view(np.int64))
                ),
            }
        )
    ]


def _set_numbers(part: pa.Table) -> np.ndarray:
    """Numbers of the sets that ``at`` names, ``NO_SET`` included, row after row."""
    at = [np.frombuffer(a, dtype="<u2").astype(np.int64) for a in part.column("at").to_pylist()]
    batch = np.repeat(part.column("batch").to_numpy(), [len(a) for a in at])
    return (batch << SET_BITS) + np.concatenate(at)


def _tokens(part: pa.Table) -> np.ndarray:
    return np.concatenate([_unpack(t) for t in part.column("toks").to_pylist()])


def _fragment(table: pa.Table) -> pa.Table:
    """All segments of one fragment: keeps the tokens that occur in two documents or more."""
    kinds = table.column("kind").to_numpy()
    out = []
    part = table.filter(pa.array(kinds == OPEN))
    if part.num_rows:
        tokens, sets = _tokens(part), _set_numbers(part)
        seen = table.filter(pa.array(kinds == SEEN))
        order = np.argsort(tokens, kind="stable")
        tokens, sets = tokens[order], sets[order]
        first = np.r_[True, tokens[1:] != tokens[:-1]]
        shared = ~(first & np.r_[first[1:], True])
        if seen.num_rows:
            known = np.unique(_tokens(seen))
            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            shared |= known[at] == tokens
        out += _by_set(tokens[shared], sets[shared])
    part = table.filter(pa.array(kinds == SHARED))
    if part.num_rows:
        out += _by_set(_tokens(part), _set_numbers(part))
    part = table.filter(pa.array(kinds == DOCS))
    if part.num_rows:
        ids = part.column("ids").combine_chunks().flatten()
        sets = _set_numbers(part)
        out.append(
            pa.table(
                {
                    "is_doc": pa.array(np.ones(len(ids), dtype=bool)),
                    "id": ids,
                    "key": part.column("keys").combine_chunks().flatten(),
                    "n": part.column("sizes").combine_chunks().flatten(),
                    "set": pa.array(sets, mask=(sets & NO_SET) == NO_SET),
                    "toks": pa.nulls(len(ids), pa.list_(pa.int64())),
                }
            )
        )
    if not out:
        return pa.table(
            {
                "is_doc": pa.array([], pa.bool_()),
                "id": pa.array([], pa.int64()),
                "key": pa.array([], pa.binary()),
                "n": pa.array([], pa.int32()),
                "set": pa.array([], pa.int64()),
                "toks": pa.array([], pa.list_(pa.int64())),
            }
        )
    return pa.concat_tables(out)


def _block_links(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links of one block pair: outsiders against members, one for each component touched."""

    def link(table: pa.Table) -> pa.Table:
        out = table.column("outside").to_numpy(zero_copy_only=False).astype(bool)
        keys = table.column("key").to_pylist()
        comps = table.column("comp").to_pylist()
        n = table.column("n").to_numpy().astype(np.int64)
        toks = table.column("toks").combine_chunks()
        flat = toks.flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(keys)), toks.value_lengths().to_numpy(zero_copy_only=False))
        rows, cols = np.flatnonzero(out), np.flatnonzero(~out)
        place = np.full(len(keys), -1)
        place[rows] = np.arange(len(rows))
        # Columns of the matrix: the tokens of the outsiders, in slabs of bounded width.
        vocabulary = np.unique(flat[out[doc]])
        overlap = np.zeros((len(rows), len(cols)), dtype=np.float32)
        where = np.full(len(keys), -1)
        where[cols] = np.arange(len(cols))
        for lo in range(0, len(vocabulary), 8192):
            slab = vocabulary[lo : lo + 8192]
            at = np.minimum(np.searchsorted(slab, flat), len(slab) - 1)
            hit = slab[at] == flat
            left = np.zeros((len(rows), len(slab)), dtype=np.float32)
            right = np.zeros((len(cols), len(slab)), dtype=np.float32)
            mine = hit & out[doc]
            left[place[doc[mine]], at[mine]] = 1
            yours = hit & ~out[doc]
            right[where[doc[yours]], at[yours]] = 1
            overlap += left @ right.T
        overlap = overlap.astype(np.int64)
        union = n[rows][:, None] + n[cols][None, :] - overlap
        linked = 100 * overlap >= percent * union
        a, b = [], []
        for i in np.flatnonzero(linked.any(axis=1)):
            told = {comps[rows[i]]}
            for j in np.flatnonzero(linked[i]):
                if comps[cols[j]] not in told:
                    told.add(comps[cols[j]])
                    a.append(keys[rows[i]])
                    b.append(keys[cols[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def _segments(docs: DataFrame, width: int) -> DataFrame:
    """Documents and their shared tokens, by fragment; written once."""
    small_batches(docs.sparkSession)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    fragments = max(FRAGMENTS_PER_CORE * cores, -(-docs.count() // DOCS_PER_FRAGMENT))
    pieces = docs.mapInArrow(_cut(width, fragments), PIECES)
    return materialize(pieces.groupBy("frag").applyInArrow(_fragment, SEGMENTS), "segments")


def _sets(segments: DataFrame) -> DataFrame:
    """``key, rep, n, node``: equal sets by the digest of the set, with their smallest document and one
    of the numbers they were cut under."""
    listed = segments.filter("is_doc AND n > 0").groupBy("key")
    sets = listed.agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.min("set").alias("node"))
    return materialize(sets, "sets")


def _candidates(segments: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``key, n, c, centre, toks``: sets (by ``node``) that can have a partner, with their shared tokens
    from the rarest to the most common, and how common they are on average."""
    # All tokens of a set with copies are shared, so one of the copies tells everything.
    pieces = segments.filter("NOT is_doc").groupBy(F.col("set").alias("key"))
    whole = pieces.agg(F.flatten(F.collect_list("toks")).alias("toks"))
    alive = whole.join(sets.select(F.col("node").alias("key"), "n"), "key").filter(
        F.size("toks") * 100 >= F.col("n") * percent
    )
    tokens = materialize(alive.select("key", "n", F.explode("toks").alias("tok")), "tokens")
    df = tokens.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1")
    shared = tokens.join(df, "tok").groupBy("key").agg(
        F.max("n").alias("n"),
        F.sum("df").alias("weight"),
        F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("toks"),
    )
    kept = shared.select(
        "key",
        "n",
        F.size("toks").alias("c"),
        (F.col("weight") / F.col("n")).alias("centre"),
        F.col("toks.tok").alias("toks"),
    )
    return materialize(kept.filter(F.col("c") * 100 >= F.col("n") * percent), "candidates")


def _bitmaps(kept: DataFrame) -> DataFrame:
    """``key, n, c, bits``: parities of the shared tokens in a bitmap of fixed size."""
    tokens = kept.select("key", "n", "c", F.explode("toks").alias("tok"))
    bit = F.expr(f"shiftleft(1L, CAST(shiftright(tok, {BITMAP_WORDS.bit_length() - 1}) & 63 AS INT))")
    mine = F.col("tok").bitwiseAND(F.lit(BITMAP_WORDS - 1))
    words = [F.bit_xor(F.when(mine == w, bit)).alias(f"w{w}") for w in range(BITMAP_WORDS)]
    filled = [F.coalesce(f"w{w}", F.lit(0).cast("bigint")) for w in range(BITMAP_WORDS)]
    bits = tokens.groupBy("key", "n", "c").agg(*words)
    return materialize(bits.select("key", "n", "c", F.array(*filled).alias("bits")), "bitmaps")


def _possible(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs that can reach the threshold as far as bitmaps tell: where two bitmaps differ in ``d``
    places the sets differ in ``d`` tokens at least, which bounds their overlap from above."""
    for side in ("a", "b"):
        named = [F.col(x).alias(f"{x}_{side}") for x in ("n", "c", "bits")]
        pairs = pairs.join(bitmaps.select(F.col("key").alias(side), *named), side)
    differ = F.aggregate(
        F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda held, x: held + x,
    )
    most = (F.col("c_a") + F.col("c_b") - differ) * (100 + percent)
    return pairs.filter(most >= (F.col("n_a") + F.col("n_b")) * 2 * percent).select("a", "b")


def _verified(pairs: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` that reach the threshold: overlaps by fragment, then summed."""
    low_bits = 64 - (VERIFY_FRAGMENTS.bit_length() - 1)
    pieces = (
        kept.select("key", "n", F.explode("toks").alias("tok"))
        .groupBy("key", "n", F.shiftright("tok", low_bits).alias("frag"))
        .agg(F.collect_list("tok").alias("toks"))
    )
    left = pieces.select(F.col("key").alias("a"), F.col("n").alias("n_a"), "frag", "toks")
    right = pieces.select(
        F.col("key").alias("b"), F.col("n").alias("n_b"), "frag", F.col("toks").alias("others")
    )
    partial = pairs.join(left, "a").join(right, ["b", "frag"])
    common = F.size(F.array_intersect("toks", "others"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum(common).alias("common"))
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return summed.filter(F.col("common") * 100 >= union * percent).select("a", "b")


def _with_components(postings: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return postings.withColumn("comp", F.col("key"))
    roots = found.select(F.col("node").alias("key"), F.col("root").alias("_root"))
    return postings.join(roots, "key", "left").select(
        *postings.columns, F.coalesce("_root", "key").alias("comp")
    )


def _links(kept: DataFrame, percent: int, rounds: int) -> DataFrame | None:
    """Links that connect all that is connected."""
    least = F.floor((F.col("n") * percent + 99) / 100)
    first = F.col("n") - least + 1 - (F.col("n") - F.col("c"))
    prefix = kept.filter(first > 0).select(
        "key", "n", "centre", F.explode(F.slice("toks", F.lit(1), first.cast("int"))).alias("tok")
    )
    prefix = materialize(prefix, "prefix")
    bitmaps = _bitmaps(kept)
    links = found = None
    for turn in range(rounds):
        postings = _with_components(prefix, found)
        rank = F.col("centre") if turn == 0 else F.xxhash64(F.lit(turn), "tok", "key")
        lists = postings.groupBy("tok").agg(
            F.max(F.struct(rank.alias("rank"), "key", "n", "comp")).alias("lead"),
            F.min("comp").alias("low"),
            F.max("comp").alias("high"),
            F.count("*").alias("members"),
        )
        # After the first round a list of two has been compared in full.
        lists = lists.filter((F.col("low") < F.col("high")) & (F.col("members") > min(turn, 1) + 1))
        paired = postings.join(lists.select("tok", "lead"), "tok")
        fits = F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * percent
        paired = paired.filter((F.col("comp") != F.col("lead.comp")) & fits)
        pairs = paired.select(
            F.least("key", "lead.key").alias("a"), F.greatest("key", "lead.key").alias("b")
        ).distinct()
        pairs = _possible(pairs, bitmaps, percent)
        new = materialize(_verified(pairs, kept, percent), "links")
        links = new if links is None else links.union(new)
        found = components(links)
    return links.union(_mixed(prefix, kept, bitmaps, found, percent))


def _mixed(
    prefix: DataFrame, kept: DataFrame, bitmaps: DataFrame, found: DataFrame, percent: int
) -> DataFrame:
    """Links across components in lists that are still mixed: those of bounded length pair by pair
    (which finds a pair once, however many lists it is in), longer ones in blocks."""
    postings = _with_components(prefix, found)
    sizes = postings.groupBy("tok", "comp").agg(F.count("*").alias("members"))
    lists = sizes.groupBy("tok").agg(
        F.max(F.struct("members", "comp")).alias("main"),
        F.sum("members").alias("all"),
        F.count("*").alias("comps"),
    )
    lists = lists.filter("comps > 1 AND all > 2").select(
        "tok",
        "all",
        F.col("main.comp").alias("main"),
    )
    short = postings.join(
        lists.filter(F.col("all") <= SHORT_LIST).select("tok", "main"), "tok"
    ).select("tok", "key", "n", "comp", "main")
    other = short.select("tok", *[F.col(x).alias(f"other_{x}") for x in ("key", "n", "comp")])
    fits = F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * percent
    pairs = short.filter(F.col("comp") != F.col("main")).join(other, "tok").filter(
        (F.col("comp") != F.col("other_comp")) & fits
    )
    pairs = pairs.select(
        F.least("key", "other_key").alias("a"), F.greatest("key", "other_key").alias("b")
    ).distinct()
    by_pair = _verified(_possible(pairs, bitmaps, percent), kept, percent)
    rows = postings.join(lists.filter(F.col("all") > SHORT_LIST).select("tok", "main"), "tok")
    outsiders = materialize(rows.filter(F.col("comp") != F.col("main")), "outsiders")
    # Against the main component as a whole: once, whichever lists they share.
    asked = outsiders.select("key", "comp", "main").distinct()
    members = _with_components(kept.select("key"), found)
    lots = asked.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("lots"))
    members = members.join(lots.withColumnRenamed("main", "comp"), "comp")
    blocks = members.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = members.join(blocks, "comp").withColumn("main", F.col("comp"))
    asked = asked.join(lots, "main").join(blocks.withColumnRenamed("comp", "main"), "main")
    whole = F.concat(F.lit("c"), F.hex("main"))
    # Against the other outsiders of the list.
    sizes = outsiders.groupBy("tok").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("lots"))
    others = outsiders.join(sizes, "tok").withColumn("blocks", F.col("lots"))
    listed = F.concat(F.lit("t"), F.col("tok"))
    both = _dealt(asked, whole, True).union(_dealt(members, whole, False))
    both = both.union(_dealt(others, listed, True)).union(_dealt(others, listed, False))
    both = both.join(kept.select("key", "n", "toks"), "key")
    return materialize(
        both.groupBy("group", "lot", "block")
        .applyInArrow(_block_links(percent), "a bigint, b bigint")
        .distinct()
        .union(by_pair),
        "links",
    )


def _dealt(rows: DataFrame, group: Column, outside: bool) -> DataFrame:
    """Rows of block pairs: outsiders are in one lot and meet all blocks, members the other way."""
    h = F.xxhash64("key")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks" if outside else "lots") - 1))
    one = F.pmod(h, F.col("lots" if outside else "blocks")).cast("int")
    return rows.select(
        group.alias("group"),
        "key",
        "comp",
        F.lit(outside).alias("outside"),
        (one if outside else every).alias("lot"),
        (every if outside else one).alias("block"),
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 80,
    width: int = 5,
    rounds: int = 2,
) -> DataFrame:
    """``<id_col>, n_shingles, component_id`` for every row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    segments = _segments(rows, width)
    listed = segments.filter("is_doc").select("id", "key", "n")
    sets = _sets(segments)
    kept = _candidates(segments, sets, percent)
    found = components(_links(kept, percent, rounds))
    merged = sets.select("key", "rep", "node").join(found, "node", "left")
    merged = merged.withColumn("root", F.coalesce("root", "node"))
    lowest = merged.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = merged.join(lowest, "root").select("key", "component_id")
    keyed = listed.withColumn("key", F.when(F.col("n") > 0, F.col("key")))
    return keyed.join(classes, "key", "left").select(
        F.col("id").alias(id_col),
        F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
