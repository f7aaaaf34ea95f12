"""Encoding text to packed token ids, and back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from textloom.functions.text import SPECIAL_TOKENS, nfc, nfc_chunks, pretokens
from textloom.functions.tokens import TOKEN_BYTES, count_id
from textloom.functions.vocabulary import BOS_ID, EOS_ID, ID_OF_BYTE, UNKNOWN_ID, BpeModel
from textloom.operators.bpe import MergeTable
from textloom.session import materialize, small_batches

# Words remembered by one task; the memory is emptied when it is full.
CACHE_WORDS = 500_000
MAX_CHUNK_CHARS = 1_000_000
# Text of one bundle that is put together in one task; a longer text is a bundle of its own.
BUNDLE_CHARS = 4 << 20


def _joined(parts: pa.Array, which: pa.Array, ends: np.ndarray, like: pa.Array) -> pa.Array:
    """Binary rows: row ``i`` is ``parts[which[k]]`` for ``k`` from ``ends[i]`` to ``ends[i + 1]``,
    joined. Null where ``like`` is null.

    Arrow's ``take`` lays the parts out one after the other; a row is a longer cut of that buffer.
    """
    taken = parts.take(which)
    cuts = np.frombuffer(taken.buffers()[1], dtype=np.int32, count=len(taken) + 1)[ends]
    buffers = [None, pa.py_buffer(np.ascontiguousarray(cuts)), taken.buffers()[2]]
    rows = pa.Array.from_buffers(pa.binary(), len(like), buffers)
    return pc.if_else(like.is_valid(), rows, pa.scalar(None, pa.binary()))


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _piece_encoder(model: BpeModel, specials: bool):
    """Arrow function from pre-token lists to packed ids.

    Each batch is dictionary-encoded, so Python sees every distinct word once; the rows are then
    put together by Arrow.
    """
    table = MergeTable(model.merges)
    byte_ids = np.array([ID_OF_BYTE[b] for b in range(256)], dtype=np.int64)
    special_ids = {t: i for i, t in enumerate(SPECIAL_TOKENS)} if specials else {}
    cache: dict[str, bytes] = {}

    def packed_ids(words: list[str]) -> list[bytes]:
        """Packed ids of words, all merged together."""
        raw = [w.encode() for w in words]
        symbols = byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        ids, ends = table.merged(symbols, _ends(np.array([len(r) for r in raw], dtype=np.int64)))
        packed = ids.astype("<u2").tobytes()
        cuts = (ends * TOKEN_BYTES).tolist()
        out = [packed[lo:hi] for lo, hi in zip(cuts, cuts[1:])]
        if special_ids:
            for i, word in enumerate(words):
                if word in special_ids:
                    out[i] = special_ids[word].to_bytes(TOKEN_BYTES, "little")
        return out

    @arrow_udf(T.BinaryType())
    def encode(pieces: pa.Array) -> pa.Array:
        flat = pieces.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        found = [cache.get(w) for w in distinct]
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            if len(cache) + len(missing) > CACHE_WORDS:
                cache.clear()
            for i, ids in zip(missing, packed_ids([distinct[i] for i in missing])):
                found[i] = cache[distinct[i]] = ids
        words = pa.array(found, pa.binary())
        counts = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
        return _joined(words, flat.indices, _ends(counts), pieces)

    return encode


def encode_text(
    text: Column,
    model: BpeModel,
    specials: bool = True,
    boundaries: bool = True,
    chunk_chars: int = MAX_CHUNK_CHARS,
) -> Column:
    """Packed ids of a text. Narrow: no shuffle, and the split into words stays in the JVM.

    Text longer than ``chunk_chars`` is encoded in slices of that size, each on its own. A literal
    special token in the text becomes its id when ``specials`` is set. ``boundaries`` adds the
    begin and end ids of a document.
    """
    packed = encode_words(words_of(text, specials, chunk_chars), model, specials)
    if not boundaries:
        return packed
    return F.concat(_id_bytes(BOS_ID), packed, _id_bytes(EOS_ID))


def encode_words(words: Column | str, model: BpeModel, specials: bool = True) -> Column:
    """Packed ids of a list of words."""
    return _piece_encoder(model, specials)(words)


def words_of(text: Column, specials: bool = True, chunk_chars: int = MAX_CHUNK_CHARS) -> Column:
    """Words of the normalized text in order; words do not reach over slices of a long text."""

    def pieces(t: Column) -> Column:
        return pretokens(t, specials)

    long = F.length(text) > chunk_chars
    return F.when(
        long, F.flatten(F.transform(nfc_chunks(F.when(long, text), chunk_chars), pieces))
    ).otherwise(pieces(nfc(text)))


def word_dictionary(words: DataFrame, model: BpeModel, specials: bool = True) -> DataFrame:
    """``word, n_tokens, packed`` for every distinct ``word``: each is encoded once in the corpus.

    ``packed`` is hexadecimal text, which joins into longer sequences as it is.
    """
    packed = _piece_encoder(model, specials)(F.array("word"))
    distinct = words.filter(F.col("word").isNotNull()).select("word").distinct()
    coded = distinct.select("word", F.hex(packed).alias("packed"))
    return coded.withColumn("n_tokens", (F.length("packed") / (2 * TOKEN_BYTES)).cast("bigint"))


def placed_words(
    df: DataFrame,
    key: list[str],
    text: str,
    specials: bool = True,
    chunk_chars: int = MAX_CHUNK_CHARS,
) -> DataFrame:
    """``key, pos, word`` for every word of every text; a text without words has one row without one."""
    return df.select(*key, F.posexplode_outer(words_of(F.col(text), specials, chunk_chars)).alias("pos", "word"))


def encode_by_dictionary(
    df: DataFrame,
    key: list[str],
    text: str,
    model: BpeModel,
    out: str = "tokens",
    specials: bool = True,
    boundaries: bool = True,
    chunk_chars: int = MAX_CHUNK_CHARS,
) -> DataFrame:
    """``key, <out>``: packed ids as :func:`encode_documents` makes them, from a dictionary of all words.

    Every distinct word of the corpus is encoded once, so that encoding sees the vocabulary of the corpus
    and not its texts. Texts are dealt by key into bundles of about ``BUNDLE_CHARS``; the dictionary is
    joined to the distinct words of each bundle, and a bundle puts its texts together from its own part.
    So what is joined is the words of bundles and not all words of all texts. ``key`` must tell rows
    apart. A null text has null ids.
    """
    small_batches(df.sparkSession)
    none = F.col(text).isNull()
    chars = df.agg(F.sum(F.length(text)).alias("chars")).first().chars or 0
    bundle = F.pmod(F.xxhash64(*key), F.lit(-(-chars // BUNDLE_CHARS) or 1)).alias("_bundle")
    words = words_of(F.col(text), specials, chunk_chars)
    split = df.select(*key, none.alias("_none"), words.alias("_words"))
    copies = split.groupBy(*key, "_none").agg(F.collect_list("_words").alias("_copies"))
    rows = materialize(copies.select("*", bundle), "words")
    asked = rows.select("_bundle", "_copies").groupBy("_bundle").applyInArrow(_bundle_words, "_bundle bigint, word string")
    asked = materialize(asked, "bundle-words")
    dictionary = materialize(word_dictionary(asked, model, specials), "dictionary")
    coded = asked.join(dictionary, "word").select("_bundle", "word", F.unhex("packed").alias("packed"))
    schema = T.StructType([*rows.select(*key, "_none").schema.fields, T.StructField("_packed", T.BinaryType())])
    joined = rows.groupBy("_bundle").cogroup(coded.groupBy("_bundle")).applyInArrow(
        _put_together([*key, "_none"]), schema
    )
    packed = F.col("_packed")
    if boundaries:
        packed = F.concat(_id_bytes(BOS_ID), packed, _id_bytes(EOS_ID))
    return joined.select(*key, F.when(~F.col("_none"), packed).alias(out))


def _bundle_words(table: pa.Table) -> pa.Table:
    """The distinct words of one bundle."""
    words = table.column("_copies").combine_chunks().flatten().flatten().unique()
    bundle = pa.array(np.full(len(words), table.column("_bundle")[0].as_py()), pa.int64())
    return pa.table({"_bundle": bundle, "word": words})


def _put_together(names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Texts of one bundle, as copies under one key, from its part of the dictionary."""

    def put(rows: pa.Table, coded: pa.Table) -> pa.Table:
        copies = rows.column("_copies").combine_chunks()
        texts = copies.flatten()
        at = pc.index_in(texts.flatten(), value_set=coded.column("word").combine_chunks())
        packed = coded.column("packed").combine_chunks()
        cuts = _ends(pc.list_value_length(texts).to_numpy(zero_copy_only=False))
        held = pc.list_value_length(copies).to_numpy(zero_copy_only=False)
        ends = _ends(held)
        whole = _joined(packed, at, cuts[ends], copies)
        if (held > 1).any():
            # Rows that share a key: their words by position, then by ids.
            each = whole.to_pylist()
            for i in np.flatnonzero(held > 1).tolist():
                parts = []
                for k in range(ends[i], ends[i + 1]):
                    ids = packed.take(at.slice(cuts[k], cuts[k + 1] - cuts[k])).to_pylist()
                    parts += enumerate(ids)
                each[i] = b"".join(ids for _, ids in sorted(parts))
            whole = pa.array(each, pa.binary())
        return rows.select(names).append_column("_packed", whole)

    return put


def _id_bytes(token_id: int) -> Column:
    return F.lit(int(token_id).to_bytes(2, "little"))


def encode_documents(
    df: DataFrame,
    text: str,
    model: BpeModel,
    out: str = "tokens",
    specials: bool = True,
    boundaries: bool = True,
    chunk_chars: int = MAX_CHUNK_CHARS,
) -> DataFrame:
    """Adds the packed ids of every document."""
    small_batches(df.sparkSession)
    return df.withColumn(
        out, encode_text(F.col(text), model, specials, boundaries, chunk_chars)
    )


def decode_tokens(packed: Column, model: BpeModel) -> Column:
    """Bytes of a packed sequence, as binary."""
    table = model.token_bytes()

    @arrow_udf(T.BinaryType())
    def decode(rows: pa.Array) -> pa.Array:
        packed_rows = [r or b"" for r in rows.to_pylist()]
        ids = pa.array(np.frombuffer(b"".join(packed_rows), dtype="<u2").astype(np.int32))
        ends = _ends(np.array([len(r) // 2 for r in packed_rows]))
        return _joined(pa.array(table, pa.binary()), ids, ends, rows)

    return decode(packed)


def roundtrip(
    df: DataFrame, text: str, packed: str, model: BpeModel, decoded: str | None = None
) -> DataFrame:
    """Adds ``unknown_tokens`` and ``roundtrip_ok``: decoded ids against the normalized text.

    ``decoded`` names a further column with the decoded text, which is decoded once for both.
    """
    name = decoded or "_decoded"
    back = F.decode(decode_tokens(F.col(packed), model), "UTF-8")
    checked = (
        df.withColumn(name, back)
        .withColumn("unknown_tokens", count_id(F.col(packed), UNKNOWN_ID))
        .withColumn("roundtrip_ok", F.col(name) == nfc(text))
    )
    return checked if decoded else checked.drop(name)


def require_roundtrip(checked: DataFrame) -> None:
    """Raise when any text did not come back."""
    if checked.filter(~F.col("roundtrip_ok")).limit(1).collect():
        raise RuntimeError("some texts did not come back from their tokens")
