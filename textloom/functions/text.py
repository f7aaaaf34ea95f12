"""Column functions over document text."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# White space as Python's str.strip()/str.split() see it.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(c) for c in (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
NOT_SPACE_CLASS = r"[^\s\x{1c}-\x{1f}]"

# The published GPT-2 split pattern and the seven special tokens, in id order.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPECIAL_TOKENS = (
    "<|beginoftext|>",
    "<|endoftext|>",
    "<|padding|>",
    "<|unknown|>",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
)

SPLIT_PATTERN = (
    rf"(?U){CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+"
)
_SPECIAL = "(?:" + "|".join(t.replace("|", r"\|") for t in SPECIAL_TOKENS) + ")"
# The same split for text that holds special tokens: each one is a piece of its own, and ends the
# text before it just as the end of the document would.
SPLIT_PATTERN_WITH_SPECIALS = (
    rf"(?U){_SPECIAL}|{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+"
    rf"| ?(?:(?!{_SPECIAL})[^\s\p{{L}}\p{{N}}])++|\s+(?!(?!{_SPECIAL})\S)|\s+"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Python ``str.strip``: Unicode white space off both ends."""
    return F.btrim(_col(text), F.lit(SPACES))


def is_blank(text: Column | str) -> Column:
    """Null counts as blank."""
    return F.coalesce(strip(text) == "", F.lit(True))


def has_min_chars(text: Column | str, minimum: int = 64) -> Column:
    """True when the stripped text has at least ``minimum`` code points; null text is False.

    ``length`` alone settles short texts and texts without white space at the ends; only the rest
    is stripped.
    """
    text = _col(text)
    long = F.length(text) >= minimum
    ragged = F.substring(text, 1, 1).isin(*SPACES) | F.substring(text, -1, 1).isin(*SPACES)
    return F.coalesce(
        F.when(long & ragged, F.length(strip(text)) >= minimum).otherwise(long), F.lit(False)
    )


def cap_chars(text: Column | str, maximum: int) -> Column:
    """First ``maximum`` code points."""
    return F.substring(_col(text), 1, maximum)


def chunks(text: Column | str, size: int) -> Column:
    """Array of consecutive slices of ``size`` code points, found in one pass over the text."""
    return F.regexp_extract_all(_col(text), F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))


@arrow_udf(T.StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()],
        pa.string(),
    )


@arrow_udf(T.ArrayType(T.StringType()))
def _nfc_each(slices: pa.Array) -> pa.Array:
    return pa.array(
        [
            None if row is None else [unicodedata.normalize("NFC", t) for t in row]
            for row in slices.to_pylist()
        ],
        pa.list_(pa.string()),
    )


def _may_change(text: Column) -> Column:
    return (F.octet_length(text) > F.length(text)) & text.rlike(r"[\x{300}-\x{10FFFF}]")


def nfc_chunks(text: Column, size: int) -> Column:
    """:func:`chunks` of the raw text, each slice in NFC on its own."""
    raw = chunks(text, size)
    return F.coalesce(_nfc_each(F.when(_may_change(text), raw)), raw)


def nfc(text: Column | str) -> Column:
    """Unicode NFC. Only text with a code point from U+0300 up can change, so only that text is
    handed to Python; everything else stays in the JVM."""
    text = _col(text)
    return F.coalesce(_nfc(F.when(_may_change(text), text)), text)


def pretokens(text: Column | str, specials: bool = False) -> Column:
    """Array of byte-level pre-tokens. With ``specials`` a literal special token is one piece."""
    text = _col(text)
    plain = F.regexp_extract_all(text, F.lit(SPLIT_PATTERN), F.lit(0))
    if not specials:
        return plain
    marked = F.regexp_extract_all(text, F.lit(SPLIT_PATTERN_WITH_SPECIALS), F.lit(0))
    return F.when(F.contains(text, F.lit("<|")), marked).otherwise(plain)


def word_count(text: Column | str) -> Column:
    """Number of white-space separated words, as ``len(text.split())``."""
    return F.regexp_count(_col(text), F.lit(rf"(?U){NOT_SPACE_CLASS}+")).cast("bigint")


def words(text: Column | str) -> Column:
    """White-space separated words."""
    return F.regexp_extract_all(_col(text), F.lit(rf"(?U){NOT_SPACE_CLASS}+"), F.lit(0))


def text_stats(text: Column | str) -> list[Column]:
    """Code points, UTF-8 bytes and words of a text."""
    text = _col(text)
    return [
        F.length(text).cast("bigint").alias("chars"),
        F.octet_length(text).cast("bigint").alias("utf8_bytes"),
        word_count(text).alias("words"),
    ]
