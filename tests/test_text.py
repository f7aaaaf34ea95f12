import random
import unicodedata

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from textloom.functions import text

EDGE = [
    "",
    " ",
    "\x1c　\x85\xa0\x0b",
    "a" * 63,
    "a" * 64,
    "  " + "a" * 63 + "　",
    " " + "b" * 64 + "\x1f\n",
    "it's  we'll 'twas 's\n's  's",
    "foo  bar\n\n baz\t\tqux 　x",
    "trailing   ",
    "x=1;\n\n\n    return  x\t",
    "éä 한국어 가 ١٢٣ Ⅷ ½",
    "=" * 20000 + " " * 5000 + "z",
    "emoji 😀😀 ok😀",
]


def column(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)


def values(df, expr):
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_strip_blank_and_minimum_follow_python(spark):
    df = column(spark, EDGE + [None])
    assert values(df, text.strip("text")) == [t.strip() for t in EDGE] + [None]
    assert values(df, text.is_blank("text")) == [not t.strip() for t in EDGE] + [True]
    expected = [len(t.strip()) >= 64 for t in EDGE] + [False]
    assert values(df, text.has_min_chars("text")) == expected


def test_words_and_sizes_follow_python(spark):
    df = column(spark, EDGE)
    assert values(df, text.words("text")) == [t.split() for t in EDGE]
    assert values(df, text.word_count("text")) == [len(t.split()) for t in EDGE]
    chars, octets, _ = text.text_stats("text")
    assert values(df, chars) == [len(t) for t in EDGE]
    assert values(df, octets) == [len(t.encode()) for t in EDGE]


def test_nfc(spark):
    df = column(spark, EDGE + [None])
    expected = [unicodedata.normalize("NFC", t) for t in EDGE] + [None]
    assert values(df, text.nfc("text")) == expected


def test_no_code_point_below_the_guard_changes():
    for c in range(0x300):
        for d in (0x41, 0xE9, 0x2FF):
            pair = chr(d) + chr(c)
            assert unicodedata.normalize("NFC", pair) == pair


def test_chunks_cover_the_text(spark):
    df = column(spark, EDGE)
    for size in (1, 7, 1000):
        expected = [[t[k : k + size] for k in range(0, len(t), size)] for t in EDGE]
        assert values(df, text.chunks("text", size)) == expected


def library_pieces(texts):
    """Pre-tokens by the public tokenizers package, as text."""
    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return [[t[a:b] for _, (a, b) in splitter.pre_tokenize_str(t)] for t in texts]


def random_texts(n, seed=1):
    generator = random.Random(seed)
    alphabet = "ab'sdtmlrevé1٣ \n\t　\x85.,!=<>|😀"
    return ["".join(generator.choices(alphabet, k=generator.randint(1, 60))) for _ in range(n)]


def test_pretokens_equal_the_library(spark, sf):
    documents = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = EDGE + random_texts(400) + documents
    assert values(column(spark, texts), text.pretokens("text")) == library_pieces(texts)


def test_special_tokens_are_pieces_of_their_own(spark):
    specials = list(text.SPECIAL_TOKENS)
    tokenizer = Tokenizer(models.WordLevel({"x": 0}, unk_token="x"))
    tokenizer.add_special_tokens(specials)
    generator = random.Random(5)
    plain = random_texts(200, 7)
    texts = [
        p[: len(p) // 2] + generator.choice(specials) * generator.randint(1, 2) + p[len(p) // 2 :]
        for p in plain
    ] + ["  <|user|>", "a  <|endoftext|>  b", "<|nothing|> <|user|", "||<|system|>||"]

    def pieces(t):
        # Cut at the specials, then split each part on its own.
        import re

        parts = re.split("(" + "|".join(map(re.escape, specials)) + ")", t)
        out = []
        for part in parts:
            out += [part] if part in specials else library_pieces([part])[0]
        return out

    assert values(column(spark, texts), text.pretokens("text", specials=True)) == [
        pieces(t) for t in texts
    ]


@pytest.mark.parametrize("seed", [0, 1])
def test_nfc_equals_the_library(spark, seed):
    texts = [t + "ȩ́가" for t in random_texts(50, seed)]
    normalizer = normalizers.NFC()
    expected = [normalizer.normalize_str(t) for t in texts]
    assert values(column(spark, texts), text.nfc("text")) == expected


def test_cap(spark):
    assert values(column(spark, ["😀ab"]), text.cap_chars(F.col("text"), 2)) == ["😀a"]
