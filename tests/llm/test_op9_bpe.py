"""The transducer against the public library, and round trips."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from textloom.llm import op9_bpe as op
from textloom.llm.stages import vocabulary_path

HARD = [
    None, "", " ", "a  b", "x<|endoftext|> <|endoftext|><|endoftext|>y", "\n\n a\t\tb  ", "don't we'll 'tis",
    "é" * 9000, "日本語" * 2000, "a" * 12000, "=-" * 6000, " " * 9000, "　 x  y", "a\U0001f600b" * 2000,
    "\x00\x7f", "1234567890" * 500, "word " * 30000,
]


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def encoder():
    return op.Encoder(op.Merges(op.vocabulary_file(vocabulary_path())))


def test_lookahead_is_small(encoder):
    assert 0 < 4 * encoder.merges.lookahead <= op.BUFFER


def test_random_texts(encoder, public):
    rnd = random.Random(8)
    pools = ["ab", "the and ", "aeiou nt", " \n\ta", "éèñ' s", "0123456789", "=-_*#", "etaoinshrdlu"]
    for turn in range(200):
        pool = rnd.choice(pools)
        text = "".join(rnd.choice(pool) for _ in range(rnd.choice([5, 50, 500, 6000 if turn % 10 == 0 else 90])))
        want = public.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == want
        assert op.decode(encoder.merges, iter(want)) == text


def test_stable_tokens_survive_any_end(encoder, public):
    """What is emitted for a prefix must be what the whole text gives."""
    rnd = random.Random(2)
    text = "".join(rnd.choice("thenandingouea") for _ in range(20_000)).encode()
    got = [t for part in encoder.stream(text[i : i + 777] for i in range(0, len(text), 777)) for t in part]
    assert got == public.encode(text.decode(), add_special_tokens=False).ids


def test_partial_characters_wait():
    decoder = op.Decoder()
    parts = [decoder.feed(bytes([b])) for b in "é😀".encode()]
    assert parts == ["", "é", "", "", "", "😀"]
    assert decoder.feed(b"\xf0\x9f") == "" and decoder.close() == "�"


def test_query_rows(spark, public):
    rows = [(i, t, i, "x") for i, t in enumerate(HARD)] + [(None, "a", 0, "x"), (3, "a  b", 0, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids_sha256 string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text, *_ in rows:
        ids = public.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(public.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in op.digests(frame, vocabulary_path()).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    encoded = op.bpe_encode(frame, vocabulary_path())
    back = op.bpe_decode(encoded, vocabulary_path()).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert op.digests(frame.limit(0), vocabulary_path()).count() == 0
