import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders, models, normalizers, pre_tokenizers, trainers

from textloom.functions.text import SPECIAL_TOKENS
from textloom.functions.tokens import token_count, unpack_ids
from textloom.functions.vocabulary import FIRST_MERGE_ID, ID_OF_BYTE, BpeModel
from textloom.operators import bpe, encode
from textloom.plans import evaluation, tokenizer


def library(texts, vocab_size):
    """The public tokenizers package on the same texts."""
    made = Tokenizer(models.BPE(unk_token="<|unknown|>"))
    made.normalizer = normalizers.NFC()
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    made.decoder = decoders.ByteLevel()
    trainer = trainers.BpeTrainer(
        vocab_size=vocab_size,
        min_frequency=2,
        special_tokens=list(SPECIAL_TOKENS),
        initial_alphabet=pre_tokenizers.ByteLevel.alphabet(),
        show_progress=False,
    )
    made.train_from_iterator(texts, trainer)
    return made


def library_merges(made):
    """The learned merges as pairs of byte strings."""
    import json

    to_byte = {}
    for c in pre_tokenizers.ByteLevel.alphabet():
        to_byte[c] = bytes([c_to_byte(c)])
    merges = json.loads(made.to_str())["model"]["merges"]
    decode = lambda t: b"".join(to_byte[c] for c in t)
    return [tuple(decode(t) for t in (m if isinstance(m, list) else m.split(" "))) for m in merges]


def c_to_byte(c):
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    code = ord(c)
    return code if code in shown else hidden[code - 256]


def our_merges(model):
    table = model.token_bytes()
    return [(table[l], table[r]) for l, r, _, _ in model.merges]


def one_by_one(words, merges, min_frequency=2):
    """Plain sequential BPE over ``{word: n}``."""
    state = [([ID_OF_BYTE[b] for b in w.encode()], n) for w, n in words.items()]
    table = BpeModel().token_bytes()
    ids = {t: i for i, t in enumerate(table)}
    out = []
    while len(out) < merges:
        pairs = Counter()
        for s, n in state:
            for p in zip(s, s[1:]):
                pairs[p] += n
        if not pairs:
            break
        (left, right), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        if n < min_frequency:
            break
        text = table[left] + table[right]
        if text not in ids:
            ids[text] = len(table)
            table.append(text)
        new = ids[text]
        out.append((left, right, new, n))
        for s, _ in state:
            i = 0
            while i + 1 < len(s):
                if s[i] == left and s[i + 1] == right:
                    s[i : i + 2] = [new]
                i += 1
    return out


def counts_frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)


@pytest.mark.parametrize(("seed", "fragments"), [(0, 12), (1, 40), (2, 10_000)])
def test_training_equals_one_merge_at_a_time(spark, monkeypatch, seed, fragments):
    monkeypatch.setattr(bpe, "FIRST_HOT", 6)
    monkeypatch.setattr(bpe, "LINEAGE_ROUNDS", 3)
    generator = random.Random(seed)
    words = {}
    while len(words) < 120:
        word = "".join(generator.choices("aab b é", k=generator.randint(1, 9)))
        words[word] = generator.choice([1, 2, 2, 3, 5, 8])
    words |= {"aaaaaaa": 9, "aaaa": 3, "abababa": 4}
    size = FIRST_MERGE_ID + (16 if fragments < 20 else 40)
    model = bpe.train_bpe(counts_frame(spark, words), size, fragments=fragments)
    expected = one_by_one(words, 200)
    assert model.merges == expected[: len(model.merges)]
    assert model.vocab_size() == size or len(model.merges) == len(expected)


@pytest.fixture(scope="module")
def corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    return docs, [r.text for r in docs.orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def trained(spark, corpus):
    docs, _ = corpus
    return bpe.train_bpe(bpe.pretoken_counts(docs, "text"), 500)


def test_training_equals_the_library(corpus, trained):
    _, texts = corpus
    made = library(texts, 500)
    assert our_merges(trained) == library_merges(made)
    assert made.get_vocab_size() == trained.vocab_size() == 500


def test_thousands_of_merges_equal_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = bpe.pretoken_counts(docs, "text")
    model = bpe.train_bpe(counts, FIRST_MERGE_ID + 2500)
    texts = [r.text for r in docs.select("text").collect()]
    assert our_merges(model) == library_merges(library(texts, FIRST_MERGE_ID + 2500))
    assert len(model.merges) >= 2500 and model.prefix(500).vocab_size() == 500
    assert model.prefix(500).merges == model.merges[:237]


def test_merges_into_a_known_token(spark):
    # "abc" comes from ab + c and from a + bc, so the same bytes are merged twice into one token.
    words = {"abc": 9, "xbc": 30, "abd": 20, "bcabcab": 4, "aabbcc": 3, "abcabc": 5}
    model = bpe.train_bpe(counts_frame(spark, words), FIRST_MERGE_ID + 30)
    assert model.merges == one_by_one(words, 200)[: len(model.merges)]


def test_long_and_odd_words(spark):
    words = {"a" * 5001: 2, "a" * 5000: 3, "é" * 300: 2, "x": 50, "xy": 1}
    model = bpe.train_bpe(counts_frame(spark, words), FIRST_MERGE_ID + 12)
    assert model.merges == one_by_one(words, 12)
    assert bpe.train_bpe(counts_frame(spark, words).limit(0), 300).merges == []


def test_encoding_by_dictionary_equals_the_narrow_form(spark, corpus, trained):
    _, texts = corpus
    extra = ["x  <|endoftext|> y", "", " ", "नेपाल e\u0301", "ab " * 4000, None]
    rows = list(enumerate(texts + extra))
    df = spark.createDataFrame(rows, "i int, text string").repartition(4)
    for chunk, boundaries, specials in [(1_000_000, True, True), (50, False, False)]:
        options = {"chunk_chars": chunk, "boundaries": boundaries, "specials": specials}
        narrow = encode.encode_documents(df, "text", trained, **options)
        wide = encode.encode_by_dictionary(df, ["i"], "text", trained, **options)
        want = {r.i: r.tokens for r in narrow.collect()}
        got = {r.i: r.tokens for r in wide.collect()}
        assert len(got) == len(rows) and got == want
    words = encode.placed_words(df, ["i"], "text")
    sizes = encode.word_dictionary(words, trained).agg(F.count("*"), F.count_distinct("word")).first()
    assert sizes[0] == sizes[1]


def test_stored_model_is_trained_once(spark, trained, tmp_path):
    calls = []

    def train():
        calls.append(1)
        return trained

    path = str(tmp_path / "model")
    for _ in range(2):
        assert tokenizer.stored_or_trained(spark, path, train).merges == trained.merges
    assert calls == [1]


def test_encoding_equals_the_library(spark, corpus, trained):
    docs, texts = corpus
    made = library(texts, 500)
    extra = ["x  <|endoftext|> y", "<|user|><|assistant|>", "", " ", "नेपाल é", "a" * 500, None]
    rows = list(enumerate(texts[:80] + extra))
    df = spark.createDataFrame(rows, "i int, text string").repartition(4)
    out = encode.encode_documents(df, "text", trained, boundaries=False)
    found = out.select("i", unpack_ids(F.col("tokens")).alias("ids")).orderBy("i").collect()
    for (_, t), row in zip(rows, found):
        assert row.ids == (None if t is None else made.encode(t, add_special_tokens=False).ids)


def test_special_tokens_as_plain_text(spark, trained):
    df = spark.createDataFrame([("a<|user|>",)], "text string")
    plain = encode.encode_documents(df, "text", trained, specials=False).first().tokens
    marked = encode.encode_documents(df, "text", trained).first().tokens
    assert len(marked) == 2 * 4 and len(plain) > len(marked)


def test_chunks_are_encoded_on_their_own(spark, trained):
    texts = ["the theme of the thesis " * 9, "é" * 30, "short"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = encode.encode_documents(df, "text", trained, boundaries=False, chunk_chars=7)
    pieces = spark.createDataFrame(
        [(i, k, t[k : k + 7]) for i, t in enumerate(texts) for k in range(0, len(t), 7)],
        "i int, k int, text string",
    )
    one = encode.encode_documents(pieces, "text", trained, boundaries=False).orderBy("i", "k").collect()
    for i, row in enumerate(out.collect()):
        assert bytes(row.tokens) == b"".join(bytes(r.tokens) for r in one if r.i == i)


def test_round_trip(spark, corpus, trained):
    docs, _ = corpus
    encoded = encode.encode_documents(docs, "text", trained, boundaries=False)
    checked = encode.roundtrip(encoded, "text", "tokens", trained)
    assert checked.filter("not roundtrip_ok or unknown_tokens > 0").count() == 0
    encode.require_roundtrip(checked)
    broken = encode.roundtrip(encoded.withColumn("tokens", F.lit(b"\x07\x00")), "text", "tokens", trained)
    with pytest.raises(RuntimeError):
        encode.require_roundtrip(broken)


def test_model_survives_its_table(spark, trained):
    back = BpeModel.from_frame(trained.merges_frame(spark))
    assert back.merges == trained.merges and back.sha256() == trained.sha256()
    assert trained.vocab_frame(spark).count() == 500


def test_min_frequency_and_size_limits(spark):
    assert bpe.train_bpe(counts_frame(spark, {"ab": 1, "cd": 1}), 300).merges == []
    for size in (10, 70_000):
        with pytest.raises(ValueError):
            bpe.train_bpe(counts_frame(spark, {"ab": 1}), size)


def test_train_tokenizer_plan(spark, corpus, tmp_path):
    docs, _ = corpus
    trained = tokenizer.train_tokenizer(docs, "source", "doc_id", "text", 300, 60)
    assert trained.model.vocab_size() == 300
    assert trained.probes.count() == len(tokenizer.PROBES)
    assert trained.probes.filter("unknown_tokens > 0").count() == 0
    used = trained.metadata.first()
    assert (used.training_documents, used.input_shards, used.vocab_size) == (60, 20, 300)
    path = str(tmp_path / "tokenizer")
    tokenizer.store_tokenizer(trained, path)
    assert tokenizer.load_tokenizer(spark, path).merges == trained.model.merges
    spark.createDataFrame([("x",)], "tokenizer_sha256 string").write.mode("overwrite").parquet(
        path + "/metadata"
    )
    with pytest.raises(ValueError, match="do not match"):
        tokenizer.load_tokenizer(spark, path)


def test_no_usable_text(spark):
    df = spark.createDataFrame([("s", 0, "short")], "s string, r long, t string")
    with pytest.raises(RuntimeError, match="sample is empty"):
        tokenizer.train_tokenizer(df, "s", "r", "t", 300, 60)


def test_compare_tokenizers_plan(spark, corpus, trained):
    docs, _ = corpus
    sample = docs.withColumn("domain", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    report, compared = evaluation.compare_tokenizers(
        sample, "doc_id", "domain", "text", BpeModel(), trained
    )
    rows = {(r.tokenizer, r.domain): r for r in report.collect()}
    assert len(rows) == 4 and all(r.roundtrip_failures == 0 for r in rows.values())
    for r in compared.collect():
        a, b = rows["a", r.domain], rows["b", r.domain]
        assert r.b_wins + r.ties == a.documents and r.a_wins == 0
        assert r.token_reduction_percent == pytest.approx((a.tokens - b.tokens) * 100 / a.tokens)
        assert a.tokens == a.utf8_bytes and b.observed_ids <= 500


def test_counts_of_packed_tokens(spark):
    df = spark.createDataFrame([(b"\x00\x00\x01\x00",), (b"",)], "p binary")
    assert [r.n for r in df.select(token_count(F.col("p")).alias("n")).collect()] == [2, 0]


def test_prefix_queries_train_the_prefix_alone(spark, tmp_path, monkeypatch):
    from textloom.registry import queries

    rnd = random.Random(4)
    rows = [(i, " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sizes, train = [], queries.bpe.train_bpe
    monkeypatch.setattr(queries.bpe, "train_bpe", lambda counts, size: sizes.append(size) or train(counts, size))
    small = [tuple(r) for r in queries.QUERIES["bpe_prefix"](spark, str(tmp_path)).orderBy("rank").collect()]
    assert sizes == [queries.PREFIX] and len(small) == 64
    # Where the full vocabulary is stored, its first merges are the same.
    full = queries._model(spark, str(tmp_path))
    assert [(i, *m) for i, m in enumerate(full.prefix(queries.PREFIX).merges)] == small
    assert [tuple(r) for r in queries.QUERIES["bpe_prefix"](spark, str(tmp_path)).orderBy("rank").collect()] == small
    assert sizes == [queries.PREFIX, queries.VOCABULARY]


def test_words_are_merged_together_as_one_by_one():
    rng = random.Random(3)
    merges, ranks = [], {}
    for rank in range(40):
        left, right = rng.randrange(6 + rank // 2), rng.randrange(6 + rank // 2)
        merges.append((left, right, 6 + rank, 1))
        ranks.setdefault((left, right), (rank, 6 + rank))
    words = [[rng.randrange(3) for _ in range(rng.choice([0, 1, 2, 7, 40]))] for _ in range(200)]
    ends = np.r_[0, np.cumsum([len(w) for w in words])]
    ids, at = bpe.MergeTable(merges).merged(np.array(sum(words, []), dtype=np.uint16), ends)
    assert [ids[lo:hi].tolist() for lo, hi in zip(at, at[1:])] == [bpe.merge_ids(w, ranks) for w in words]


def test_new_words_are_merged_once_a_batch(spark, trained, monkeypatch):
    calls = []
    merged = bpe.MergeTable.merged
    monkeypatch.setattr(bpe.MergeTable, "merged", lambda *a: calls.append(len(a[2]) - 1) or merged(*a))
    pieces = pa.array([["river", " stone", "river"], None, [], ["<|user|>", " stone", "é"]])
    got = encode._piece_encoder(trained, True).func(pieces).to_pylist()
    assert calls == [4]
    assert got[1] is None and got[2] == b"" and got[3][:2] == (5).to_bytes(2, "little")


def test_word_counts_move_once_a_batch(spark):
    docs = spark.createDataFrame([("a b a",), (None,), ("",), ("b a",)] * 500, "text string").coalesce(1)
    counts = bpe.pretoken_counts(docs, "text")
    assert {r.word: r.n for r in counts.collect()} == {"a": 500, " b": 500, " a": 1000, "b": 500}
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()


def test_round_trip_decodes_once(spark, corpus, trained):
    encoded = encode.encode_documents(corpus[0], "text", trained, boundaries=False)
    checked = encode.roundtrip(encoded, "text", "tokens", trained, "decoded")
    plan = checked.select("decoded", "roundtrip_ok")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"(?<!\.)\bdecode\(", plan)) == 1
    assert checked.filter("NOT roundtrip_ok OR decoded IS NULL").count() == 0


def test_dictionary_joins_words_of_bundles(spark, trained, monkeypatch):
    rows = [(i, "a stone in the river " * 50) for i in range(20)] + [(20, None), (21, ""), (None, "x y")]
    rows += [(22, "one two"), (22, "one 2 three")]
    asked = []
    inner = encode.word_dictionary
    monkeypatch.setattr(encode, "word_dictionary", lambda w, *a: asked.append(w.count()) or inner(w, *a))
    monkeypatch.setattr(encode, "BUNDLE_CHARS", 5_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in encode.encode_by_dictionary(docs, ["doc_id"], "text", trained).collect()}
    want = {r.doc_id: r.tokens for r in encode.encode_documents(docs, "text", trained).collect()}
    assert asked[0] <= 5 * 7 + 8  # of about 5,000 words
    assert len(got) == 24 and got[20] is None and len(got[21]) == 4
    assert {k: v for k, v in got.items() if k != 22} == {k: v for k, v in want.items() if k != 22}
    bare = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    bare = encode.encode_by_dictionary(bare, ["doc_id"], "text", trained, boundaries=False)
    assert {r.doc_id: r.tokens for r in bare.collect()} == {1: b"", 2: None}
    # Repeated keys come once, as before: words by position, then by ids.
    ids = {w: encode._piece_encoder(trained, True).func(pa.array([[w]]))[0].as_py() for w in ("one", " two", " 2", " three")}
    parts = [*[ids["one"]] * 2, *sorted([ids[" two"], ids[" 2"]]), ids[" three"]]
    assert got[22][2:-2] == b"".join(parts)
