from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import messages, quality

SCHEMA = f"i int, m {messages.MESSAGES_TYPE}"


def frame(spark, conversations):
    return spark.createDataFrame(list(enumerate(conversations)), SCHEMA)


def values(df, expr):
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


U, A, S = ("user", "q"), ("assistant", "a"), ("system", "s")


def test_valid_messages(spark):
    cases = [
        ([U, A], True),
        ([S, U, A], True),
        ([U, U, A], True),
        ([A, A], True),
        ([A], False),
        ([], False),
        (None, False),
        ([U, A, U], False),
        ([("tool", "x"), A], False),
        ([(None, "x"), A], False),
        ([("user", None), A], False),
        ([("user", " 　"), A], False),
    ]
    df = frame(spark, [c for c, _ in cases])
    assert values(df, messages.valid_messages(F.col("m"))) == [v for _, v in cases]


def test_chat_render(spark):
    df = frame(spark, [[S, U, A], []])
    expected = (
        "<|beginoftext|><|system|>\ns<|endoftext|>\n<|user|>\nq<|endoftext|>\n"
        "<|assistant|>\na<|endoftext|>\n"
    )
    assert values(df, messages.chat_render(F.col("m"))) == [expected, ""]
    prompted = values(df, messages.chat_render(F.col("m"), generation_prompt=True))
    assert prompted == [expected + "<|assistant|>\n", "<|assistant|>\n"]


def test_unknown_role_raises(spark):
    with pytest.raises(Exception, match="messages of role tool"):
        values(frame(spark, [[("tool", "x")]]), messages.chat_render(F.col("m")))


def test_assistant_spans_cut_out_content_and_end(spark):
    conversation = [S, U, ("assistant", "première"), U, ("assistant", "second")]
    df = frame(spark, [conversation, [U], []])
    spans = values(df, messages.assistant_spans(F.col("m")))
    text = values(df, messages.chat_render(F.col("m")))[0]
    assert [text[s.start : s.end] for s in spans[0]] == [
        "première<|endoftext|>",
        "second<|endoftext|>",
    ]
    assert spans[1:] == [[], []]


def health(text):
    w = text.lower().split()
    seen = Counter(zip(w, w[1:], w[2:]))
    extra = sum(n - 1 for n in seen.values())
    penalty = min(1.0, 5.0 * extra / sum(seen.values())) if seen else 0.0
    return 0.0 - penalty - (len(w) < 2)


def test_completion_health(spark):
    texts = [
        "Forty metres at the northern end.",
        "no no no no no no no no",
        "",
        "one",
        "two words",
        "a b c a b c d e f g h i j k l m n o p q r s t u v w x y z",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    scores = values(df, quality.completion_health(F.col("t")))
    assert scores == pytest.approx([health(t) for t in texts])
    assert scores[0] == 0.0 and scores[1] == -1.0


def test_completion_given_as_messages(spark):
    df = frame(spark, [[A, ("assistant", "b")]])
    assert values(df, quality.completion_text(F.col("m"))) == ["a b"]
