"""Batches to Python stay small, whatever the session's default."""

import pytest

from textloom import session
from textloom.functions.vocabulary import BpeModel
from textloom.llm import op7_jaccard_join
from textloom.operators import encode


@pytest.fixture
def key(spark):
    before = spark.conf.get(session.BATCH_KEY)
    yield session.BATCH_KEY
    spark.conf.set(session.BATCH_KEY, before)


@pytest.mark.parametrize("given", ["64m", "67108864b", "2097153"])
def test_batches_are_made_small(spark, key, given):
    spark.conf.set(key, given)
    session.small_batches(spark)
    assert spark.conf.get(key) == f"{session.BATCH_BYTES}b"


def test_a_lower_setting_stays(spark, key):
    spark.conf.set(key, "64k")
    session.small_batches(spark)
    assert spark.conf.get(key) == "64k"


def test_jaccard_join_sets_it(spark, key):
    spark.conf.set(key, "64m")
    op7_jaccard_join.near_duplicates(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    assert spark.conf.get(key) == f"{session.BATCH_BYTES}b"


def test_encoding_sets_it(spark, key):
    spark.conf.set(key, "64m")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    encode.encode_documents(docs, "text", BpeModel())
    assert spark.conf.get(key) == f"{session.BATCH_BYTES}b"
