"""Stages of the corpus pipeline: each applies one operator's decision to the documents it gets."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import op2_mix_sources, op4_secret_scan, op5_toxicity, op7_jaccard_join, op9_bpe
from textloom.llm.common import table
from textloom.session import materialize


def vocabulary_path() -> str:
    """The public byte-level vocabulary; TEXTLOOM_TOKENIZERS names another folder."""
    folder = os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, "byte_bpe_50k.json")


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def apart(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` while its further columns have names that no operator uses."""
    names = [c if c in COLUMNS else f"column {i}" for i, c in enumerate(docs.columns)]
    back = dict(zip(names, docs.columns))
    done = work(docs.toDF(*names))
    return done.toDF(*[back.get(c, c) for c in done.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the network learns from the labels of these documents.

    Null and empty texts are scored as texts without words; without any label nothing is rejected; an
    empty table stays empty; repeated rows have one fate.
    """

    def work(rows: DataFrame) -> DataFrame:
        model = op5_toxicity.fit(rows, table(spark, sf_dir, "labels"))
        return op5_toxicity.scored(rows, model).filter("_score < 0.5").select(*rows.columns)

    return apart(docs, work)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, repeated rows once.

    Documents without an id cannot be told apart by one, and stay, and so do those without words.
    """

    def work(rows: DataFrame) -> DataFrame:
        classes = op7_jaccard_join.near_duplicates(rows)
        firsts = classes.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
        kept = rows.join(materialize(firsts, "kept"), "doc_id", "left_semi")
        kept = kept.dropDuplicates(["doc_id", "text"]).select(*rows.columns)
        return kept.union(rows.filter(F.col("doc_id").isNull()))

    return apart(docs, work)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets overwritten; lengths stay, null texts stay null."""
    return apart(docs, op4_secret_scan.masked)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words are never taken more than
    their source's rate says, and the null source is a source."""
    return apart(docs, op2_mix_sources.mix)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests in place of the text, which a null text has as an empty one; columns
    of the names ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` are replaced."""
    return op9_bpe.bpe_digests(docs, vocabulary_path())
