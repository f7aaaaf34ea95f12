"""Paired evaluation of two tokenizers on held-out documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.tokens import token_count
from textloom.functions.vocabulary import BpeModel
from textloom.operators.encode import encode_words, roundtrip, words_of
from textloom.operators.report import (
    compared_counts,
    domain_summary,
    fertility_percentiles,
    vocab_coverage,
)
from textloom.operators.sampling import (
    require_full_quotas,
    tail_sample,
    tail_shortages,
)
from textloom.session import materialize, small_batches


def measured_pair(
    sample: DataFrame, key: str, domain: str, text: str, a: BpeModel, b: BpeModel
) -> DataFrame:
    """The sample encoded with both models and checked, written once; every statistic reads this table.

    Both encoders take the words of a text from the same Arrow batch, so a text is split into words and
    sent to Python once.
    """
    small_batches(sample.sparkSession)
    rows = sample.select(key, domain, text, F.length(text).cast("bigint").alias("chars"))
    rows = rows.withColumn("_words", words_of(F.col(text)))
    tokens = {f"{side}_tokens": encode_words("_words", model) for side, model in (("a", a), ("b", b))}
    checked = rows.withColumns(tokens).drop("_words")
    for side, model in (("a", a), ("b", b)):
        checked = roundtrip(checked, text, f"{side}_tokens", model).withColumnsRenamed(
            {"unknown_tokens": f"{side}_unknown", "roundtrip_ok": f"{side}_ok"}
        )
        checked = checked.withColumn(f"{side}_n", token_count(F.col(f"{side}_tokens")))
    return materialize(checked, "measured")


def side_of(pair: DataFrame, side: str) -> DataFrame:
    """One model's columns of :func:`measured_pair`, under the names that reports use."""
    names = {"tokens": "tokens", "unknown": "unknown_tokens", "ok": "roundtrip_ok", "n": "n_tokens"}
    other = [f"{'b' if side == 'a' else 'a'}_{n}" for n in names]
    return pair.drop(*other).withColumnsRenamed({f"{side}_{n}": to for n, to in names.items()})


def tokenizer_report(rows: DataFrame, domain: str, text: str, model: BpeModel) -> DataFrame:
    """Sizes, ratios, percentiles and vocabulary coverage per domain."""
    n, chars = F.col("n_tokens"), F.col("chars")
    summary = domain_summary(
        rows, domain, text, n, F.col("unknown_tokens"), (~F.col("roundtrip_ok")).cast("int")
    )
    # One row per domain on every side.
    return summary.join(fertility_percentiles(rows, domain, n, chars), domain).join(
        vocab_coverage(rows, domain, "tokens", model.vocab_size()), domain
    )


def compare_tokenizers(
    sample: DataFrame, key: str, domain: str, text: str, a: BpeModel, b: BpeModel
) -> tuple[DataFrame, DataFrame]:
    """Both reports (column ``tokenizer``) and the paired comparison per domain."""
    pair = measured_pair(sample, key, domain, text, a, b)
    report = (
        tokenizer_report(side_of(pair, "a"), domain, text, a)
        .withColumn("tokenizer", F.lit("a"))
        .unionByName(
            tokenizer_report(side_of(pair, "b"), domain, text, b).withColumn("tokenizer", F.lit("b"))
        )
    )
    return report, compared_counts(pair, domain, "a_n", "b_n")


def heldout_comparison(
    docs: DataFrame,
    shard: str,
    row: str,
    text: str,
    source: str,
    a: BpeModel,
    b: BpeModel,
    samples_per_domain: int = 50_000,
    tail_start: int = 90_000,
    max_chars: int = 16_384,
    seed: int = 120,
    domains: dict[str, tuple[str, ...]] | None = None,
    fraction: float = 0.001,
    method: str = "blake2b",
) -> tuple[DataFrame, DataFrame]:
    """Draw the held-out sample, insist on full quotas, and compare both tokenizers on it."""
    sample = materialize(
        tail_sample(
            docs, shard, row, text, source, samples_per_domain, tail_start, seed, max_chars,
            fraction=fraction, method=method, domains=domains,
        ).withColumn("key", F.concat_ws(":", shard, F.col(row).cast("string"))),
        "heldout",
    )
    require_full_quotas(tail_shortages(sample, docs, shard, samples_per_domain, domains))
    return compare_tokenizers(sample, "key", "domain", text, a, b)
