"""Token statistics per domain and paired comparison of tokenizers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import text_stats
from textloom.functions.tokens import distinct_ids
from textloom.operators.ranking import bucket_bases
from textloom.session import materialize

CONTEXT_TOKENS = 2048
# Steps per unit of the value axis; buckets of the exact percentile.
PERCENTILE_STEPS = 1000


def exact_percentiles(
    df: DataFrame, group: str, value: Column, fractions: dict[str, float], steps: int = PERCENTILE_STEPS
) -> DataFrame:
    """Percentiles with linear interpolation between the two nearest ranks, per group.

    Equal values are counted first (map-side). Buckets of the value axis then locate the ranks
    that are needed, and only the distinct values of the buckets that hold one are sorted. No group
    is ever sorted as a whole, unlike the built-in ``percentile``; ``steps`` sets how fine the
    buckets are.
    """
    counted = (
        df.select(group, value.cast("double").alias("_x"))
        .filter(F.col("_x").isNotNull())
        .groupBy(group, "_x")
        .agg(F.count("*").alias("_n"))
        .withColumn("_b", F.floor(F.col("_x") * steps).cast("bigint"))
    )
    # Read several times below; the source is scanned once.
    counted = materialize(counted, "values")
    bases = bucket_bases(counted, [group], "_b", F.col("_n"))
    sizes = bases.groupBy(group).agg(F.sum("bucket_total").alias("_size"))
    wanted = sizes.select(
        group,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("name"),
                        ((F.col("_size") - 1) * F.lit(p)).alias("position"),
                    )
                    for name, p in fractions.items()
                ]
            )
        ).alias("w"),
    ).select(
        group,
        F.col("w.name").alias("name"),
        F.col("w.position").alias("position"),
        F.explode(F.array(F.floor("w.position"), F.ceil("w.position"))).alias("rank"),
    )
    # A handful of ranks per group, against the bucket table.
    targets = wanted.join(bases, group).filter(
        (F.col("rank") >= F.col("bucket_base"))
        & (F.col("rank") < F.col("bucket_base") + F.col("bucket_total"))
    )
    hit = targets.select(group, "_b").distinct()
    before = Window.partitionBy(group, "_b").orderBy("_x").rowsBetween(
        Window.unboundedPreceding, -1
    )
    inside = counted.join(hit, [group, "_b"], "left_semi").withColumn(
        "_at", F.coalesce(F.sum("_n").over(before), F.lit(0))
    )
    found = targets.join(inside, [group, "_b"]).filter(
        (F.col("rank") - F.col("bucket_base") >= F.col("_at"))
        & (F.col("rank") - F.col("bucket_base") < F.col("_at") + F.col("_n"))
    )
    ends = found.groupBy(group, "name", "position").agg(
        F.min_by("_x", "rank").alias("lo"), F.max_by("_x", "rank").alias("hi")
    )
    part = F.col("position") - F.floor("position")
    ends = ends.withColumn("x", F.col("lo") * (1 - part) + F.col("hi") * part)
    return ends.groupBy(group).agg(
        *[F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in fractions]
    )


FERTILITY = {"fertility_p50": 0.50, "fertility_p90": 0.90, "fertility_p99": 0.99}


def fertility(tokens: Column, chars: Column) -> Column:
    """Tokens per 100 characters of one document."""
    return tokens * F.lit(100.0) / F.greatest(chars, F.lit(1))


def fertility_percentiles(df: DataFrame, group: str, tokens: Column, chars: Column) -> DataFrame:
    return exact_percentiles(df, group, fertility(tokens, chars), FERTILITY)


def approximate_fertility(df: DataFrame, group: str, tokens: Column, chars: Column) -> DataFrame:
    """One pass with a sketch; for a first look at very large samples."""
    sketch = F.percentile_approx(
        fertility(tokens, chars), list(FERTILITY.values()), 10_000
    )
    sketched = df.groupBy(group).agg(sketch.alias("_q"))
    return sketched.select(group, *[F.col("_q")[i].alias(n) for i, n in enumerate(FERTILITY)])


def domain_summary(
    df: DataFrame, domain: str, text: str, tokens: Column, unknown: Column, failed: Column
) -> DataFrame:
    """Sizes and token ratios per domain, one aggregation; percentiles come from
    :func:`fertility_percentiles`."""
    rows = df.select(
        domain,
        *text_stats(text),
        tokens.cast("bigint").alias("_t"),
        unknown.cast("bigint").alias("_unk"),
        failed.cast("bigint").alias("_bad"),
    )
    sums = rows.groupBy(domain).agg(
        F.count("*").alias("documents"),
        F.sum("chars").alias("characters"),
        F.sum("utf8_bytes").alias("utf8_bytes"),
        F.sum("words").alias("words"),
        F.sum("_t").alias("tokens"),
        F.count_if(F.col("_t") > CONTEXT_TOKENS).alias("_over"),
        F.sum("_unk").alias("unknown_tokens"),
        F.sum("_bad").alias("roundtrip_failures"),
    )
    c, t = F.col("characters"), F.col("tokens")
    return sums.select(
        domain,
        "documents",
        "characters",
        "utf8_bytes",
        "words",
        "tokens",
        (t * 100 / c).alias("tokens_per_100_characters"),
        (c / t).alias("characters_per_token"),
        (F.col("utf8_bytes") / t).alias("bytes_per_token"),
        (t / F.col("words")).alias("tokens_per_word"),
        (c / t * CONTEXT_TOKENS).alias("characters_per_context"),
        (F.col("_over") * 100 / F.col("documents")).alias("documents_over_context_percent"),
        "unknown_tokens",
        "roundtrip_failures",
    )


def vocab_coverage(df: DataFrame, domain: str, packed: str, vocab_size: int) -> DataFrame:
    """Distinct token ids seen per domain, and their share of the vocabulary.

    Each document gives its distinct ids once, and the map-side aggregation leaves at most
    ``vocab_size`` rows per domain and task.
    """
    seen = df.select(domain, F.explode(distinct_ids(F.col(packed))).alias("id"))
    distinct = seen.groupBy(domain, "id").agg(F.lit(1).alias("one"))
    return distinct.groupBy(domain).agg(F.count("*").alias("observed_ids")).withColumn(
        "observed_percent", F.col("observed_ids") * 100 / vocab_size
    )


def paired_compare(
    a: DataFrame, b: DataFrame, key: str, domain: str, tokens: str = "tokens", chars: str = "chars"
) -> DataFrame:
    """Per domain: which of two tokenizers needs fewer tokens, document by document."""
    both = a.select(key, domain, chars, F.col(tokens).alias("_a")).join(
        b.select(key, F.col(tokens).alias("_b")), key
    )
    return compared_counts(both, domain, "_a", "_b", chars)


def compared_counts(both: DataFrame, domain: str, a: str, b: str, chars: str = "chars") -> DataFrame:
    """:func:`paired_compare` of documents that have both token counts in one row."""
    both = both.select(domain, chars, F.col(a).alias("_a"), F.col(b).alias("_b"))
    sums = both.groupBy(domain).agg(
        F.count_if(F.col("_a") < F.col("_b")).alias("a_wins"),
        F.count_if(F.col("_b") < F.col("_a")).alias("b_wins"),
        F.count_if(F.col("_a") == F.col("_b")).alias("ties"),
        F.sum("_a").alias("_ta"),
        F.sum("_b").alias("_tb"),
        F.sum(chars).alias("_c"),
    )
    gain = (F.col("_c") / F.col("_tb")) / (F.col("_c") / F.col("_ta")) - 1
    return sums.select(
        domain,
        "a_wins",
        "b_wins",
        "ties",
        ((F.col("_ta") - F.col("_tb")) * 100 / F.col("_ta")).alias("token_reduction_percent"),
        (gain * 100).alias("context_gain_percent"),
    )


def eval_perplexity(df: DataFrame, loss: Column, group: str | None = None) -> DataFrame:
    """Mean loss and ``exp(min(mean, 20))``."""
    grouped = df.groupBy(group) if group else df.groupBy()
    means = grouped.agg(F.avg(loss).alias("mean_loss"), F.count(loss).alias("batches"))
    return means.withColumn("perplexity", F.exp(F.least(F.col("mean_loss"), F.lit(20.0))))
