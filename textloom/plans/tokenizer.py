"""Training a tokenizer from a corpus sample, and checking it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import cap_chars, has_min_chars
from textloom.functions.tokens import token_count
from textloom.functions.vocabulary import BpeModel
from textloom.operators.bpe import pretoken_counts, train_bpe
from textloom.operators.encode import encode_documents, require_roundtrip, roundtrip
from textloom.operators.sampling import per_shard_quota
from textloom.session import materialize

# Texts a new tokenizer must reproduce: Latin letters, program code, two other scripts, an emoji, and
# accents in decomposed form.
PROBES = (
    "Seven wet otters, 41 pebbles & one jetty: who counts?",
    "for key, row in table.items():\n\ttotal += row[key] ** 2",
    "நதியில் மீன்கள் நீந்துகின்றன",
    "春天的河水很凉。",
    "caf\u0065\u0301 \U0001f9ed nai\u0308ve",
)


@dataclass
class TrainedTokenizer:
    """A model, its probe report, and one row about its training."""

    model: BpeModel
    probes: DataFrame
    metadata: DataFrame


def train_tokenizer(
    docs: DataFrame,
    shard: str,
    row: str,
    text: str,
    vocab_size: int = 32_768,
    max_documents: int | None = None,
    max_chars: int | None = None,
    seed: int = 42,
    min_frequency: int = 2,
) -> TrainedTokenizer:
    """Count words once, learn merges, and check the probes.

    All usable documents are read whole, unless ``max_documents`` asks for a sample of as many (the
    same quota from every shard) or ``max_chars`` for their beginnings.
    """
    spark = docs.sparkSession
    if max_documents is None:
        sample = docs.filter(has_min_chars(text))
    else:
        sample = per_shard_quota(docs, shard, row, text, max_documents, seed)
    whole = F.col(text) if max_chars is None else cap_chars(text, max_chars)
    sample = sample.select(shard, whole.alias(text))
    if max_documents is not None:
        sample = materialize(sample, "sample")
    used = sample.agg(
        F.count("*").alias("documents"), F.count_distinct(shard).alias("shards")
    ).first()
    if not used.documents:
        raise RuntimeError("the sample is empty: no document is long enough")
    counts = materialize(pretoken_counts(sample, text), "counts")
    model = train_bpe(counts, vocab_size, min_frequency)
    probes = probe_report(spark, model)
    require_roundtrip(probes)
    metadata = spark.createDataFrame(
        [(model.sha256(), model.vocab_size(), used.documents, used.shards, seed)],
        "tokenizer_sha256 string, vocab_size int, training_documents long, input_shards long, seed int",
    )
    return TrainedTokenizer(model, probes.drop("roundtrip_ok"), metadata)


def store_tokenizer(trained: TrainedTokenizer, path: str) -> None:
    """Merges, vocabulary, probes and metadata as four small tables; the metadata come last."""
    spark = trained.metadata.sparkSession
    tables = {
        "merges": trained.model.merges_frame(spark),
        "vocab": trained.model.vocab_frame(spark),
        "probes": trained.probes,
        "metadata": trained.metadata,
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def stored_or_trained(spark: SparkSession, path: str, train: Callable[[], BpeModel]) -> BpeModel:
    """The model below ``path``; where there is none, it is trained, checked by its probes and stored."""
    try:
        return load_tokenizer(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    model = train()
    probes = probe_report(spark, model)
    require_roundtrip(probes)
    metadata = spark.createDataFrame(
        [(model.sha256(), model.vocab_size())], "tokenizer_sha256 string, vocab_size int"
    )
    store_tokenizer(TrainedTokenizer(model, probes.drop("roundtrip_ok"), metadata), path)
    return model


def load_tokenizer(spark: SparkSession, path: str) -> BpeModel:
    """The stored model; raises when it is not the one that was stored."""
    expected = spark.read.parquet(f"{path}/metadata").first().tokenizer_sha256
    model = BpeModel.from_frame(spark.read.parquet(f"{path}/merges"))
    if model.sha256() != expected:
        raise ValueError("stored merges do not match the recorded digest")
    return model


def probe_report(spark: SparkSession, model: BpeModel) -> DataFrame:
    """Tokens and unknown tokens of the fixed probes."""
    probes = spark.createDataFrame([(p,) for p in PROBES], "probe string")
    encoded = encode_documents(probes, "probe", model, boundaries=False)
    return roundtrip(encoded, "probe", "tokens", model).select(
        "probe", token_count(F.col("tokens")).alias("n_tokens"), "unknown_tokens", "roundtrip_ok"
    )
