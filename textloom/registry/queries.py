"""One query per operator, each over the whole shipped tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import hashing, messages, quality, text
from textloom.functions.tokens import token_count
from textloom.functions.vocabulary import FIRST_MERGE_ID, BpeModel
from textloom.operators import (
    bpe,
    encode,
    logs,
    manifest,
    order,
    packing,
    preference,
    report,
    sampling,
    sketches,
    split,
)
from textloom.plans import evaluation, incremental, posttrain, prepare, tokenizer
from textloom.registry import frames
from textloom.registry.frames import BLOCK, DOMAINS, FRACTION, documents
from textloom.session import materialize, scratch_path, shared_dir
from textloom.sources import corpus, sinks
from textloom.sources import preference as preference_source
from textloom.streaming.prepare import prepare_available, prepared_stream, stream_counts
from textloom.streaming.rollup import rolled_windows, rollup_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VOCABULARY = 32_768
# A small vocabulary, whose merges SQL can follow one by one.
PREFIX = FIRST_MERGE_ID + 64
SEED = 42
ORDER_SEED = 7


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---- scans, sources, sinks -------------------------------------------------------------------


@query
def corpus_scan(spark, sf):
    # The table is a file or a folder of files; a file is named by its path from the table on.
    rows = corpus.corpus_scan(spark, os.path.join(sf, "documents.parquet"), {"text": "string"})
    return rows.select(
        F.regexp_extract("shard", r"(?:^|/)(documents\.parquet(?:/.*)?)$", 1).alias("file"),
        F.col("row_index").cast("bigint").alias("row_index"),
        F.length("text").cast("bigint").alias("chars"),
        F.md5("text").alias("digest"),
    )


@query
def missing_text_policy(spark, sf):
    rows = corpus.corpus_scan(spark, sf, on_missing="skip")
    return rows.groupBy(corpus.file_name(F.col("shard")).alias("file")).agg(
        F.count("*").alias("rows"), F.sum(F.length("text")).cast("bigint").alias("chars")
    )


@query
def shard_sample(spark, sf):
    listing = documents(spark, sf).groupBy("source").agg(F.count("*").alias("rows"))
    return sampling.evenly_spaced(listing, "source", 7).select("source", "position", "rows")


@query
def shard_budget(spark, sf):
    docs = documents(spark, sf)
    listing = docs.groupBy("source").agg(F.count("*").alias("rows"))
    budget = docs.agg((F.sum(F.length("text")) * 400).alias("b")).scalar()
    return sampling.evenly_spaced(listing, "source", sampling.shard_budget(budget)).select(
        "source", "position", "rows"
    )


@query
def shard_listing(spark, sf):
    listing = corpus.file_listing(spark, sf)
    rows = corpus.read_files(spark, [sf]).groupBy("shard").agg(F.count("*").alias("rows"))
    return listing.filter("bytes > 0").join(rows, "shard", "left").select(
        corpus.file_name(F.col("path")).alias("file"),
        F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
    )


@query
def split_by_filename(spark, sf):
    n = frames.source_number()
    prefix = (
        F.when(n % 5 == 0, "Test")
        .when(n % 5 == 1, "eval")
        .when(n % 5 == 2, "train-Validation")
        .when(n % 5 == 3, "other")
        .otherwise("TRAIN")
    )
    listing = (
        documents(spark, sf)
        .groupBy(F.concat(F.lit("test/"), prefix, F.lit("-"), F.col("source")).alias("path"))
        .agg(F.count("*").alias("rows"))
    )
    return corpus.split_by_filename(listing).select("path", "split", "rows")


@query
def preference_jsonl_scan(spark, sf):
    root = scratch_path(spark, "preference-input")
    frames.scored_pairs(frames.conversations(spark, sf)).write.json(os.path.join(root, "data", "preference.jsonl"))
    found = preference_source.preference_file(spark, root)
    schema = preference_source.PREFERENCE_SCHEMA + ", conv_id long"
    rows = preference_source.preference_scan(spark, found, schema=schema)
    return rows.select(
        "conv_id",
        "preference_strength",
        "split",
        F.md5("prompt").alias("prompt_md5"),
        F.md5("response_1").alias("response_1_md5"),
        F.md5("response_2").alias("response_2_md5"),
    )


@query
def token_sink(spark, sf):
    path = scratch_path(spark, "tokens")
    prepared = prepare.prepare_corpus(
        frames.spread_documents(spark, sf), "source", "doc_id", "text", BpeModel(), path, FRACTION, method="md5"
    )
    return prepared.tokens.groupBy("split", "source").agg(
        F.count("*").alias("documents"),
        F.sum("n_tokens").cast("bigint").alias("tokens"),
        F.sum(F.octet_length("tokens")).cast("bigint").alias("bytes"),
    )


def _collections(spark, sf):
    talks = materialize(frames.conversations(spark, sf), "conversations")
    return posttrain.collections(
        talks,
        frames.explicit_pairs(talks),
        frames.scored_pairs(talks),
        "conv_id",
        SEED,
        on_no_prompt="drop",
    )


def _published(spark, sf) -> tuple[str, str]:
    path = scratch_path(spark, "normalized")
    details = posttrain.published_details(SEED, 2_000, "drop")
    return path, sinks.publish_collections(_collections(spark, sf), path, details)


@query
def normalized_sink(spark, sf):
    path, _ = _published(spark, sf)
    return sinks.published(spark, path).groupBy("collection", "split").agg(
        F.count("*").alias("rows"),
        F.min("conv_id").alias("first_id"),
        F.sum("conv_id").cast("bigint").alias("id_sum"),
    )


@query
def normalized_manifest(spark, sf):
    path, version = _published(spark, sf)
    entry = sinks.manifest_rows(spark, path).filter(F.col("version") == version)
    said = F.from_json("details", "seed int, validation_rows int, on_no_prompt string, system_prompt string")
    return entry.select(said.alias("d"), F.inline("counts")).select("collection", "split", "rows", "d.*")


# ---- projections and filters -----------------------------------------------------------------


@query
def min_chars_filter(spark, sf):
    return frames.usable_documents(spark, sf).select("doc_id", "source")


@query
def char_cap(spark, sf):
    capped = text.cap_chars("text", 16_384)
    return documents(spark, sf).select(
        "doc_id", F.length(capped).cast("bigint").alias("chars"), F.md5(capped).alias("digest")
    )


@query
def hash_split(spark, sf):
    return split.hash_split(documents(spark, sf), "text", FRACTION).select("doc_id", "split")


@query
def hash_split_blake2b(spark, sf):
    return split.hash_split(documents(spark, sf), "text", FRACTION, "blake2b").select(
        "doc_id", "split"
    )


@query
def chunk_documents(spark, sf):
    rows = documents(spark, sf).select(
        "doc_id", F.posexplode(text.chunks("text", 1000)).alias("chunk", "piece")
    )
    return rows.select(
        "doc_id",
        F.col("chunk").cast("bigint").alias("chunk"),
        F.length("piece").cast("bigint").alias("chars"),
        F.md5("piece").alias("digest"),
    )


@query
def valid_messages(spark, sf):
    rows = preference.valid_conversations(frames.conversations(spark, sf))
    return rows.select("conv_id", F.size("messages").cast("bigint").alias("turns"))


def _pair_columns():
    return [
        "conv_id",
        *[F.md5(frames.joined(F.col(c))).alias(c) for c in ("prompt", "chosen", "rejected")],
    ]


@query
def explicit_pref_filter(spark, sf):
    pairs = preference.explicit_pairs(frames.explicit_pairs(frames.conversations(spark, sf)), on_no_prompt="drop")
    return pairs.select(*_pair_columns())


@query
def scored_pref_filter(spark, sf):
    return preference.scored_filter(frames.scored_pairs(frames.conversations(spark, sf))).select(
        "conv_id", "preference_strength"
    )


@query
def require_columns(spark, sf):
    """The contract holds for every table that is asked for its key."""
    keys = {"documents": "text", "conversations": "role", "events": "value", "labels": "quality"}
    counts = None
    for name, column in keys.items():
        frame = frames.table(spark, sf, name)
        corpus.require_columns(frame, [column])
        one = frame.agg(F.count(column).alias("rows")).select(F.lit(name).alias("name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query
def domain_map(spark, sf):
    named = documents(spark, sf).withColumn("domain", sampling.domain(F.col("source"), DOMAINS))
    return named.filter("domain is not null").groupBy("domain", "source").agg(
        F.count("*").alias("documents")
    )


@query
def heldout_filter(spark, sf):
    rows = documents(spark, sf).withColumn("row_index", F.expr("doc_id div 8"))
    return split.heldout(rows, "text", "row_index", 10, FRACTION).select("doc_id")


# ---- joins -----------------------------------------------------------------------------------


@query
def explicit_preference(spark, sf):
    pairs = preference.explicit_preference(frames.explicit_pairs(frames.conversations(spark, sf)), "drop")
    sizes = [F.size(c).cast("bigint").alias(f"{c}_turns") for c in ("prompt", "chosen", "rejected")]
    return pairs.select(*_pair_columns(), *sizes)


def _build_tables(spark, sf):
    """A listing of shards, and metadata and outputs that fit some of them."""
    sizes = documents(spark, sf).groupBy("source").agg(
        F.sum(F.octet_length("text")).cast("bigint").alias("bytes"), F.count("*").alias("modified")
    )
    listing = manifest.fingerprints(
        sizes.withColumnRenamed("source", "path"), "tok", 0.001, 64, 1_000_000
    )
    meta = (
        listing.withColumn("n", F.substring("source", 4, 10).cast("int"))
        .filter(F.col("n") % 6 != 1)
        .withColumn("source_bytes", F.col("source_bytes") + (F.col("n") % 6 == 2).cast("bigint"))
        .withColumn("tokenizer_sha256", F.when(F.col("n") % 6 == 3, "old").otherwise("tok"))
        .withColumn("train_tokens", F.col("source_bytes") * 2)
        .withColumn("validation_tokens", F.col("source_mtime"))
        .withColumn("train_path", F.concat("source", F.lit(".train")))
        .withColumn("validation_path", F.concat("source", F.lit(".validation")))
    )
    outputs = meta.select(
        F.col("train_path").alias("path"),
        (F.col("train_tokens") * 2 - (F.col("n") % 6 == 4).cast("bigint")).alias("bytes"),
    ).unionByName(
        meta.filter(F.col("n") % 6 != 5).select(
            F.col("validation_path").alias("path"), (F.col("validation_tokens") * 2).alias("bytes")
        )
    )

    return listing, meta.drop("n"), outputs


@query
def incremental_skip(spark, sf):
    listing, meta, outputs = _build_tables(spark, sf)
    todo = manifest.pending_shards(listing, meta, outputs).select(
        "source", F.lit("pending").alias("state")
    )
    done = manifest.cached_shards(listing, meta, outputs).select(
        "source", F.lit("cached").alias("state")
    )
    return todo.unionByName(done)


@query
def block_locate(spark, sf):
    offsets = materialize(frames.offsets(spark, sf), "offsets")
    n = offsets.agg(F.sum("blocks").alias("n")).scalar()
    events = frames.table(spark, sf, "events")
    requests = events.select("event_id", F.pmod(F.col("event_id") * 7919, n).alias("block_index"))
    return packing.block_locate(requests, "block_index", offsets, "source").select(
        "event_id", "block_index", "source", "local_block"
    )


@query
def paired_compare(spark, sf):
    docs = frames.spread_documents(spark, sf).withColumn("domain", sampling.domain(F.col("source"), DOMAINS))
    docs = docs.filter("domain is not null").withColumn("chars", F.length("text").cast("bigint"))
    a = docs.select("doc_id", "domain", "chars", F.size(text.pretokens("text")).alias("tokens"))
    b = docs.select("doc_id", (F.octet_length("text") - F.length("text") + 
                               text.word_count("text") * 2).alias("tokens"))
    compared = report.paired_compare(a, b, "doc_id", "domain")
    return compared.select(
        "domain",
        "a_wins",
        "b_wins",
        "ties",
        F.round("token_reduction_percent", 6).alias("token_reduction_percent"),
        F.round("context_gain_percent", 6).alias("context_gain_percent"),
    )


@query
def manifest_upsert(spark, sf):
    sizes = documents(spark, sf).withColumn("bytes", F.octet_length("text"))
    columns = ["source", "documents", "bytes"]
    summary = lambda d: d.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("bytes").cast("bigint").alias("bytes")
    )
    n = frames.source_number()
    previous = summary(sizes.filter((F.col("lang") == "en") & (n % 3 != 0)))
    new = summary(sizes.filter(n % 2 == 0))
    return manifest.manifest_upsert(previous, new, "source").select(*columns)


# ---- aggregations ----------------------------------------------------------------------------


def _stats(spark, sf):
    return manifest.shard_build_stats(
        frames.spread_documents(spark, sf),
        "source",
        text.has_min_chars("text"),
        hashing.is_validation(F.col("text"), FRACTION),
        F.size(text.pretokens("text")) + 2,
    )


@query
def shard_build_stats(spark, sf):
    return _stats(spark, sf)


@query
def split_manifest(spark, sf):
    rows = manifest.split_manifest(_stats(spark, sf), "source")
    return rows.select(
        "level",
        F.coalesce("split", F.lit("-")).alias("split"),
        F.coalesce("source", F.lit("-")).alias("source"),
        "tokens",
        "shards",
    )


@query
def collection_counts(spark, sf):
    union = None
    for name, frame in _collections(spark, sf).items():
        part = frame.select(F.lit(name).alias("collection"), "split")
        union = part if union is None else union.unionByName(part)
    return manifest.collection_counts(union)


@query
def pretoken_counts(spark, sf):
    return bpe.pretoken_counts(frames.spread_documents(spark, sf), "text")


@query
def bpe_pair_counts(spark, sf):
    words = bpe.word_table(bpe.pretoken_counts(frames.spread_documents(spark, sf), "text"))
    return bpe.pair_ids(bpe.pair_counts(words))


def _train(spark, sf, size: int = VOCABULARY) -> BpeModel:
    return bpe.train_bpe(bpe.pretoken_counts(frames.spread_documents(spark, sf), "text"), size)


def _model_path(spark, sf, size: int) -> str:
    files = corpus.file_listing(spark, os.path.join(sf, "documents.parquet"))
    state = files.select(F.concat_ws(":", "path", "bytes", "modified").alias("f")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("f")), ","), 256).alias("state")
    )
    name = f"{size}-{state.first().state}"
    return os.path.join(shared_dir(spark), "textloom-models", name)


def _model(spark, sf, size: int = VOCABULARY) -> BpeModel:
    """A vocabulary of the documents, trained once for all queries that need it."""
    return tokenizer.stored_or_trained(spark, _model_path(spark, sf, size), lambda: _train(spark, sf, size))


def _small_model(spark, sf) -> BpeModel:
    """The first merges of the full vocabulary. Where that is not stored, training ends with them: it
    takes the same ones, whatever size it goes on to."""
    try:
        return tokenizer.load_tokenizer(spark, _model_path(spark, sf, VOCABULARY)).prefix(PREFIX)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return _model(spark, sf, PREFIX)


def _merges(spark, model: BpeModel) -> DataFrame:
    return model.merges_frame(spark).select("rank", "left_id", "right_id", "new_id", "pair_count")


@query
def bpe_train(spark, sf):
    return _merges(spark, _train(spark, sf))


@query
def bpe_prefix(spark, sf):
    return _merges(spark, _small_model(spark, sf))


def _domain_tokens(spark, sf):
    """Documents of the known domains with byte ids, written once."""
    docs = frames.spread_documents(spark, sf).withColumn("domain", sampling.domain(F.col("source"), DOMAINS))
    docs = docs.filter("domain is not null")
    encoded = encode.encode_documents(docs, "text", BpeModel(), boundaries=False)
    return encoded.withColumn("n_tokens", token_count(F.col("tokens")))


@query
def domain_summary(spark, sf):
    docs = frames.spread_documents(spark, sf).withColumn("domain", sampling.domain(F.col("source"), DOMAINS))
    encoded = encode.encode_documents(
        docs.filter("domain is not null"), "text", BpeModel(), boundaries=False
    )
    checked = encode.roundtrip(encoded, "text", "tokens", BpeModel())
    summary = report.domain_summary(
        checked,
        "domain",
        "text",
        token_count(F.col("tokens")),
        F.col("unknown_tokens"),
        (~F.col("roundtrip_ok")).cast("int"),
    )
    exact = [c for c, t in summary.dtypes if t != "double"]
    return summary.select(
        *[F.col(c) if c in exact else F.round(c, 6).alias(c) for c in summary.columns]
    )


@query
def fertility_percentiles(spark, sf):
    docs = frames.spread_documents(spark, sf).withColumn("domain", sampling.domain(F.col("source"), DOMAINS))
    docs = docs.filter("domain is not null").select(
        "domain", F.size(text.pretokens("text")).alias("tokens"), F.length("text").alias("chars")
    )
    found = report.fertility_percentiles(docs, "domain", F.col("tokens"), F.col("chars"))
    return found.select("domain", *[F.round(c, 6).alias(c) for c in report.FERTILITY])


@query
def sketched_report(spark, sf):
    rows = materialize(_domain_tokens(spark, sf).withColumn("chars", F.length("text")), "domain-tokens")
    n, chars = F.col("n_tokens"), F.col("chars")
    stored = materialize(sketches.shard_sketches(rows, "domain", "source", n, chars, "tokens"), "sketches")
    rolled = sketches.rolled_up(stored, "domain").withColumnRenamed("observed_ids", "estimated_ids")
    exact = report.vocab_coverage(rows, "domain", "tokens", BpeModel().vocab_size())
    # The share of documents at or below a quantile, against the share it stands for.
    value = report.fertility(n, chars)
    ranked = rows.join(rolled, "domain").groupBy("domain", "documents", "estimated_ids").agg(
        *[
            (
                (F.count_if(value <= F.col(name)) / F.count("*") >= q - sketches.KLL_RANK_ERROR)
                & (F.count_if(value < F.col(name)) / F.count("*") <= q + sketches.KLL_RANK_ERROR)
            ).alias(f"{name}_holds")
            for name, q in report.FERTILITY.items()
        ]
    )
    error = F.abs(F.col("estimated_ids") - F.col("observed_ids")) / F.col("observed_ids")
    return ranked.join(exact, "domain").select(
        "domain",
        "documents",
        "observed_ids",
        (error <= 3 * sketches.HLL_ERROR).alias("ids_hold"),
        *[f"{name}_holds" for name in report.FERTILITY],
    )


@query
def vocab_coverage(spark, sf):
    seen = report.vocab_coverage(
        _domain_tokens(spark, sf), "domain", "tokens", BpeModel().vocab_size()
    )
    return seen.select(
        "domain", "observed_ids", F.round("observed_percent", 6).alias("observed_percent")
    )


@query
def eval_perplexity(spark, sf):
    means = report.eval_perplexity(
        frames.table(spark, sf, "events"), F.col("value") / 10, "event_type"
    )
    return means.select(
        "event_type",
        "batches",
        F.round("mean_loss", 6).alias("mean_loss"),
        F.round("perplexity", 4).alias("perplexity"),
    )


@query
def manifest_audit(spark, sf):
    n = frames.source_number()
    sizes = documents(spark, sf).groupBy("source", "lang").agg(
        F.sum(F.octet_length("text") + 2).cast("bigint").alias("tokens")
    )
    shards = sizes.select(
        F.col("source").alias("manifest"),
        F.concat_ws("/", "source", "lang").alias("path"),
        "tokens",
        "lang",
        n.alias("n"),
    )
    files = shards.filter(~((F.col("n") % 7 == 3) & (F.col("lang") == "en"))).select(
        "path",
        (
            F.col("tokens") * 2 - ((F.col("n") % 7 == 4) & (F.col("lang") == "en")).cast("bigint")
        ).alias("bytes"),
    )
    manifests = sizes.groupBy("source").agg(F.sum("tokens").cast("bigint").alias("total")).select(
        F.col("source").alias("manifest"),
        F.when(n % 7 == 1, "int32").otherwise("uint16").alias("dtype"),
        F.lit("little").alias("byte_order"),
        F.when(n % 7 == 2, "old").otherwise("tok").alias("tokenizer_sha256"),
        (F.col("total") + (n % 7 == 6).cast("bigint")).alias("total_tokens"),
    )
    present = shards.filter(F.col("n") % 7 != 5).select("manifest", "path", "tokens")
    return manifest.manifest_audit(manifests, present, files, "tok")


@query
def interval_rollup(spark, sf):
    log = frames.table(spark, sf, "events").withColumn("step", F.col("event_id") + 1)
    rolled = logs.interval_rollup(log, "step", "value", "ts", 10, 65_536)
    return rolled.select(
        "step",
        "tokens",
        "steps",
        F.round("loss", 6).alias("loss"),
        F.round("elapsed_seconds", 3).alias("elapsed_seconds"),
        F.round("tokens_per_second", 3).alias("tokens_per_second"),
    )


# ---- windows, ordering, sampling -------------------------------------------------------------


@query
def per_shard_quota(spark, sf):
    # The sources take turns in the table, so this is the position inside a source.
    docs = documents(spark, sf).select(
        "source", "doc_id", "text", F.expr("doc_id div 20").alias("row_index")
    )
    sample = sampling.per_shard_quota(docs, "source", "row_index", "text", 2500, SEED)
    return sample.select("source", "doc_id", "copy")


@query
def tail_sample(spark, sf):
    docs = documents(spark, sf).select(
        F.concat(F.lit("part-"), (F.col("doc_id") % 8).cast("string")).alias("shard"),
        F.expr("doc_id div 8").alias("row_index"),
        "doc_id",
        "text",
        "source",
    )
    sample = sampling.tail_sample(
        docs, "shard", "row_index", "text", "source", 60, 10, 120, fraction=FRACTION, method="md5", domains=DOMAINS
    )
    return sample.select("shard", "domain", "doc_id", F.md5("text").alias("digest"))


@query
def heldout_comparison(spark, sf):
    docs = documents(spark, sf).select(
        F.concat(F.lit("part-"), (F.col("doc_id") % 8).cast("string")).alias("shard"),
        F.expr("doc_id div 8").alias("row_index"),
        "text",
        "source",
    )
    full = _model(spark, sf)
    reports, compared = evaluation.heldout_comparison(
        docs, "shard", "row_index", "text", "source", full, full.prefix(4_096),
        8, 5, domains=DOMAINS, fraction=FRACTION, method="md5",
    )
    sides = reports.groupBy("domain").agg(
        F.min("documents").alias("documents"),
        F.sum("roundtrip_failures").cast("bigint").alias("roundtrip_failures"),
        F.sum("unknown_tokens").cast("bigint").alias("unknown_tokens"),
        F.min(F.when(F.col("tokenizer") == "a", F.col("observed_ids"))).alias("a_ids"),
    )
    # More merges never make a text longer.
    return compared.join(sides, "domain").select(
        "domain",
        "documents",
        (F.col("a_wins") + F.col("b_wins") + F.col("ties")).alias("decided"),
        "b_wins",
        "roundtrip_failures",
        "unknown_tokens",
        (F.col("token_reduction_percent") < 0).alias("shorter"),
        (F.col("a_ids") > 256).alias("uses_merges"),
    )


@query
def pack_blocks(spark, sf):
    tokens = frames.byte_tokens(spark, sf).select(
        "source", "doc_id", "tokens", token_count(F.col("tokens")).alias("n_tokens")
    )
    packed = packing.pack_blocks(
        materialize(tokens, "encoded"), "source", "doc_id", "tokens", BLOCK, "n_tokens"
    )
    return packed.select("source", "block", F.md5(F.hex("tokens")).alias("digest"))


@query
def block_offsets(spark, sf):
    return frames.offsets(spark, sf)


@query
def unique_prompts(spark, sf):
    reward = posttrain.reward_collection(frames.scored_pairs(frames.conversations(spark, sf)), "conv_id", SEED)
    unique = preference.unique_prompts(reward, "conv_id")
    return unique.select("conv_id", "split", F.md5(frames.joined(F.col("prompt"))).alias("prompt"))


@query
def evaluation_subset(spark, sf):
    events = frames.table(spark, sf, "events")
    return split.evaluation_subset(events, "event_id", 1000).select("event_id", "event_type")


@query
def exact_split(spark, sf):
    return split.exact_split(documents(spark, sf), "doc_id", SEED, 2000).select("doc_id", "split")


@query
def source_split(spark, sf):
    rows = preference.normalize_scored(
        preference.scored_filter(frames.scored_pairs(frames.conversations(spark, sf))), ["conv_id"]
    )
    named = split.source_split(rows, "conv_id", SEED, 2000).select("conv_id", "split")
    alone = rows.filter("source_split = 'train'")
    fallback = split.source_split(alone, "conv_id", SEED, 2000).select("conv_id", "split")
    return named.withColumn("input", F.lit("both")).unionByName(
        fallback.withColumn("input", F.lit("train only"))
    )


@query
def epoch_permutation(spark, sf):
    rows = frames.blocks(spark, sf)
    n = order.count_blocks(frames.offsets(spark, sf))
    planned = order.epoch_permutation(rows, "block_index", n, ORDER_SEED, range(0, 2))
    return planned.select("epoch", "sample", "block_index")


@query
def training_plan(spark, sf):
    rows = frames.blocks(spark, sf)
    n = order.count_blocks(frames.offsets(spark, sf))
    return order.training_plan(
        rows, "block_index", n, ORDER_SEED, n * BLOCK * 6 // 5, BLOCK, 4, 2, start_step=100
    ).select("step", "round", "slot", "sample", "source", F.col("block").cast("bigint").alias("block"))


@query
def eval_plan(spark, sf):
    rows = frames.blocks(spark, sf)
    n = order.count_blocks(frames.offsets(spark, sf))
    return order.eval_plan(rows, "block_index", n, 10**9, 7).select(
        "batch", "slot", "source", F.col("block").cast("bigint").alias("block")
    )


# ---- column functions as jobs ----------------------------------------------------------------


@query
def nfc_normalize(spark, sf):
    normal = text.nfc("text")
    return documents(spark, sf).select(
        "doc_id", F.length(normal).cast("bigint").alias("chars"), F.md5(normal).alias("digest")
    )


@query
def pretokenize(spark, sf):
    rows = documents(spark, sf).select("doc_id", text.pretokens("text").alias("t"))
    return rows.select(
        "doc_id",
        F.size("t").cast("bigint").alias("pretokens"),
        F.md5(F.array_join("t", "\x01")).alias("digest"),
    )


def _encoded(tokens: DataFrame) -> DataFrame:
    return tokens.select(
        "doc_id",
        token_count(F.col("tokens")).alias("n_tokens"),
        F.md5(F.hex("tokens")).alias("digest"),
    )


@query
def bpe_encode(spark, sf):
    return _encoded(encode.encode_documents(frames.spread_documents(spark, sf), "text", _model(spark, sf)))


@query
def bpe_prefix_encode(spark, sf):
    small = _small_model(spark, sf)
    return _encoded(encode.encode_documents(frames.spread_documents(spark, sf), "text", small))


@query
def bpe_dictionary_encode(spark, sf):
    docs = frames.spread_documents(spark, sf).select("doc_id", "text")
    model = _model(spark, sf)
    tokens = encode.encode_by_dictionary(docs, ["doc_id"], "text", model, boundaries=False)
    decoded = F.decode(encode.decode_tokens(F.col("tokens"), model), "UTF-8")
    return tokens.select("doc_id", F.md5(decoded).alias("digest"), F.length(decoded).cast("bigint").alias("chars"))


@query
def bpe_roundtrip(spark, sf):
    model = _model(spark, sf)
    docs = frames.spread_documents(spark, sf)
    encoded = encode.encode_documents(docs, "text", model, boundaries=False)
    checked = encode.roundtrip(encoded, "text", "tokens", model, "decoded")
    return checked.select(
        "doc_id", F.md5("decoded").alias("digest"), "unknown_tokens", F.col("roundtrip_ok").alias("same")
    )


@query
def text_stats(spark, sf):
    return documents(spark, sf).select("doc_id", *text.text_stats("text"))


@query
def chat_render(spark, sf):
    rows = frames.conversations(spark, sf)
    shown = messages.chat_render(F.col("messages"))
    prompt = messages.chat_render(F.col("messages"), generation_prompt=True)
    return rows.select(
        "conv_id",
        F.length(shown).cast("bigint").alias("chars"),
        F.md5(shown).alias("digest"),
        F.md5(prompt).alias("prompt_digest"),
    )


@query
def assistant_spans(spark, sf):
    rows = frames.conversations(spark, sf).select(
        "conv_id", F.posexplode(messages.assistant_spans(F.col("messages"))).alias("k", "s")
    )
    return rows.select(
        "conv_id",
        F.col("k").cast("bigint").alias("k"),
        F.col("s.start").cast("bigint").alias("start"),
        F.col("s.end").cast("bigint").alias("end"),
    )


@query
def normalize_scored_pref(spark, sf):
    rows = preference.normalize_scored(
        preference.scored_filter(frames.scored_pairs(frames.conversations(spark, sf))), ["conv_id"]
    )
    return rows.select(
        "conv_id",
        *[F.md5(frames.joined(F.col(c))).alias(c) for c in ("prompt", "chosen", "rejected")],
        "preference_strength",
        "source_split",
    )


@query
def completion_health(spark, sf):
    turns = frames.table(spark, sf, "conversations")
    return turns.select(
        "conv_id", "turn", F.round(quality.completion_health(F.col("text")), 6).alias("score")
    )


@query
def content_fingerprint(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        hashing.sha256_key(F.col("text")).alias("sha256"),
        hashing.file_key(F.concat_ws("/", "source", "doc_id")).alias("file_key"),
    )


# ---- streaming -------------------------------------------------------------------------------


@query
def stream_prepare(spark, sf):
    schema = "doc_id long, text string, source string"
    docs = documents(spark, sf).select("doc_id", "text", "source")
    landing, out, checkpoint = (scratch_path(spark, n) for n in ("landing", "stream", "stream-checkpoint"))
    even = F.col("doc_id") % 2 == 0
    # Files arrive in two waves; the run between them and the last one find nothing new. A wave is at
    # most one file a core, however many splits the table has: a batch of two files has a fixed cost.
    cores = spark.sparkContext.defaultParallelism
    for wave in (even, None, ~even, None):
        if wave is not None:
            docs.filter(wave).coalesce(cores).write.mode("append").parquet(landing)
        stream = prepared_stream(
            spark, landing, schema, FRACTION, BpeModel(), method="md5", files_per_batch=2
        )
        prepare_available(stream, out, checkpoint, "source", "doc_id")
    return stream_counts(spark, out)


@query
def prepare_incremental(spark, sf):
    root, out = scratch_path(spark, "raw"), scratch_path(spark, "incremental")
    docs, n = documents(spark, sf).select("doc_id", "text", "source"), frames.source_number()

    def land(part: DataFrame) -> incremental.Snapshot:
        """One file for each source, in place of the one it had."""
        writer = part.repartition("source").write.mode("overwrite").partitionBy("source")
        writer.option("partitionOverwriteMode", "dynamic").parquet(root)
        return incremental.prepare_incremental(spark, root, BpeModel(), out, FRACTION, method="md5")

    first = land(docs.filter(n % 3 != 2))
    same = incremental.prepare_incremental(spark, root, BpeModel(), out, FRACTION, method="md5")
    # A third of the files changes, a third is new.
    land(docs.filter((n % 3 == 2) | ((n % 3 == 0) & F.expr("doc_id div 20 % 2 = 0"))))
    last = incremental.compact(spark, out, dead_share=0.0)
    audit = incremental.audit_snapshot(spark, out, BpeModel().sha256(), last.version)
    passed = audit.agg(F.min(F.col("passed").cast("int"))).scalar()
    # Files of the first build that did not change since have the same fingerprint there.
    kept = first.builds.select("source", "source_bytes", "source_mtime").withColumn("_first", F.lit(True))
    builds = last.builds.join(kept, ["source", "source_bytes", "source_mtime"], "left")
    return builds.select(
        F.regexp_extract("source", "source=([^/]*)/", 1).alias("source"),
        F.when(F.col("_first"), 1).otherwise(2).alias("wave"),
        "documents",
        "skipped_documents",
        "train_tokens",
        "validation_tokens",
        (passed == 1).alias("passed"),
        F.lit(same.version == first.version).alias("unchanged_run_kept"),
    )


@query
def stream_interval_rollup(spark, sf):
    events = frames.table(spark, sf, "events").select("event_id", "value", "ts")
    landing = scratch_path(spark, "log")
    # The log in files without any order, a few of them a batch.
    events.repartition(8).write.parquet(landing)
    log = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(landing)
    log = log.withColumn("step", F.col("event_id") + 1)
    out, checkpoint = scratch_path(spark, "rollup"), scratch_path(spark, "rollup-checkpoint")
    rollup_available(log, out, checkpoint, "step", "value", "ts", 10)
    return rolled_windows(spark, out, 10, 65_536).select(
        "step",
        "tokens",
        "steps",
        F.round("loss", 6).alias("loss"),
        F.round("elapsed_seconds", 3).alias("elapsed_seconds"),
        F.round("tokens_per_second", 3).alias("tokens_per_second"),
    )
