"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds stand alone: assignments of a value to a secret-like name, access identifiers, long hex
runs. Weak kinds mean something only together: an identifier (user, client id, access key name), a
secret that only its look gives away, an endpoint. Their spans go into one narrow table, and an
interval join within a scope of ``SCOPE`` code points links them: identifiers and secrets (base
spans count as either) report each other, endpoints and secrets do too, and an endpoint is reported
next to either member of a linked pair. An identifier and an endpoint alone are not reported. The join
hashes on document and position bucket, so a document with very many parts is spread as well.

Matches are leftmost and do not overlap within a kind; offsets are code points, ends exclusive. Weak
spans that overlap a base span are left out. Offsets come from the pieces between the matches, which
are summed in runs of ``RUN``, so the work on a long text stays near linear.

Defined results: a null text is empty and has no spans; null ids are allowed; repeated rows give the
same result each; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bound
from textloom.session import materialize

# The base kinds, in the order of the digest. Runs that are too short are no matches at
# all, which leaves the same spans as dropping them afterwards.
ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE = {
    "assign": (ASSIGN, 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
# A text without these has no span of the kind.
HINTS = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
WEAK = {
    "identifier": (
        r"(?i)(?<![A-Za-z0-9_])(?:access_?key_?id|client_?id|user_?name|user|login)[\"']?\x20*[:=]\x20*[\"']?"
        r"([A-Za-z0-9._@-]+)",
        1,
        3,
    ),
    "phrase": (
        r"(?<![A-Za-z0-9+/=_-])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])"
        r"[A-Za-z0-9+/]{20,}={0,2}",
        0,
        20,
    ),
    "endpoint": (r"(?i)(?<![A-Za-z0-9_])(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|redis|amqp)://[^\s\"'<>]+", 0, 10),
}
HINTS |= {
    "identifier": r"(?i)(?:key_?id|client_?id|user|login|name)[\"']?\x20*[:=]",
    "phrase": r"[A-Za-z0-9+/]{20}",
    "endpoint": r"://",
}
KINDS = [*BASE, *WEAK]
SCOPE, BUCKET, RUN, CHUNK = 200, 512, 256, 512
SPAN = "struct<start:int,nth:int,kind:string,end:int>"
SPANS = f"array<{SPAN}>"


def _rule(kind: str) -> tuple[str, int, int]:
    return BASE.get(kind) or WEAK[kind]


def kind_spans(text: Column, kind: str) -> Column:
    """Spans of one kind, in order."""
    pattern, group, least = _rule(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    parts = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"), values.alias("value")),
        lambda p: F.struct(
            F.length(p["gap"]).alias("gap"),
            F.length(p["hit"]).alias("hit"),
            F.length(p["value"]).alias("value"),
        ),
    )

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0), lambda held, p: held + p["gap"] + p["hit"])

    def placed(items: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int"))
        return F.flatten(
            F.transform(
                runs,
                lambda r: F.transform(
                    F.array(F.struct(total(F.slice(items, 1, r * RUN)).alias("base"), F.slice(items, r * RUN + 1, RUN).alias("own"))),
                    lambda block: F.transform(
                        block["own"],
                        lambda p, i: F.struct(
                            (block["base"] + total(F.slice(block["own"], 1, i)) + p["gap"]).alias("start"),
                            F.lit(KINDS.index(kind)).alias("nth"),
                            F.lit(kind).alias("kind"),
                            (block["base"] + total(F.slice(block["own"], 1, i)) + p["gap"] + p["hit"]).alias("end"),
                            p["value"].alias("value"),
                        ),
                    ),
                ),
            )
        )

    # The pieces are bound once, as the only element of an array.
    spans = F.flatten(F.flatten(F.transform(F.array(parts), placed)))
    kept = F.transform(
        F.filter(spans, lambda s: s["value"] >= least),
        lambda s: F.struct(s["start"], s["nth"], s["kind"], s["end"]),
    ).cast(SPANS)
    return F.when(text.rlike(HINTS[kind]) & (F.size(found) > 0), kept).otherwise(
        F.array().cast(SPANS)
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def _parts(found: DataFrame) -> DataFrame:
    """Every part of every document once: ``rid, id, role, span``."""
    roles = F.when(F.col("s.kind").isin("access", "identifier"), "identifier").when(
        F.col("s.kind") == "endpoint", "endpoint"
    ).otherwise("secret")
    exploded = found.filter(F.size("weak") > 0).select(
        "rid", "id", F.explode(F.concat("base", "weak")).alias("s")
    )
    return exploded.select("rid", "id", roles.alias("role"), "s").distinct()


def _near(left: DataFrame, right: DataFrame) -> DataFrame:
    """Interval join: pairs of spans of one document that are within the scope of each other."""
    reach = left.withColumn(
        "bucket",
        F.explode(
            F.sequence(
                F.floor(F.greatest(F.col("s.start") - SCOPE, F.lit(0)) / BUCKET).cast("int"),
                F.floor((F.col("s.end") + SCOPE) / BUCKET).cast("int"),
            )
        ),
    )
    other = right.select(
        "rid", "id", F.col("s").alias("t"),
        F.explode(
            F.sequence(
                F.floor(F.col("s.start") / BUCKET).cast("int"),
                F.floor(F.col("s.end") / BUCKET).cast("int"),
            )
        ).alias("bucket"),
    )
    same = (
        (reach["rid"] == other["rid"])
        & reach["id"].eqNullSafe(other["id"])
        & (reach["bucket"] == other["bucket"])
    )
    close = (F.col("t.start") <= F.col("s.end") + SCOPE) & (F.col("t.end") >= F.col("s.start") - SCOPE)
    apart = (F.col("t.start") >= F.col("s.end")) | (F.col("t.end") <= F.col("s.start"))
    return reach.join(other, same & close & apart).select(reach["rid"], reach["id"], "s", "t")


def linked(found: DataFrame) -> DataFrame:
    """``rid, id, spans``: the weak spans that complementary parts support."""
    parts = materialize(_parts(found), "parts")
    pairs = _near(parts.filter("role <> 'secret'"), parts.filter("role = 'secret'"))
    pairs = materialize(pairs, "pairs")
    ends = pairs.select("rid", "id", F.explode(F.array("s", "t")).alias("s")).distinct()
    beside = _near(parts.filter("role = 'endpoint'"), ends.filter("s.kind IN ('access', 'identifier')"))
    reported = ends.union(beside.select("rid", "id", "s")).filter(F.col("s.kind").isin(*WEAK))
    return reported.groupBy("rid", "id").agg(F.sort_array(F.collect_set("s")).alias("spans"))


def _without_overlap(weak: Column, base: Column) -> Column:
    return F.filter(
        weak,
        lambda w: ~F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])),
    )


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rid, id, base, weak_spans`` for every row of ``docs``; ``rid`` stands for id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", F.xxhash64("id", "text").alias("rid"), text.alias("text"))
    base = rows.select(
        "id", "rid",
        F.sort_array(F.concat(*[kind_spans(F.col("text"), k) for k in BASE])).alias("base"),
        F.concat(*[kind_spans(F.col("text"), k) for k in WEAK]).alias("weak"),
    )
    base = base.withColumn("weak", _without_overlap(F.col("weak"), F.col("base")))
    found = materialize(base, "secrets")
    links = linked(found).select(
        F.col("rid").alias("_rid"), F.col("id").alias("_id"), F.col("spans").alias("linked")
    )
    same = (F.col("rid") == F.col("_rid")) & F.col("id").eqNullSafe(F.col("_id"))
    return found.join(links, same, "left").select(
        "rid", "id", "base", F.coalesce("linked", F.array().cast(SPANS)).alias("weak_spans")
    )


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _count(spans: str, kind: str) -> Column:
    return F.size(_of_kind(spans, kind)).cast("bigint")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs``."""
    found = secret_spans(docs)
    counts = [_count("base", kind).alias(f"n_{kind}") for kind in BASE]
    return found.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.sort_array(F.concat("base", "weak_spans"))).alias("spans"),
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span overwritten by asterisks, length unchanged.

    Spans are those of the original text, kind by kind, so what one kind covers hides no other.
    """
    names = [c if c in (id_col, text_col) else f"column {i}" for i, c in enumerate(docs.columns)]
    rows = docs.toDF(*names).withColumn("_row", F.xxhash64(id_col, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = rows.select(
        F.col(id_col).alias("id"),
        F.col("_row").alias("rid"),
        F.concat(*[kind_spans(text, k) for k in BASE]).alias("base"),
        F.concat(*[kind_spans(text, k) for k in WEAK]).alias("weak"),
    )
    found = found.withColumn("weak", _without_overlap(F.col("weak"), F.col("base")))
    links = linked(materialize(found.filter(F.size("weak") > 0), "secrets")).select(
        F.col("rid").alias("_rid"), F.col("id").alias("_id"), F.col("spans").alias("_spans")
    )
    same = (F.col("_row") == F.col("_rid")) & F.col(id_col).eqNullSafe(F.col("_id"))
    joined = rows.join(links, same, "left")
    spans = {f"_{kind}": kind_spans(F.col(text_col), kind) for kind in BASE}
    spans |= {f"_{kind}": _of_kind("_spans", kind) for kind in WEAK}
    joined = joined.withColumns(spans)
    # A step at a time: each one names the text it works on more than once.
    for name in spans:
        joined = joined.withColumn(text_col, _overwritten(F.col(text_col), F.col(name)))
    return joined.select(*[F.col(f"`{c}`") for c in names]).toDF(*docs.columns)


def _overwritten(text: Column, spans: Column) -> Column:
    """The text with spans that do not overlap each other, in order, as asterisks.

    Code points are counted in chunks: a piece between two spans is the end of a chunk, whole chunks,
    and the beginning of a chunk, so the work is in proportion to the text and the number of spans.
    """

    def within(chunks: Column) -> Column:
        def piece(begin: Column, end: Column) -> Column:
            first, last = F.floor(begin / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
            cut = lambda nth, lo, size: F.coalesce(
                F.get(chunks, nth).substr(lo + 1, size), F.lit("")
            )
            lo = begin - first * CHUNK
            inner = F.when(
                last > first + 1, F.array_join(F.slice(chunks, first + 2, last - first - 1), "")
            ).otherwise("")
            apart = F.concat(cut(first, lo, F.lit(CHUNK)), inner, cut(last, F.lit(0), end - last * CHUNK))
            return F.when(first == last, cut(first, lo, end - begin)).otherwise(apart)

        def masked_pieces(own: Column) -> Column:
            before = lambda i: F.when(i == 0, 0).otherwise(F.get(own, i - 1)["end"])
            parts = F.transform(
                own,
                lambda s, i: F.concat(
                    piece(before(i), s["start"]), F.repeat(F.lit("*"), s["end"] - s["start"])
                ),
            )
            return F.concat(F.array_join(parts, ""), piece(before(F.size(own)), F.length(text)))

        return bound(spans, masked_pieces)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    any_ = F.coalesce(F.size(spans) > 0, F.lit(False))
    return F.when(text.isNotNull() & any_, bound(chunks, within)).otherwise(text)
