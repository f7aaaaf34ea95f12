"""Mixing sources to target weights by repetition and one seeded draw.

Words are summed per source; targets share all words by the sources' weights, but stop at ``most``
times what a source has, and what is cut off is shared anew among the others. A document is taken
``floor(rate)`` times, and once more with the probability of the remainder: the hash of seed and id
below it. So every run takes the same copies, and no document looks at another.

Sources are ranked over range partitions, not in one task; only sums over all sources reach the
driver. Documents meet their source's row in a join that AQE may split or broadcast by its own size
check.

Defined results: null and empty texts have size 0 (a rate is 0 where a source has no words); the
null source is a source, ranked last; ids may be null (equal ids draw alike); an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.hashing import seeded_hash
from textloom.llm.common import WORD
from textloom.operators.ranking import global_offsets
from textloom.session import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 2024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(seed: int, doc_id: Column) -> Column:
    """A number in [0, 1) from seed and id: 52 bits of their md5."""
    digest = seeded_hash(seed, doc_id)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))
    ranked = global_offsets(totals.withColumn("key", key), "key", F.lit(1), "nth")
    listed = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn(
        "weight", F.element_at(listed, (F.col("nth") % len(weights) + 1).cast("int"))
    )
    ranked = materialize(ranked.select("source", "source_size", "weight"), "sources")
    # The level at which targets are weight * level, or the stop; each step adds stopped sources.
    level, stopped_before = 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") > F.col("source_size") * most
        sums = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, F.col("source_size") * most).otherwise(0)).alias("cut"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"),
            F.sum(above.cast("int")).alias("stopped"),
        ).first()
        if not sums["open"] or sums["stopped"] == stopped_before:
            break
        level, stopped_before = (sums["all"] - sums["cut"]) / sums["open"], sums["stopped"]
    target = F.least(F.lit(level) * F.col("weight"), (F.col("source_size") * most).cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def copies(target: Column, source_size: Column, doc_id: Column, seed: int) -> Column:
    """How often a document is taken."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return (whole + (draw(seed, doc_id) < rate - whole).cast("bigint")).cast("bigint")


def with_copies(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """``docs`` with ``_size, _source_size, _target, _copies``; the join is null-safe."""
    sized = docs.withColumn("_size", word_count(F.col("text")))
    shares = targets(sized.select("source", F.col("_size").alias("size")), **options)
    shares = shares.select(
        F.col("source").alias("_source"),
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
    )
    joined = sized.join(shares, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return joined.withColumn(
        "_copies", copies(F.col("_target"), F.col("_source_size"), F.col("doc_id"), seed)
    )


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """``docs``, each row as often as it is taken."""
    taken = with_copies(docs, seed, **options).filter("_copies > 0")
    repeated = taken.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return repeated.select(*docs.columns)


def report(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = materialize(sized, "sizes")
    shares = targets(sized.select("source", "size"), **options).withColumnRenamed("source", "_source")
    joined = sized.join(shares, F.col("source").eqNullSafe(F.col("_source")))
    times = copies(F.col("target"), F.col("source_size"), F.col("doc_id"), seed)
    return joined.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken")
    )


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS nth
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, nth) AS k FROM w
), l AS (
  SELECT k, weight, source_size,
         (sum(source_size) OVER ()
           - coalesce({MOST} * sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM o
), f AS (
  SELECT min_by(level, k) AS level FROM l WHERE level * weight <= {MOST} * source_size
), t AS (
  SELECT source, source_size, least(f.level * weight, CAST({MOST} * source_size AS DOUBLE)) AS target
  FROM w, f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
