"""Merkle manifest of a data set: a tree of digests per source, and one over the sources.

A row becomes a leaf: the SHA-256 of its fields, each behind its byte count. In a source, leaves
stand in the order of their ids; every ``fan`` consecutive nodes (the last run may be shorter) become
one node of the next level, until one is left. These subroots, in the order of the sources, make a
tree of the same kind, whose root names the whole data set. The proof of a row is what its leaf needs
to be folded up to that root: on each level the digests left and right of it in its run.

Per level, ``lag`` and ``lead`` columns of the fixed offsets 1 to ``fan - 1``, masked by a node's slot
and the length of its run, are a node's siblings; the first row of a run hashes the parent. A window
covers ``SPAN_RUNS`` whole runs, so no source is sorted in one task. Positions come from a
range partitioning by source, id and digest: the place inside the sorted partition plus the rows of
the partitions before it. Only digests move; texts are read once. The driver sees the row count of
each partition, the depth of the trees and the root.

Defined results: any field may be null (it is written ``-``); the null source is a source and comes
first; rows with a null id come first in their source; equal ids stand in the order of their digests,
and equal rows take the places of their group in any order (their proofs as a set do not depend on
it); a source of one row has its leaf as subroot, and a single subroot is the root; with no siblings
at all the proof is that of nothing; an empty table has no rows and no root. Further columns of the
table do not matter.
"""

from __future__ import annotations

from itertools import accumulate
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arith import whole_div
from textloom.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
# Runs that one window partition holds.
SPAN_RUNS = 4
# Spark numbers the rows of a partition in the low 33 bits of its row ids.
ROW_BITS = 33

PROOF = "array<struct<left binary, right binary>>"


def framed(value: Column) -> Column:
    """A field as it enters a leaf: ``-``, or its UTF-8 length, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def digest_of(*parts: Column) -> Column:
    """SHA-256 of texts one after the other, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hex_of(digests: Column) -> Column:
    """One digest, or several one after the other, as lower-case hexadecimal text."""
    return F.lower(F.hex(digests))


def leaf_of(fields: dict[str, Column]) -> Column:
    """Digest of a row from its fields, in their order."""
    return digest_of(*[framed(c) for c in fields.values()])


def positioned(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, the place of a row in the given order, from 0 and without gaps.

    ``order`` must tell rows apart, or places of equal rows are shared out at will.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_row", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_row", ROW_BITS)
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).count().collect())
    before = accumulate([0, *[n for _, n in counts]])
    bases = placed.sparkSession.createDataFrame(
        [(p, b) for (p, _), b in zip(counts, before)], "_part long, _base long"
    )
    inside = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(bases, "_part")
        .withColumn("at", F.col("_base") + inside)
        .drop("_part", "_base", "_row")
    )


def _with_siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """Adds ``left`` and ``right``: the digests beside a node in its run, in order."""
    slot = f"pmod(pos, {fan})"
    length = f"least({fan}, n - pos + {slot})"
    span = f"OVER (PARTITION BY tree, pos div {fan * SPAN_RUNS} ORDER BY pos)"
    before = [f"if({slot} >= {k}, lag(digest, {k}) {span}, X'')" for k in range(fan - 1, 0, -1)]
    after = [f"if({slot} + {k} < {length}, lead(digest, {k}) {span}, X'')" for k in range(1, fan)]
    return nodes.selectExpr(
        "*", f"concat({', '.join(before)}) AS left", f"concat({', '.join(after)}) AS right"
    )


def _levels(nodes: DataFrame, fan: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Trees from their leaves ``tree, pos, n, digest, ...`` (``n``: leaves of the tree).

    Returns the levels below the roots, with siblings, and the roots that each level has (``tree,
    pos, digest`` and what else a leaf carries), both from the leaves up.
    """
    levels, roots = [], []
    left = nodes.agg(F.max("n").alias("n")).first().n or 0
    while True:
        roots.append(nodes.filter("n = 1"))
        if left <= 1:
            return levels, roots
        level = materialize(_with_siblings(nodes.filter("n > 1"), fan), "level")
        levels.append(level)
        nodes = level.filter(F.pmod("pos", F.lit(fan)) == 0).select(
            "tree",
            whole_div(F.col("pos"), fan).alias("pos"),
            whole_div(F.col("n") + (fan - 1), fan).alias("n"),
            digest_of(hex_of(F.concat("digest", "right"))).alias("digest"),
        )
        left = -(-left // fan)


def _proofs(
    levels: list[DataFrame], roots: list[DataFrame], above: DataFrame, fan: int
) -> DataFrame:
    """Leaves with ``proof`` from their level up, and the further columns of ``above``.

    ``above`` has ``tree``, the ``proof`` of its root in whatever stands over it, and more.
    """
    rest = [c for c in above.columns if c != "tree"]
    above = above.withColumnRenamed("tree", "_tree")
    known = None
    for k in reversed(range(len(roots))):
        carried = [c for c in roots[k].columns if c not in ("n", "left", "right")]
        found = roots[k].join(above, F.col("tree").eqNullSafe(F.col("_tree"))).select(*carried, *rest)
        if known is not None:
            level = levels[k].withColumn("_up", whole_div(F.col("pos"), fan))
            parents = known.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), *rest)
            same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_up") == F.col("_pos"))
            here = F.array(F.struct("left", "right")).cast(PROOF)
            joined = level.join(parents, same).withColumn("proof", F.concat(here, "proof"))
            found = found.unionByName(joined.select(*carried, *rest))
        known = found
    return known


def prove(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    fields: tuple[str, ...] = FIELDS,
    carry: dict[str, Column] | None = None,
    fan: int = FAN,
) -> DataFrame:
    """``doc, tree`` (id and source of a row), ``digest`` (its leaf), ``subroot``, ``root`` as 32 bytes
    each, ``proof`` (siblings ``left`` and ``right`` of each level, from the leaf up), and the columns
    of ``carry``, small values computed from a row."""
    carry = carry or {}
    leaves = docs.select(
        F.col(source_col).alias("tree"),
        F.col(id_col).alias("doc"),
        leaf_of({c: F.col(c) for c in fields}).alias("digest"),
        *[c.alias(name) for name, c in carry.items()],
        F.monotonically_increasing_id().alias("_nth"),
    )
    leaves = materialize(leaves, "leaves")
    placed = positioned(leaves, ["tree", "doc", "digest", "_nth"])
    sizes = placed.groupBy("tree").agg(F.min("at").alias("_first"), F.count("*").alias("n"))
    sizes = materialize(sizes, "sources").withColumnRenamed("tree", "_tree")
    nodes = placed.join(sizes, F.col("tree").eqNullSafe(F.col("_tree"))).select(
        "tree",
        (F.col("at") - F.col("_first")).alias("pos"),
        "n",
        "digest",
        "doc",
        *carry,
    )
    levels, roots = _levels(nodes, fan)

    subroots = roots[0].select("tree", "digest")
    for found in roots[1:]:
        subroots = subroots.union(found.select("tree", "digest"))
    subroots = materialize(subroots, "subroots")
    listed = positioned(subroots.withColumnRenamed("tree", "source"), ["source"])
    tops = listed.select(
        F.lit(0).alias("tree"), F.col("at").alias("pos"), F.lit(subroots.count()).alias("n"), "digest", "source"
    )
    top_levels, top_roots = _levels(tops, fan)
    root = next((r.digest for found in reversed(top_roots) for r in found.take(1)), None)
    over = subroots.sparkSession.range(1).select(
        F.lit(0).alias("tree"), F.array().cast(PROOF).alias("proof"), F.lit(root).alias("root")
    )
    above = _proofs(top_levels, top_roots, over, fan).select(
        F.col("source").alias("tree"), "proof", F.col("digest").alias("subroot"), "root"
    )
    return _proofs(levels, roots, materialize(above, "tops"), fan).drop("pos")


def folded(leaf: Column, proof: Column) -> Column:
    """Root that a leaf and its proof lead to, as 32 bytes."""
    return F.aggregate(
        proof,
        leaf,
        lambda held, level: digest_of(hex_of(F.concat(level["left"], held, level["right"]))),
    )


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, left to right and level by level, as hexadecimal text."""
    texts = F.transform(proof, lambda level: hex_of(F.concat(level["left"], level["right"])))
    return F.sha2(F.array_join(texts, ""), 256)


def audit(
    docs: DataFrame,
    tampered: dict[str, Column],
    where: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    fields: tuple[str, ...] = FIELDS,
    fan: int = FAN,
) -> DataFrame:
    """Proves every row, changes the fields ``tampered`` of the rows ``where`` says, and folds what
    the row is now with the proof it had: ``<id_col>, leaf, subroot, root, proof_sha256, folded_root,
    verified``, digests as text."""
    changed = leaf_of({c: tampered.get(c, F.col(c)) for c in fields})
    now = F.when(F.coalesce(where, F.lit(False)), changed)
    proved = prove(docs, id_col, source_col, fields, {"now": now}, fan)
    again = folded(F.coalesce("now", "digest"), F.col("proof"))
    rows = proved.select(
        F.col("doc").alias(id_col),
        hex_of("digest").alias("leaf"),
        hex_of("subroot").alias("subroot"),
        hex_of("root").alias("root"),
        proof_digest(F.col("proof")).alias("proof_sha256"),
        hex_of(again).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(docs: DataFrame) -> DataFrame:
    """:func:`audit` where texts lose their capitals A-Z in every fifth row by the CRC-32 of its id."""
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return audit(docs, {"text": F.translate("text", ascii_uppercase, ascii_lowercase)}, fifth)


def _sql_tree(name: str, leaves: str, fan: int) -> str:
    """Nodes of all trees over ``leaves`` (tree, pos, n, digest), and their runs as lists."""
    return f"""
{name}_nodes AS (
  SELECT 0 AS level, tree, pos, n, digest FROM {leaves}
  UNION ALL
  SELECT level + 1, tree, pos // {fan}, (any_value(n) + {fan - 1}) // {fan}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name}_nodes WHERE n > 1 GROUP BY level, tree, pos // {fan}
),
{name}_runs AS (
  SELECT level, tree, pos // {fan} AS run, list(digest ORDER BY pos) AS digests
  FROM {name}_nodes WHERE n > 1 GROUP BY ALL
),
{name}_roots AS (SELECT tree, digest FROM {name}_nodes WHERE n = 1)"""


def _sql_folds(name: str, start: str, fan: int) -> str:
    """Folds ``start`` (row, tree, pos, digest, proof) up to the root of its tree."""
    return f"""
{name}_steps AS (
  SELECT row, 0 AS level, tree, pos, digest, proof FROM {start}
  UNION ALL
  SELECT row, level + 1, tree, pos // {fan}, sha256(before || digest || after), proof || before || after
  FROM (SELECT s.*, array_to_string(digests[:pos % {fan}], '') AS before,
               array_to_string(digests[pos % {fan} + 2:], '') AS after
        FROM {name}_steps AS s JOIN {name}_runs AS r
          ON r.level = s.level AND r.tree = s.tree AND r.run = s.pos // {fan})
),
{name}_folded AS (
  SELECT row, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM {name}_steps GROUP BY row
)"""


def sql(fan: int = FAN) -> str:
    """:func:`lowered` in SQL, with the CRC-32 spelled out."""

    def leaf(text: str) -> str:
        parts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in parts) + ")"

    lower = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)
),
rows AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce('1' || source, '0') AS tree, {leaf("text")} AS leaf, {leaf(lower)} AS low,
    xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS tampered
  FROM documents, crc_table
),
leaves AS (
  SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n
  FROM rows
),{_sql_tree("low", "leaves", fan)},
tops AS (
  SELECT 0 AS tree, tree AS source, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest
  FROM low_roots
),{_sql_tree("top", "tops", fan)},
first AS (
  SELECT row, tree, pos, CASE WHEN tampered THEN low ELSE leaf END AS digest, '' AS proof FROM leaves
),{_sql_folds("low", "first", fan)},
second AS (
  SELECT row, tops.tree, tops.pos, low_folded.digest, proof
  FROM low_folded JOIN leaves USING (row) JOIN tops ON tops.source = leaves.tree
),{_sql_folds("top", "second", fan)}
SELECT doc_id, leaf, tops.digest AS subroot, top_roots.digest AS root, sha256(proof) AS proof_sha256,
  top_folded.digest AS folded_root, top_folded.digest = top_roots.digest AS verified
FROM leaves JOIN tops ON tops.source = leaves.tree JOIN top_folded USING (row), top_roots"""
