"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the ``NEAREST`` of ``PIVOTS`` reference points that are nearest to it, in
order. Inverted lists, one for each label and pivot, hold the vectors that name the pivot. Two vectors
of a list are candidates if they share at least ``SHARED`` pivots, and this is their smallest shared
one, so that a pair is looked at once; candidates are verified by cosine in double precision.

Lists are cut into blocks by hash, and pairs of blocks meet in a task, so a list of any length is
spread. A task returns for each vector how many it is linked with and the smallest vector it reaches
within the task, never its pairs. Equal vectors are one node with a weight.

The pivots are the only thing fitted on a sample: ``PIVOTS`` distinct vectors with the smallest hash.
Every vector is indexed.

Defined results: vectors that are null, empty, zero or not finite, and null labels, link with nothing;
vectors of different lengths do not meet; a row with a null id has no component and is not kept, and
does not count as a link; repeated rows count as often as they come; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import components
from textloom.llm.vectors import as_doubles, usable
from textloom.session import materialize

PIVOTS, NEAREST, SHARED, BLOCK = 64, 8, 3, 512
THRESHOLD = 0.93


def _pivots(nodes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Unit reference points by vector length; ``count`` rows reach the driver for each length."""
    out = {}
    for row in nodes.select("dim").distinct().limit(64).collect():
        dim = row["dim"]
        some = nodes.filter(F.col("dim") == dim).orderBy(F.xxhash64("vector"), "rep").limit(count)
        points = np.array([r["vector"] for r in some.select("vector").collect()], dtype=np.float64)
        points = points / np.abs(points).max(1, keepdims=True)
        out[dim] = points / np.linalg.norm(points, axis=1, keepdims=True)
    return out


def _described(pivots: dict[int, np.ndarray], nearest: int) -> Callable:
    """Adds the ordered nearest pivots. Lengths without pivots of their own use fixed axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            vectors = batch.column("vector").to_pylist()
            order: list = [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                points = pivots.get(int(dim))
                if points is None:
                    points = np.eye(int(dim))[:PIVOTS]
                close = np.array([vectors[i] for i in at]) @ points.T
                for i, best in zip(at, np.argsort(-close, axis=1, kind="stable")[:, :nearest]):
                    order[i] = best.tolist()
            arrays = [*batch.columns, pa.array(order, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "pivots"])

    return run


def _linked(shared: int, threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Links of one block pair: for each vector the weight of its partners, and the smallest vector
    that it reaches here."""

    def run(table: pa.Table) -> pa.Table:
        first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        pivot = table.column("pivot")[0].as_py()
        block = table.column("block").to_numpy()
        rep = table.column("rep").to_numpy()
        weight = table.column("weight").to_numpy()
        vectors = np.array(table.column("vector").to_pylist(), dtype=np.float64)
        named = np.zeros((len(rep), PIVOTS), np.float32)
        for i, row in enumerate(table.column("pivots").to_pylist()):
            named[i, row] = 1
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        common = named[left] @ named[right].T
        before = named[left, :pivot] @ named[right, :pivot].T
        # A small table has fewer pivots than a pair has to share.
        candidate = (common >= min(shared, named[0].sum())) & (before == 0)
        if first == second:
            candidate = np.triu(candidate, 1)
        i, j = np.nonzero(candidate)
        keep = []
        for lo in range(0, len(i), 200_000):
            a, b = left[i[lo : lo + 200_000]], right[j[lo : lo + 200_000]]
            close = np.einsum("nd,nd->n", vectors[a], vectors[b]) >= threshold
            keep.append(np.stack([a[close], b[close]]))
        pairs = np.concatenate(keep, axis=1) if keep else np.zeros((2, 0), np.int64)
        add = np.bincount(pairs[0], weights=weight[pairs[1]], minlength=len(rep))
        add += np.bincount(pairs[1], weights=weight[pairs[0]], minlength=len(rep))
        root = rep.copy()
        while True:  # the smallest label spreads along links
            low = root.copy()
            np.minimum.at(low, pairs[0], root[pairs[1]])
            np.minimum.at(low, pairs[1], root[pairs[0]])
            if (low == root).all():
                break
            root = low
        told = np.flatnonzero(add > 0)
        return pa.table(
            {
                "rep": pa.array(rep[told]),
                "added": pa.array(add[told].astype(np.int64)),
                "root": pa.array(root[told]),
            }
        )

    return run


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    nearest: int = NEAREST,
    shared: int = SHARED,
) -> DataFrame:
    """``<id_col>, n_links, component_id, kept`` for every row of ``vectors``."""
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"),
        as_doubles(F.col(vector_col)).alias("vector"),
    )
    fine = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = materialize(rows.withColumn("fine", fine), "vectors")
    nodes = rows.filter("fine").groupBy("label", "vector").agg(
        F.min("id").alias("rep"), F.count("*").alias("weight")
    )
    nodes = materialize(nodes.withColumn("dim", F.size("vector")), "nodes")
    unit = F.aggregate("vector", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    scaled = nodes.withColumn("top", unit).withColumn(
        "vector", F.transform("vector", lambda x: x / F.col("top"))
    )
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    scaled = scaled.withColumn("norm", norm).withColumn(
        "vector", F.transform("vector", lambda x: x / F.col("norm"))
    )
    scaled = scaled.select("label", "dim", "rep", "weight", "vector")
    pivots = _pivots(nodes, PIVOTS)
    schema = T.StructType([*scaled.schema.fields, T.StructField("pivots", T.ArrayType(T.IntegerType()))])
    described = scaled.mapInArrow(_described(pivots, nearest), schema)
    lists = materialize(described.withColumn("pivot", F.explode("pivots")), "lists")
    sizes = lists.groupBy("label", "dim", "pivot").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    )
    placed = lists.join(sizes, ["label", "dim", "pivot"]).withColumn(
        "block", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int")
    )
    paired = placed.withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    keys = ["label", "dim", "pivot", "first", "second"]
    found = paired.select(*keys, "block", "rep", "weight", "vector", "pivots").groupBy(*keys).applyInArrow(
        _linked(shared, threshold), "rep bigint, added bigint, root bigint"
    )
    found = materialize(found, "found")
    classes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("added").alias("added"))
    known = (
        nodes.select("label", "vector", "rep", "weight")
        .join(links, "rep", "left")
        .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.col("label").alias("_label"),
            F.col("vector").alias("_vector"),
            (F.coalesce("added", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("root", "rep").alias("component_id"),
        )
    )
    same = (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector"))
    joined = rows.filter("fine").join(known, same).select("id", "n_links", "component_id")
    rest = rows.filter("NOT fine").select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")
    )
    return joined.union(rest).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
