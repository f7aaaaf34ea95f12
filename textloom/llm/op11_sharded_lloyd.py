"""Lloyd's clustering with the dimensions of the vectors dealt out to shards.

Vectors are cut into column blocks of ``SHARD_DIMS`` components. A task holds chunks of one block and
that block's slice of the centroids, and computes the exact partial distance of every vector to every
centroid. Partial distances of a chunk meet by its number, are added up, and the argmin is the
assignment (ties: the smaller number). The assignment goes back to the blocks; each block adds up its
own columns by cluster, and its slice of a centroid becomes the floor of sum / count. Everything is
integer arithmetic, so the result does not depend on how rows are dealt.

Chunks have at most ``CHUNK`` vectors and are numbered as they are cut, so no key, cluster or copy of
a vector gathers anywhere; sums fold in each task first. What moves in a round is the partial
distances: ``shards * k`` integers a vector, in 32 bits where they fit. The blocks themselves are dealt
by chunk and block once and stay there (cached, and rebuilt from the written table if an executor is
lost). The driver holds the centroids and one row of sums a cluster and component: ``k * dims``
numbers, whatever the size of the table.

Defined results: a vector takes part when it has exactly ``dims`` components, none null or non-finite;
the others, and null vectors, are left out. Vectors may repeat, also with their ids; a null id never
names a starting vector unless there are too few others. With fewer vectors than ``k`` each is a
centroid. A component beyond 2**27 in size after scaling fails the job, because distances would not
fit 64 bits. An empty table gives an empty result. Further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import materialize

DIMS = 64
SCALE = 256
K = 40
ROUNDS = 5
SEED = 2
SHARD_DIMS = 16
CHUNK = 2048
LARGEST = 1 << 27

BLOCKS = "chunk long, shard int, n int, wide boolean, data binary"
PARTIAL = "chunk long, wide boolean, data binary"
LABELS = "chunk long, labels binary, distances binary"
SUMS = "cluster int, dim int, total long, n long"


def scaled(vectors: pa.Array) -> np.ndarray:
    """Rows of ``floor(SCALE * x)``."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(SCALE * flat)
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise OverflowError(f"a component is beyond {LARGEST} after scaling")
    return whole.astype(np.int64).reshape(len(vectors), -1 if len(vectors) else 0)


def _packed(numbers: np.ndarray) -> tuple[bool, bytes]:
    """In four bytes each where all fit, else in eight."""
    wide = bool(len(numbers) and max(-int(numbers.min()), int(numbers.max())) >= 1 << 31)
    return wide, numbers.astype("<i8" if wide else "<i4").tobytes()


def _unpacked(data: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8" if wide else "<i4").astype(np.int64)


def _cut(shard_dims: int, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors to column blocks, and their ids to a row of the same chunk (shard -1)."""

    def rows(number: int, ids: pa.Array, matrix: np.ndarray) -> pa.RecordBatch:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        plain = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
        out = [(-1, True, known.tobytes() + plain.tobytes())]
        for lo in range(0, matrix.shape[1], shard_dims):
            out.append((lo // shard_dims, *_packed(matrix[:, lo : lo + shard_dims].ravel())))
        shards, wide, data = zip(*out)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number] * len(out), pa.int64()),
                pa.array(shards, pa.int32()),
                pa.array([len(matrix)] * len(out), pa.int32()),
                pa.array(wide, pa.bool_()),
                pa.array(data, pa.binary()),
            ],
            names=["chunk", "shard", "n", "wide", "data"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The parts of one run of this task; only one run is committed.
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= chunk:
                table = pa.Table.from_batches(held).combine_chunks()
                part, rest = table.slice(0, chunk), table.slice(chunk)
                yield rows(number, *_columns(part))
                number += 1
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield rows(number, *_columns(pa.Table.from_batches(held)))

    return cut


def _columns(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    ids, vectors = (c.combine_chunks() for c in table.columns)
    return ids, scaled(vectors)


def _partial(slices: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Squared distances of a block's columns to its slice of every centroid."""

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = slices[row["shard"]]
                block = _unpacked(row["data"], row["wide"]).reshape(row["n"], -1)
                out = np.empty((row["n"], len(own)), dtype=np.int64)
                for c, centroid in enumerate(own):
                    step = block - centroid
                    out[:, c] = np.einsum("ij,ij->i", step, step)
                wide, data = _packed(out.ravel())
                yield pa.RecordBatch.from_pydict(
                    {"chunk": [row["chunk"]], "wide": [wide], "data": [data]},
                    schema=pa.schema(
                        [("chunk", pa.int64()), ("wide", pa.bool_()), ("data", pa.binary())]
                    ),
                )

    return distances


def _nearest(k: int) -> Callable[[pa.Table], pa.Table]:
    """Adds up the partial distances of one chunk; the smallest sum says the cluster."""

    def add(table: pa.Table) -> pa.Table:
        total = 0
        for row in table.to_pylist():
            total = total + _unpacked(row["data"], row["wide"]).reshape(-1, k)
        labels = total.argmin(axis=1)
        return pa.table(
            {
                "chunk": table.column("chunk").slice(0, 1),
                "labels": pa.array([labels.astype("<i4").tobytes()], pa.binary()),
                "distances": pa.array([total.min(axis=1).astype("<i8").tobytes()], pa.binary()),
            }
        )

    return add


def _sums(k: int, shard_dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns of the blocks of one task, added up by cluster."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                labels = np.frombuffer(row["labels"], dtype="<i4")
                block = _unpacked(row["data"], row["wide"]).reshape(row["n"], -1)
                total, n = totals.setdefault(
                    row["shard"],
                    (np.zeros((k, block.shape[1]), dtype=np.int64), np.zeros(k, dtype=np.int64)),
                )
                order = np.argsort(labels, kind="stable")
                used, first = np.unique(labels[order], return_index=True)
                total[used] += np.add.reduceat(block[order], first, axis=0)
                n += np.bincount(labels, minlength=k)
        for shard, (total, n) in totals.items():
            used = np.flatnonzero(n)
            width = total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(used, width), pa.int32()),
                    pa.array(np.tile(shard * shard_dims + np.arange(width), len(used)), pa.int32()),
                    pa.array(total[used].ravel()),
                    pa.array(np.repeat(n[used], width)),
                ],
                names=["cluster", "dim", "total", "n"],
            )

    return add


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks back to one row a vector."""
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n"]
            known = np.frombuffer(row["data"], dtype=bool, count=n)
            ids = np.frombuffer(row["data"], dtype="<i8", offset=n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64(), mask=~known),
                    pa.array(np.frombuffer(row["labels"], dtype="<i4"), pa.int32()),
                    pa.array(np.frombuffer(row["distances"], dtype="<i8"), pa.int64()),
                ],
                names=["vec_id", "cluster", "distance"],
            )


def kept_vectors(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the vectors that take part."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce((F.size(v) == dims) & fine, F.lit(False))
    return vectors.filter(usable).select(
        F.col(id_col).cast("bigint").alias("vec_id"), v.cast("array<double>").alias("v")
    )


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids hash smallest, equal ids by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()
    return scaled(pa.array([r.v for r in rows], pa.list_(pa.float64())))


class Clustering:
    """Blocks of the vectors, the centroids after the last round, and the assignment to them."""

    def __init__(
        self,
        vectors: DataFrame,
        k: int = K,
        rounds: int = ROUNDS,
        seed: int = SEED,
        dims: int = DIMS,
        shard_dims: int = SHARD_DIMS,
        chunk: int = CHUNK,
        id_col: str = "vec_id",
        vector_col: str = "embedding",
    ):
        self.spark: SparkSession = vectors.sparkSession
        kept = kept_vectors(vectors, dims, id_col, vector_col)
        self.centroids = first_centroids(kept, k, seed)
        self.shard_dims = shard_dims
        self.tables = materialize(kept.mapInArrow(_cut(shard_dims, chunk), BLOCKS), "blocks")
        self.assigned = None
        if not len(self.centroids):
            return
        parts = max(
            int(self.spark.conf.get("spark.sql.shuffle.partitions")),
            self.spark.sparkContext.defaultParallelism,
        )
        # Each round joins on these keys; dealt once, blocks stay where they are.
        blocks = self.tables.filter("shard >= 0").repartition(parts, "chunk", "shard").persist()
        shards = F.sequence(F.lit(0), F.lit(-(-dims // shard_dims) - 1))
        for _ in range(rounds):
            labels = self._assigned(blocks).select("chunk", "labels")
            told = labels.withColumn("shard", F.explode(shards))
            # One row for each cluster and component.
            sums = (
                blocks.join(told, ["chunk", "shard"])
                .mapInArrow(_sums(len(self.centroids), shard_dims), SUMS)
                .groupBy("cluster", "dim")
                .agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
            )
            for cluster, dim, total, n in sums.collect():
                self.centroids[cluster, dim] = int(total) // n
        self.assigned = materialize(self._assigned(blocks), "assigned")
        blocks.unpersist()

    def _assigned(self, blocks: DataFrame) -> DataFrame:
        slices = [
            self.centroids[:, lo : lo + self.shard_dims].copy()
            for lo in range(0, self.centroids.shape[1], self.shard_dims)
        ]
        partial = blocks.mapInArrow(_partial(slices), PARTIAL)
        return partial.groupBy("chunk").applyInArrow(_nearest(len(self.centroids)), LABELS)

    def rows(self) -> DataFrame:
        """``vec_id, cluster, distance`` of every vector that takes part."""
        if self.assigned is None:
            return self.spark.createDataFrame([], "vec_id long, cluster int, distance long")
        ids = self.tables.filter("shard = -1").select("chunk", "n", "data")
        return ids.join(self.assigned, "chunk").mapInArrow(
            _rows, "vec_id long, cluster int, distance long"
        )

    def centroid_rows(self) -> list[tuple[int, list[int]]]:
        """Number and components of every centroid."""
        return [(i, [int(x) for x in c]) for i, c in enumerate(self.centroids)]


def digests(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector."""
    found = Clustering(vectors, k, rounds, seed, dims)
    rows = materialize(found.rows(), "clustered")
    # At most k rows.
    sums = {
        r.cluster: int(r.total)
        for r in rows.groupBy("cluster")
        .agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total"))
        .collect()
    }
    all_ = sum(sums.values())
    table = found.spark.createDataFrame(
        [
            (i, sums[i], all_, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
            for i, c in found.centroid_rows()
            if i in sums
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(table, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def sql(k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> str:
    """The same result in SQL: rounds spelled out, a row for each vector and centroid."""
    steps = [
        f"""
kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
         sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h
  FROM embeddings
  WHERE len(embedding) = {dims}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v AS c FROM kept
  ORDER BY h LIMIT {k}
)"""
    ]
    for turn in range(rounds + 1):
        steps.append(f"""
a{turn} AS MATERIALIZED (
  SELECT vec_id, h, any_value(v) AS v, min(d * {k} + cluster) % {k} AS cluster, min(d) AS distance
  FROM (SELECT vec_id, h, v, cluster,
               list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
        FROM kept, c{turn})
  GROUP BY vec_id, h
)""")
        if turn < rounds:
            steps.append(f"""
s{turn} AS (
  SELECT cluster, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS x
  FROM a{turn}, range(1, {dims + 1}) AS t(i) GROUP BY cluster, i
),
u{turn} AS (SELECT cluster, list(x ORDER BY i) AS c FROM s{turn} GROUP BY cluster),
c{turn + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(u{turn}.c, c{turn}.c) AS c FROM c{turn} LEFT JOIN u{turn} USING (cluster)
)""")
    return f"""WITH {",".join(steps)},
sums AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, cluster_inertia,
       (SELECT CAST(sum(cluster_inertia) AS BIGINT) FROM sums) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN sums USING (cluster) JOIN c{rounds} USING (cluster)"""
