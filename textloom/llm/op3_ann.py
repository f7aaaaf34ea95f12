"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Distinct vectors are dealt to shards by their hash: of ``SHARD_ROWS`` where there are many, smaller ones
(down to ``LEAST_ROWS``) as long as cores would be idle. In each shard a graph is built in rounds: greedy
searches from a central node propose neighbours for a batch of nodes, robust pruning keeps those that
no kept neighbour covers (distance times ``ALPHA``), and reverse edges are added and pruned alike.
Largest inner product becomes smallest distance by one more coordinate that gives all vectors of a
shard the same length. Graphs are rows of a written table.

Queries go to the shards: each graph moves once, is followed by the queries for its shard, and answers
them in blocks by a beam search for all queries of a block in step. A task holds one graph and
one block, however many queries there are. Scores are computed again in double precision on the
original vectors; a window per query keeps the best.

Equal vectors are one node with its ``k + 1`` smallest ids (a top-k needs no more of them), so
copies cannot crowd a graph. Vectors of different lengths do not meet.

Defined results: null, empty, zero or non-finite vectors and null ids take no part; a repeated id with
the same vector counts once; a query never returns its own id; with fewer than ``k`` candidates all
are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.vectors import as_doubles, usable
from textloom.session import materialize

SHARD_ROWS, LEAST_ROWS, BLOCK_ROWS = 16_384, 4096, 512
PARTS_PER_SHARD, MOST_PARTS = 4, 20_000  # few shards meet in a partition
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, BATCH = 24, 48, 160, 1.2, 256
INDEX = "dim int, shard int, entry int, vectors binary, graph binary, ids array<array<bigint>>"


def beam_search(
    vectors: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nodes of largest inner product that a greedy walk finds, best
    first (-1 where there are fewer), and the nodes it walked through."""
    count, n = len(queries), len(vectors)
    rows = np.arange(count)
    ids = np.full((count, beam), -1, np.int64)
    score = np.full((count, beam), -np.inf, np.float32)
    done = np.ones((count, beam), bool)
    ids[:, 0], score[:, 0], done[:, 0] = entry, queries @ vectors[entry], False
    seen = np.zeros((count, n + 1), bool)  # the last column takes the padding
    seen[:, entry] = seen[:, n] = True
    walked = []
    while True:
        open_score = np.where(done, -np.inf, score)
        at = open_score.argmax(1)
        live = open_score[rows, at] > -np.inf
        if not live.any():
            break
        node = np.where(live, ids[rows, at], -1)
        done[rows, at] = True
        walked.append(node)
        near = np.where(live[:, None], graph[node], -1)
        fresh = ~seen[rows[:, None], near]
        near = np.where(fresh, near, -1)
        seen[rows[:, None], near] = True
        value = np.einsum("qd,qrd->qr", queries, vectors[near])
        value = np.where(near >= 0, value, -np.inf).astype(np.float32)
        all_ids = np.hstack([ids, near])
        all_score = np.hstack([score, value])
        all_done = np.hstack([done, near < 0])
        best = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
        ids = np.take_along_axis(all_ids, best, 1)
        score = np.take_along_axis(all_score, best, 1)
        done = np.take_along_axis(all_done, best, 1)
    return ids, np.stack(walked, axis=1)


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Up to ``DEGREE`` diverse neighbours for each node out of its candidates (-1 is padding)."""
    candidates = np.sort(candidates, axis=1)
    twice = np.zeros(candidates.shape, bool)
    twice[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    dead = twice | (candidates < 0) | (candidates == nodes[:, None])
    own, other = vectors[nodes], vectors[candidates]
    squares = np.einsum("bcd,bcd->bc", other, other)
    gap = squares - 2 * np.einsum("bd,bcd->bc", own, other) + np.einsum("bd,bd->b", own, own)[:, None]
    pair = squares[:, :, None] + squares[:, None, :] - 2 * other @ other.transpose(0, 2, 1)
    gap = np.where(dead, np.inf, gap)
    out = np.full((len(nodes), DEGREE), -1, np.int64)
    rows = np.arange(len(nodes))
    for turn in range(DEGREE):
        at = gap.argmin(1)
        live = gap[rows, at] < np.inf
        if not live.any():
            break
        out[live, turn] = candidates[rows, at][live]
        covered = ALPHA**2 * pair[rows, at] <= gap
        covered[rows, at] = True
        gap = np.where(covered & live[:, None], np.inf, gap)
    return out


def build_graph(plain: np.ndarray, seed: int = 11) -> tuple[np.ndarray, int]:
    """Neighbours of each node, and the node where searches begin."""
    n = len(plain)
    norms = np.einsum("nd,nd->n", plain, plain)
    lift = np.sqrt(np.maximum(norms.max() - norms, 0))
    vectors = np.hstack([plain, lift[:, None]]).astype(np.float32)
    draw = np.random.default_rng(seed)
    centre = vectors.mean(0)
    entry = int(((vectors - centre) ** 2).sum(1).argmin())
    graph = np.full((n, DEGREE), -1, np.int64)
    if n > 1:
        graph[:] = draw.integers(0, n, graph.shape)
        graph[graph == np.arange(n)[:, None]] = -1
    beam = min(BUILD_BEAM, n)
    for _ in range(2 if n > 1 else 0):
        for nodes in np.array_split(draw.permutation(n), -(-n // BATCH)):
            # All vectors are equally long, so inner products order by distance.
            found, walked = beam_search(vectors, graph, entry, vectors[nodes], beam)
            graph[nodes] = robust_prune(vectors, nodes, np.hstack([found, walked, graph[nodes]]))
            ends, starts = graph[nodes].ravel(), np.repeat(nodes, DEGREE)
            ends, starts = ends[ends >= 0], starts[graph[nodes].ravel() >= 0]
            order = np.argsort(ends, kind="stable")
            ends, starts = ends[order], starts[order]
            targets, first, sizes = np.unique(ends, return_index=True, return_counts=True)
            for lo in range(0, len(targets), BATCH):
                some = slice(lo, lo + BATCH)
                width = sizes[some].max()
                extra = np.full((len(targets[some]), width), -1, np.int64)
                for row, (f, s) in enumerate(zip(first[some], sizes[some])):
                    extra[row, :s] = starts[f : f + s]
                for cut in range(0, width, 64):  # a popular node takes its newcomers in lots
                    both = np.hstack([graph[targets[some]], extra[:, cut : cut + 64]])
                    graph[targets[some]] = robust_prune(vectors, targets[some], both)
    return graph, entry


def _build(table: pa.Table) -> pa.Table:
    dim = table.column("dim")[0].as_py()
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vectors = flat.reshape(-1, dim)
    scale = np.abs(vectors).max()
    graph, entry = build_graph(vectors / scale)
    return pa.table(
        {
            "dim": table.column("dim")[:1],
            "shard": table.column("shard")[:1],
            "entry": pa.array([entry], pa.int32()),
            "vectors": pa.array([vectors.astype("<f8").tobytes()], pa.binary()),
            "graph": pa.array([graph.astype("<i4").tobytes()], pa.binary()),
            "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
        }
    )


def _search(k: int, beam: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answers queries by the graph that came last before them."""

    def answers(shard: dict, query_ids: list[int], asked: np.ndarray) -> pa.RecordBatch:
        vectors = shard["vectors"]
        scale = np.abs(asked).max(1, keepdims=True)
        found, _ = beam_search(
            shard["scaled"], shard["graph"], shard["entry"], (asked / scale).astype(np.float32),
            min(max(beam, k + 1), len(vectors)),
        )
        out: list[tuple] = []
        for query, own, nodes in zip(query_ids, asked, found):
            nodes = nodes[nodes >= 0]
            score = (vectors[nodes] * own).sum(1)
            hits = [
                (-s, i) for s, node in zip(score.tolist(), nodes) for i in shard["ids"][node] if i != query
            ]
            out += [(query, i, -s) for s, i in sorted(hits)[:k]]
        return pa.RecordBatch.from_pydict(
            {
                "query_id": pa.array([o[0] for o in out], pa.int64()),
                "vec_id": pa.array([o[1] for o in out], pa.int64()),
                "score": pa.array([o[2] for o in out], pa.float64()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict = {}
        for batch in batches:
            graphs = np.flatnonzero(batch.column("id").is_null().to_numpy(zero_copy_only=False))
            cuts = np.unique(np.r_[0, graphs, graphs + 1, batch.num_rows])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(lo, hi - lo)
                if lo in graphs:
                    row = part.to_pylist()[0]
                    vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
                    graph = np.frombuffer(row["graph"], "<i4").reshape(len(vectors), -1)
                    shard = {
                        "vectors": vectors,
                        "scaled": (vectors / np.abs(vectors).max()).astype(np.float32),
                        "graph": graph.astype(np.int64),
                        "entry": row["entry"],
                        "ids": row["ids"],
                    }
                    continue
                for at in range(0, hi - lo, BLOCK_ROWS):
                    block = part.slice(at, BLOCK_ROWS)
                    asked = block.column("vector").flatten().to_numpy(zero_copy_only=False)
                    yield answers(
                        shard, block.column("id").to_pylist(), asked.reshape(block.num_rows, -1)
                    )

    return run


def build_index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard, from usable ``id, dim, vector`` rows."""
    window = Window.partitionBy("dim", "vector").orderBy("id")
    firsts = rows.withColumn("nth", F.row_number().over(window)).filter(F.col("nth") <= k + 1)
    nodes = firsts.groupBy("dim", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = materialize(nodes, "nodes")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    spread = F.least(F.lit(cores), F.ceil(F.count("*") / LEAST_ROWS))
    shards = F.greatest(F.ceil(F.count("*") / shard_rows), spread).cast("int")
    sizes = nodes.groupBy("dim").agg(shards.alias("shards"))
    dealt = nodes.join(sizes, "dim").withColumn(
        "shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int")
    )
    # A number of its own keeps Spark from putting small shards into one task.
    total = sizes.agg(F.sum("shards")).first()[0] or 1
    dealt = dealt.select("dim", "shard", "vector", "ids").repartition(_parts(total), "dim", "shard")
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(_build, INDEX), "index")


def _parts(shards: int) -> int:
    return max(1, min(PARTS_PER_SHARD * shards, MOST_PARTS))


def search(
    vectors: DataFrame,
    asked: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    beam: int = SEARCH_BEAM,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: rows for which ``asked`` holds, against all rows."""
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), as_doubles(F.col(vector_col)).alias("vector"),
        F.coalesce(asked, F.lit(False)).alias("asked"),
    )
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = rows.withColumn("dim", F.size("vector")).distinct()
    index = build_index(rows.select("id", "dim", "vector"), k)
    queries = rows.filter("asked").select("id", "dim", "vector")
    sent = queries.join(index.select("dim", "shard"), "dim")
    met = sent.unionByName(index, allowMissingColumns=True)
    met = met.repartition(_parts(index.count()), "dim", "shard")
    met = met.sortWithinPartitions("dim", "shard", F.col("id").isNotNull())
    hits = met.mapInArrow(_search(k, beam), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
