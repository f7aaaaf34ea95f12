"""Pieces that several operators share: tables, words, folds, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import materialize

# Fixed value: a word is a run of anything but the six ASCII white-space characters. On UTF-8 bytes
# this is what ``bytes.split()`` does.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whatever file system it lies in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """Fold of a document; a null id falls into fold 0."""
    digest = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(F.pmod(digest, F.lit(folds)), F.lit(0)).cast("int")


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, with A-Z (and nothing else) in lower case."""
    return [] if not text else text.encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """64-bit hash of a word; remembers words up to a bound, then starts afresh."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, as the only element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def slices(rows: list, weight, most: int) -> Iterator[tuple[int, int]]:
    """Cuts a list into runs whose summed weight is about ``most`` (one heavy row stands alone)."""
    start, held = 0, 0
    for at, row in enumerate(rows):
        here = weight(row)
        if at > start and held + here > most:
            yield start, at
            start, held = at, 0
        held += here
    if start < len(rows):
        yield start, len(rows)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a``, ``b``): root is the smallest node
    that can be reached, the node itself included.

    Each round, every node points at its smallest neighbour, pointers are followed to their end, and
    the edges between different ends are all that the next round sees; a star is done in two rounds.
    The driver sees only whether edges are left. Null ends are ignored; no edges give no rows.
    """
    left = materialize(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a < b")
        .distinct(),
        name,
    )
    found = None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        root = materialize(root.select("node", F.least("node", "root").alias("root")), name)
        while True:
            ends = root.select(F.col("node").alias("root"), F.col("root").alias("end"))
            jumped = materialize(root.join(ends, "root").select("node", "root", "end"), name)
            root = jumped.select("node", F.col("end").alias("root"))
            if jumped.filter(F.col("end") < F.col("root")).isEmpty():
                break
        ends_a = root.select(F.col("node").alias("a"), F.col("root").alias("end_a"))
        ends_b = root.select(F.col("node").alias("b"), F.col("root").alias("end_b"))
        left = materialize(
            left.join(ends_a, "a")
            .join(ends_b, "b")
            .select(F.least("end_a", "end_b").alias("a"), F.greatest("end_a", "end_b").alias("b"))
            .filter("a < b")
            .distinct(),
            name,
        )
        if found is None:
            found = root
        else:
            later = root.select(F.col("node").alias("root"), F.col("root").alias("end"))
            found = found.join(later, "root", "left").select(
                "node", F.coalesce("end", "root").alias("root")
            )
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return materialize(found, name)
