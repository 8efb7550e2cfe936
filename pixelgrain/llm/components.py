"""Connected components by union-find in partitions and min-label stars across them; no link ever reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import discard, materialize


class UnionFind:
    """Disjoint sets whose root is their smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            a, b = min(a, b), max(a, b)
            self.parent[b] = a
            self.parent.setdefault(a, a)


_FLUSH = 1 << 18


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition as stars around local roots; the forest is handed on and begun anew when it gets large."""

    def stars(sets: UnionFind) -> pa.RecordBatch:
        pairs = [(x, sets.find(x)) for x in list(sets.parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[1] for p in pairs], pa.int64()), pa.array([p[0] for p in pairs], pa.int64())], ["u", "v"])

    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
        if len(sets.parent) > _FLUSH:
            yield stars(sets)
            sets = UnionFind()
    yield stars(sets)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node with a link to another one; component is the smallest node that it reaches.

    Links are (long, long) in any order, repeats and loops allowed; nulls are ignored. Union-find turns each
    partition's links into stars. Then each round joins every node to the smallest node known near it, first for larger
    neighbours (large star), then for smaller ones (small star), until no link changes; the number of rounds grows
    with the logarithm of the longest chain. A hub's rows are split by adaptive skew joins and its minimum is
    aggregated before the shuffle.
    """
    spark_links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = materialize(spark_links.mapInArrow(_forest, "u long, v long").groupBy("u", "v").agg(F.lit(1).alias("_n")).select("u", "v"), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
        before = state
        new = materialize(_small_star(_large_star(edges)), "edges")
        discard(edges)
        edges = new


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    low = near.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("x"), F.least("u", "low").alias("low"))
    return near.join(low, F.col("u") == F.col("x")).where("v > u").select(F.col("low").alias("u"), "v").groupBy("u", "v").agg(F.lit(1).alias("_n")).select("u", "v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges are (smaller u, larger v): v and its smaller neighbours all go to the smallest of them."""
    low = edges.groupBy("v").agg(F.min("u").alias("low")).select(F.col("v").alias("x"), "low")
    moved = edges.join(low, F.col("v") == F.col("x"))
    out = moved.select(F.col("low").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v")
    return out.groupBy("u", "v").agg(F.lit(1).alias("_n")).select("u", "v")
