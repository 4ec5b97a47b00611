"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

#: Edges that a partition of the written graph holds, about, and the size up to which one task finds the components.
EDGES, SMALL = 100_000, 1_000_000
SCHEMA = pa.schema([("id", pa.int64()), ("component", pa.int64())])


def packed(edges: DataFrame, count: int) -> DataFrame:
    return edges.coalesce(max(1, -(-count // EDGES)))


def joined_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all edges (u, v) of one task, by union of the sets of their ends under the smallest id."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            low, high = sorted((root(u), root(v)))
            parent[high] = low
    nodes = list(parent)
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_pydict({"id": part, "component": [root(x) for x in part]}, schema=SCHEMA)


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, component) of every node of links(a long, b long): the smallest id that it reaches.

    A graph of at most `small` edges is joined in one task, whose memory that number bounds. In a larger one, large-star and small-star steps alternate until nothing changes; each step is a minimum by node (summed before the
    shuffle) and an equi-join, and its edges are written to the shared folder.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen, count = None, edges.count()
    if count <= small:
        return cut(edges.coalesce(1).mapInArrow(joined_sets, "id bigint, component bigint"))
    while True:
        edges = packed(edges, count)
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(near.union(low.select("u", "m")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == seen:
            break
        seen, count = now, now[0]
        release(links.sparkSession)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
