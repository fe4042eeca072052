"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.blocks import cut_lineage
from gleaner.session import ship

#: So many edges at most are finished in one task: 16 bytes each.
FEW = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b: long) can reach.

    Large-star joins every larger neighbour of a node to its smallest neighbour; small-star does so
    for the smaller ones.  Alternating them ends in stars round the smallest node, in a number of
    rounds that grows with the logarithm of a component's size.  A round is aggregations and joins
    on the node; nothing of a component's size meets in one task.  Every round is checkpointed.
    Edges are counted each round; no more than ``FEW`` are finished by one task instead, with the
    same result.
    """
    ship(edges.sparkSession)
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
        if state[0] <= FEW:
            return cut_lineage(edges.coalesce(1).mapInArrow(_finished, "node long, root long"))
        before = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Every edge now points to a smaller node; small-star needs only these.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        edges = cut_lineage(small)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_pydict({"node": pa.array(list(root), pa.int64()), "root": pa.array([find(x) for x in root], pa.int64())})
