"""Connected components of an edge table, by alternating large and small stars.

Each half-step lets every node point its neighbours to the smallest one; it is a minimum by key (with partial minima, so
a node with very many neighbours is no hot group) and a join of two written tables (which Spark can split where a
key is hot). The number of rounds grows with the square of the logarithm of the longest path, not with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written

EDGES = "a long, b long"


def forest(pairs) -> list[tuple[int, int]]:
    """The same components with one edge for each node but the smallest of its component: (smallest, node)."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := top.get(root, root)) != root:
            root = up
        while (up := top.get(x, x)) != root:
            top[x] = root
            x = up
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            top[max(a, b)] = min(a, b)
    return [(find(x), x) for x in list(top)]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition as stars; a partition's memory is a few MB of edges."""
    for batch in batches:
        stars = forest(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in stars], pa.int64()), pa.array([s[1] for s in stars], pa.int64())], ["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every node of ``edges`` (``a``, ``b``: long).

    Loops and repeated edges are harmless; edges with a null end are ignored; no edges give no rows. A graph that has not
    settled after ``most_rounds`` rounds, which takes a path of about 2^most_rounds nodes, raises RuntimeError.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = written(pairs.mapInArrow(_contract, EDGES).distinct(), "edges")
    for turn in range(most_rounds + 1):
        # Settled: every node points to one that points nowhere, and to no other.
        many = now.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b")
        if many.isEmpty() and now.join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
        if turn == most_rounds:
            raise RuntimeError(f"components have not settled after {most_rounds} rounds")
        before = now
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "star-min")
        large = written(both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct(), "star")
        lower = written(large.groupBy("b").agg(F.min("a").alias("m")), "star-min")
        pointed = large.join(lower, "b").select(F.col("m"), F.col("a"), F.col("b"))
        now = written(pointed.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct(), "edges")
        for old in (before, least, large, lower):
            drop_written(old)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
