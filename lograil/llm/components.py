"""Connected components: a local union-find, and a distributed one by star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import task
from .storage import cut


class UnionFind:
    """Union-find over any hashable names; the root of a set is its least member."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = parent.setdefault(x, x)
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


def _contract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of the components that one partition's edges form."""
    sets = UnionFind()
    for batch in it:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.union(a, b)
    pairs = [(x, root) for x in list(sets.parent) if (root := sets.find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: 64 bit integers); root is the component's least node.

    Each partition first contracts its edges to stars by union-find, then rounds
    of large-star and small-star (Kiveris et al., SoCC 2014) over shuffles join
    the stars, until a round changes nothing.  Loops and repeated edges do no
    harm, rows with a null end are dropped, no edges give no rows.  Roots have a
    row too.  A round holds one row a node, however large a component is.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    stars = cut(edges.mapInArrow(task(_contract), "a long, b long").where("a <> b"))
    before = None
    for _ in range(max_rounds):
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first())
        if now[0] == now[2] or now == before:  # every node has one edge, and its end has none: checked below
            roots = stars.select(F.col("b").alias("a")).join(stars, "a", "left_semi")
            if now == before or roots.isEmpty():
                break
        before = now
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        # a star for each node: its neighbours and itself all go to the least one
        stars = cut(small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
