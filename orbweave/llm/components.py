"""Connected components of a graph held as a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import discard, materialise


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root for every node of edges (a, b), longs: root is the smallest node that it is connected to.

    Each round hangs every node's larger neighbours on its smallest neighbour, then every node and its
    smaller neighbours on the smallest of them, until nothing moves. Each step is a minimum by node with partial
    aggregation and a join that adaptive execution may split, so a hub's edges needn't meet in one task;
    the rounds grow with the logarithm of the longest path. Each round is a table in the shared folder, removed once the next is written.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    mark = None
    for _ in range(rounds):
        # large stars
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small stars
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "stars")
        discard(before)
        was, mark = mark, now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if was == mark:
            break
    else:
        raise RuntimeError(f"the components need more than {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Union:
    """Disjoint sets of 0 to n-1; a set's root is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a < b:
            self.up[b] = a
        else:
            self.up[a] = b
