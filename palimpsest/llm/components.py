"""Connected components of an edge table, by rounds that only shrink towards stars.

Each round joins every node to the smallest node it sees, first from larger neighbours, then
from smaller ones; the number of rounds grows with the logarithm of the largest component.
Aggregations combine before their shuffle and joins may be split, so a node with very many edges needs no
task of its own. Each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textkit import materialise


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node reachable) of each node in an edge (a, b); nodes must be ordered and not null."""
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state.n or (state.n, state.h) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = (state.n, state.h)
        # Larger neighbours are led to the smallest node seen.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        # Smaller neighbours, and the node itself, are led to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    raise RuntimeError("components did not settle")
