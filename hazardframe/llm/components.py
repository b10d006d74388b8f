"""Connected components by alternating star operations on written edge tables.

Each round hangs every node's larger neighbours on its least one (large star),
then does the same among the smaller ones (small star); the edges converge to
stars around each component's least node. Rounds grow with the logarithm of the
longest path. Nodes that many edges meet are only ever the key of a skewed join,
which AQE splits, or of a minimum, which is combined before the shuffle. Each
round's edges are written to the shared folder, so a lost executor costs a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _checked(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).head()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge to another; component is the least node reachable.

    `edges`: two long columns; nulls and loops are ignored, duplicates and directions do not matter.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = scratch.table(edges, "edges-0")
    before = _checked(edges)
    for k in range(1, rounds + 1):
        if not before[0]:
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, f"large-{k}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.table(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"edges-{k}")
        scratch.drop(f"edges-{k - 1}")
        scratch.drop(f"large-{k}")
        now = _checked(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
