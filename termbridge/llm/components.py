"""Connected components with DataFrame operations: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termbridge.session import cut_lineage

col = F.col


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to its smallest neighbour or itself."""
    both = edges.select("a", "b").union(edges.select(col("b").alias("a"), col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    upward = edges.where("a < b").select("a", "b")  # a node's larger neighbours
    return upward.join(least, "a").select(col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b").select(col("m").alias("x"), col("a").alias("y"))
    own = least.select(col("m").alias("x"), col("b").alias("y"))
    return tied.union(own).where("x < y").select(col("x").alias("a"), col("y").alias("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """Every node of an edge with the smallest node it reaches: (node, component).

    Nodes may be of any ordered type. Edges with a null end and loops say nothing and are left
    out; an empty table of edges gives an empty result. Each round writes the edges to the shared
    folder and shuffles them four times; minima are combined before the shuffle and joins on busy
    nodes can be split by adaptive execution. Rounds grow with the logarithm of the longest path.
    """
    known = edges.where(col(a) != col(b))
    now = cut_lineage(known.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    stars = False
    for _ in range(max_rounds):
        # Done when every node hangs on one other and no such other hangs itself.
        tails = now.groupBy("b").agg(F.count("*").alias("n"))
        unsettled = now.select(col("a").alias("b")).join(tails, "b", "left_semi")
        if not tails.where("n > 1").select("b").union(unsettled).take(1):
            stars = True
            break
        now = cut_lineage(_small_star(_large_star(now)))
    if not stars:
        raise RuntimeError(f"components were not settled after {max_rounds} rounds")
    heads = now.select(col("a").alias("node"), col("a").alias("component")).distinct()
    return heads.union(now.select(col("b").alias("node"), col("a").alias("component")))
