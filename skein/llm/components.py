"""Connected components by alternating large-star and small-star rounds over an edge table.

The least neighbours are written before they are joined: Spark then knows their size, broadcasts them while they are small, and
splits the links of a hub over tasks where they aren't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.storage import materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)`` that isn't its component's smallest node.

    Nodes are of any ordered type. Self-links, repeated and reversed links are allowed; an empty table gives an empty result.
    Each round is written to the shared folder, so lineage stays short; the count of rounds grows with the logarithm of the
    longest chain, and no vertex's links are gathered in one place.
    """
    edges = materialize(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    for _ in range(most_rounds):
        edges = materialize(_small(_large(edges)), "stars")
        r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(r) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(r)
    raise RuntimeError("components did not settle")
