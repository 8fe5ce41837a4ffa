"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.sources.durable import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node reachable.

    Each round links every larger neighbour, then every smaller one, to the smallest neighbour, until no edge
    changes; rounds grow with the logarithm of a component's size. Edges may repeat, loops are ignored, and an
    empty table gives none. Each round is checkpointed, so a lost executor costs no more than a round.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _print(now)
    while state[0]:
        both = now.unionAll(now.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Every edge now points down; the smaller neighbours of a node meet at the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut_lineage(small.where("a <> b").distinct())
        new = _print(now)
        if new == state:
            break
        state = new
    return now.selectExpr("a as node", "b as root").unionAll(now.selectExpr("b as node", "b as root").distinct())


def _print(edges: DataFrame) -> tuple:
    """Rows and a checksum: equal for equal edge sets."""
    x = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(x, 20)), F.bit_xor(x)).first())
