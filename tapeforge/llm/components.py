"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeforge.session import cut_lineage


def _star(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with u > v after one large-star and one small-star step."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = cut_lineage(large)
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut_lineage(hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable from it.

    ``a`` and ``b`` are the columns of ``links`` that hold the two ends (any ordered
    type). Links may repeat, run either way, or join a node with itself; null ends are
    no link. Each round is written to the shared folder, so a lost executor costs a
    round at most; the number of rounds grows with the logarithm of the longest path.
    The hubs of large components meet only in joins, which Spark splits when skewed.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct()
    edges, before = cut_lineage(edges), None
    while True:
        # Two 64-bit sums over all edges (by exclusive or): two rounds that differ don't look alike.
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(7), "v", "u"))).first()
        if now == before or now[0] == 0:
            break
        before, edges = now, _star(edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
