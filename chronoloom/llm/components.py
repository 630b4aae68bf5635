"""Connected components of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut


def _least(edges: DataFrame) -> DataFrame:
    """For each node ``a`` the least of itself and its neighbours ``b``, beside every edge.

    Minima are combined before the shuffle, so a node of very high degree is no hot group; the
    join of the edges is split by adaptive execution where a node has very many.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("least"))
    return edges.join(least, "a")


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and checksum, observed while they are written."""
    seen = Observation()
    told = edges.observe(seen, F.count(F.lit(1)).alias("n"),
                         F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    return cut(told), tuple(seen.get[k] for k in ("n", "h"))


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for every node of ``links`` (a, b).

    Large stars (neighbours larger than a node hang on its least neighbour) and small stars (a
    node and its lesser neighbours hang on the least of them) take turns, each round on a
    written table, until the links no longer change; then every link goes from a node to its
    label.  Chains fold in every round, so rounds grow with the logarithm of their length.
    """
    edges, now = _written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias(
        "b")).where("a > b").distinct())
    while now[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both).where("b > a").select(F.col("b").alias("a"),
                                                   F.col("least").alias("b"))
        hung = _least(large)
        # Each node goes to the least one below it, and so do the others below it.
        small = hung.select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("least").alias("b")),
            F.struct(F.col("a"), F.col("least").alias("b")))).alias("e")).select("e.*").where(
            "a > b").distinct()
        edges, then = _written(small)
        if then == now:
            break
        now = then
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
