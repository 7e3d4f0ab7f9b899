"""Connected components by alternating star contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlens.llm import exchange as X


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node of the links.

    Each round hangs every node's larger neighbours, then its smaller ones, onto
    its least neighbour; rounds end when nothing changes, their number grows with
    the logarithm of the longest path.  Each round is written and read again; as long
    as the edges fit one partition, a round has no exchange.
    """
    edges = X.gathered(links.where(F.col(a) != F.col(b))
                       .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        # v < u in each edge, so a node's larger neighbours are those it is the v of
        least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = X.gathered(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if same(edges, small):
            return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                small.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        edges = small


def same(x: DataFrame, y: DataFrame) -> bool:
    """Whether two edge sets are equal, by count and order-free checksums."""
    def mark(df: DataFrame):
        h = F.xxhash64("u", "v")
        return tuple(df.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(h))).first())
    return mark(x) == mark(y)
