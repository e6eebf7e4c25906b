"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import kept, release


def _stars(e: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ups = e.groupBy("u").agg(F.count("*").alias("n"))
    below = e.select("v").distinct().join(ups.select(F.col("u").alias("v")), "v", "left_semi")
    return ups.where("n > 1").select("u").union(below).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of edges (u, v: long), the smallest node that it is linked to, itself included.

    Null ends and loops are left out; a node with nothing but a loop is no node here. An empty table gives an empty
    table. Each round is written to the shared folder, until all links are stars; the number of rounds is logarithmic in
    the length of the longest path. A hub's links are spread by the skew handling of the joins.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = kept(e, "edges")
    most = e.count()  # no round makes more of them
    while not _stars(e):
        before = e
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # links to greater nodes go to the smallest one near; the node itself keeps a link to it
        large = large.union(low.where("m < u")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).where("u <> v")
        e = kept(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", most)
        release(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
