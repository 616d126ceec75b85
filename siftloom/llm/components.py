"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node of its component.

    edges has long columns a and b. Large-star and small-star steps by turns: each links a
    node's neighbours to the smallest of them, so the number of edges never grows and a
    path of n nodes takes in the order of log2(n)^2 steps. Every round ends in a
    reliable checkpoint; the rounds end when one changes nothing.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        now = cut(small_star(large_star(now)))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = mark


def large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("centre"), F.least("a", "m").alias("m"))
    larger = both.filter("b > a").join(low, F.col("a") == F.col("centre"))
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("centre"), "m")
    linked = down.join(low, F.col("a") == F.col("centre")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(low.select(F.col("centre").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
