"""Connected components of a graph given as links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayworks.session import settle_table


def _mark(links: DataFrame) -> tuple:
    """Size and order-free checksum of a link table: three numbers, whatever its size."""
    h = F.xxhash64("a", "b")
    row = links.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.unionByName(least.select("a", F.col("root").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node it can reach.

    ``links`` has two columns ``a`` and ``b`` of one comparable type; loops and repeats are
    allowed. Each round is two grouped minima and two equi-joins, so a node with very many
    links is pre-aggregated and its join side can be split; rounds grow with the logarithm
    of the longest path. Every round is stored in the shared folder.
    """
    now = settle_table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, mark = None, _mark(now)
    while mark != before and mark[0]:
        now = settle_table(_small_star(_large_star(now)))
        before, mark = mark, _mark(now)
    hung = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return hung.unionByName(hung.select(F.col("root").alias("node"), "root").distinct())
