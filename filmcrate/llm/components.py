"""Connected components of a table of links, by rounds of joins (no Python, nothing collected)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star operation on distinct links (a < b): every node's neighbours are hung on the least of them.

    Large star moves the neighbours above the node, small star the node and those below it.
    The least neighbour is written before it is joined back, so that Spark can split the join
    at a node with very many links.
    """
    if large:
        both = links.union(links.select("b", "a"))
        low = common.settle(both.groupBy("a").agg(F.min("b").alias("m")), "least")
        hung = both.where("b > a").join(low, "a").select(F.least("a", "m").alias("a"), "b")
    else:
        low = common.settle(links.groupBy("b").agg(F.min("a").alias("m")), "least")
        hung = links.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return common.settle(hung.where("a < b").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node in ``links`` (columns a, b).

    Large and small stars alternate until only stars are left, about log(n) rounds; every round
    is written to the shared scratch place. Self-links, repeated links, either direction and
    rows with a null are allowed; nodes that have only self-links get no row.
    """
    rows = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    rows = common.settle(rows, "links")
    while True:
        # a star's leaves have one link, to its root, which is no leaf
        ends = rows.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("leaf")), F.struct(F.col("b").alias("node"), F.lit(1).alias("leaf")))).alias("e")).select("e.*")
        if not ends.groupBy("node").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("least")).where("n > 1 or n = 1 and least = 0").head(1):
            return rows.select(F.col("b").alias("node"), F.col("a").alias("root")).union(rows.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        rows = _star(_star(rows, True), False)
