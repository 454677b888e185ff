"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.session import settle


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b``): the smallest node that it is connected with.

    Each round hangs the larger neighbours of every node on its smallest neighbour, then the smaller ones, until the
    links are stars, each around its smallest node. Groups are only reduced to minima, so a hub is no obstacle. Links are
    kept in one direction, from the larger node ``a``; a round that would change nothing is not run.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = settle(edges.distinct())
    while True:
        nodes = settle(_nodes(edges))
        if not nodes.where("smaller > 1 or smaller = 1 and is_root").count():
            return nodes.select("node", "root")
        edges = settle(_round(edges))


def _nodes(edges: DataFrame) -> DataFrame:
    """``node, root, smaller, is_root``: the smaller neighbours of a node are counted, and it is a root if larger ones hang on it.

    Links are stars if no node has several smaller neighbours, or one and larger ones, too.
    """
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("root"), F.lit(1).alias("one")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root"), F.lit(0).alias("one"))
    )
    return ends.groupBy("node").agg(
        F.min("root").alias("root"), F.sum("one").alias("smaller"), (F.min("one") == 0).alias("is_root")
    )


def _round(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b")
    large = edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    hung = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.select("a", F.col("m").alias("b")).unionByName(hung).distinct()
