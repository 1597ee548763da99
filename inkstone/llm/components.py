"""Connected components of an edge list, spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def edges(links: DataFrame) -> DataFrame:
    """Links (u, v: long) as stored edges from the larger node to the smaller, each once."""
    return stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _are_stars(e: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or only edges from larger ones."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down = 1 AND up = 1").isEmpty()


def components(e: DataFrame) -> DataFrame:
    """v, root: for every node of edges() the smallest node it is joined with.

    Alternates two steps until all edges lead straight to the smallest node: each node's larger neighbours move to its smallest one,
    then its smaller neighbours do. The number of rounds grows with the logarithm of the longest chain, with none for edges that
    are stars already; each is written to the shared folder. Edges never grow in number, smallest neighbours are found with partial
    aggregation, and the join back has one row for each node on one side, so a hub's rows can be split. Rounds broadcast nothing,
    as each broadcast is made, and kept for a while, in the driver's memory.
    """
    while not _are_stars(e):
        both = _both(e)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # now every edge goes from u to a smaller v
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = down.select("u", F.col("m").alias("v")).unionByName(large.join(down.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        e, old = stored(small), e
        discard(old)
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(e.select("v", F.col("v").alias("root")).distinct())
