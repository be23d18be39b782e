"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hub_bound, hub_join, written


def _large(links: DataFrame, bound: int) -> DataFrame:
    """Each node points its larger neighbours at the least node it knows."""
    sides = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = sides.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("count"))
    least = known.select("a", F.least("a", "m").alias("m"))
    told = hub_join(sides.where("b > a"), least, "a", "b", known.select("a", "count"), bound)
    return told.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(links: DataFrame, bound: int) -> DataFrame:
    """Each node points its smaller neighbours and itself at the least of them; without repetition."""
    sides = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    known = sides.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("count"))
    least = known.select("a", "m")
    told = hub_join(sides, least, "a", "b", known.select("a", "count"), bound)
    out = told.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether each node has one link, to a node that has none."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(links.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not seen.agg(F.coalesce(F.max(F.expr("out > 1 or (out > 0 and into > 0)")), F.lit(False))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """links(a, b), undirected, long ids -> (node, component): the least id reachable.

    Nodes without links don't appear; loops and repeated links do no harm; an empty table gives an empty one.
    Each round shuffles the links only and is written to the shared folder (and the round before it deleted). The
    minimum of a node's neighbours is pre-aggregated, and a hub's links are dealt into blocks to get it, so that no task
    holds them all.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(now):
        bound = hub_bound(2 * now.count())
        turned = written(_large(now, bound))
        before, now = now, written(_small(turned, bound))
        discard(turned)
        discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
