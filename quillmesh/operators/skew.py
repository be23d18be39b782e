"""Joins of keys that may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hub_bound(rows: int) -> int:
    """From how many rows a key counts as a hub: so that a table of so many rows has 1,000 hubs at most."""
    return max(32, rows // 1000)


def hub_join(many: DataFrame, few: DataFrame, key: str, deal: str, counts: DataFrame, bound: int, how: str = "inner") -> DataFrame:
    """many.join(few, key, how), inner or left, where few holds a key once and counts (key, count) is how often many does.

    The rows of a key with more than bound of them are dealt into blocks of about bound by the hash of the column deal,
    and the key's row of few goes to each block, so that no task holds a hub. The hubs and their numbers of blocks are
    broadcast: they are at most rows of many / bound. A null key matches nothing; its rows are dealt like a hub's."""
    hubs = counts.where((F.col("count") > bound) & F.col(key).isNotNull()).select(key, F.ceil(F.col("count") / bound).cast("int").alias("_blocks"))
    blocks = F.coalesce("_blocks", F.lit(1))
    dealt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(deal), F.lit(1 << 30)).cast("int")).otherwise(F.pmod(F.xxhash64(deal), blocks).cast("int"))
    many = many.join(F.broadcast(hubs), key, "left").withColumn("_block", dealt).drop("_blocks")
    few = few.join(F.broadcast(hubs), key, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")
    return many.join(few, [key, "_block"], how).drop("_block")
