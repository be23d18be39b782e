"""Retrieval for tables of queries: frontiers, ranks and caps keyed by query, in one plan for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..sources.scratch import cut
from . import graph, retrieve

#: Queries that meet all vectors at once; more of them come in blocks.
BLOCK = 10_000


def _blocks(queries: DataFrame) -> list[DataFrame]:
    n = max(1, -(-queries.count() // BLOCK))
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)]


def nearest(queries: DataFrame, vectors: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """queries (qid, query), vectors (id, vector) -> (qid, id, distance, rank): the k nearest of each query, ties by id.
    Queries without a vector find nothing; digits as for retrieve.nearest(). Blocks of queries go to the tasks; what is shuffled is k rows for each query
    and partition."""
    rows = vectors.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
    w = Window.partitionBy("qid").orderBy("distance", "id")
    out = None
    for some in _blocks(queries.where("query is not null")):
        met = rows.crossJoin(F.broadcast(some.select("qid", F.col("query").cast("array<double>").alias("query"))))  # of BLOCK rows or so
        met = met.select("qid", "id", retrieve.rounded(text.squared_l2(F.col("vector"), F.col("query")), digits).alias("distance"))
        best = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = best if out is None else out.union(best)
    return out


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 1, types: list[str] | None = None) -> DataFrame:
    """seeds (qid, id) -> (qid, id, hop): graph.expand() for each query, all frontiers in one join a hop."""
    around = graph.both_ways(edges, types)
    start = cut(seeds.select("qid", "id").distinct().join(nodes.select("id"), "id", "left_semi").select("qid", "id"))
    visited = frontier = start.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        new = frontier.select("qid", F.col("id").alias("src")).join(around, "src").select("qid", F.col("dst").alias("id")).distinct()
        frontier = cut(new.join(visited, ["qid", "id"], "left_anti").select("qid", "id", F.lit(hop).alias("hop")))
        visited = visited.union(frontier)
    return visited.where("hop > 0")


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Ranks from 1 within each qid, of tables of any size: numbered over all, less what comes before the query."""
    every = graph.ranked_all(rows, "qid", *order, name="_all")
    first = every.groupBy("qid").agg(F.min("_all").alias("_first"))
    return every.join(first, "qid").withColumn("rank", F.col("_all") - F.col("_first") + 1).drop("_all", "_first")


def dual(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 8, hops: int = 2, vector_weight: float = 1.0, graph_weight: float = 0.5, per_doc: int | None = 2, digits: int | None = None
) -> DataFrame:
    """retrieve.dual() for each of queries (qid, query): (qid, id, doc_id, score, from_graph). The number of Spark jobs
    doesn't depend on the number of queries."""
    hits = cut(nearest(queries, vectors, k, digits))
    reached = expand(nodes, edges, hits, hops, retrieve.FOLLOWED).join(chunks.select("id"), "id", "left_semi")
    best = ranked(reached.select("qid", "id", "hop"), "hop", "id")
    weigh = lambda df, w: df.select("qid", "id", (F.lit(float(w)) / (F.lit(60) + F.col("rank"))).alias("s"))
    fused = weigh(hits, vector_weight).union(weigh(best, graph_weight)).groupBy("qid", "id").agg(F.sum("s").alias("score"))
    named = fused.withColumn("doc_id", ids.doc_of_chunk(F.col("id")))
    by_score = [F.desc("score"), F.asc("id")]
    if per_doc is not None:
        w = Window.partitionBy("qid", "doc_id").orderBy(*by_score)
        named = named.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_doc).drop("_n")
    top = named.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(*by_score))).where(F.col("_n") <= k).drop("_n")
    out = top.join(hits.select("qid", "id", F.lit(False).alias("h")), ["qid", "id"], "left")
    return out.select("qid", "id", "doc_id", "score", F.coalesce("h", F.lit(True)).alias("from_graph"))


def expand_events(links: DataFrame, seeds: DataFrame, max_hops: int = 2) -> DataFrame:
    """seeds (qid, id) -> (qid, id, hop): retrieve.expand_events() for each query."""
    visited = frontier = cut(seeds.select("qid", "id").distinct().withColumn("hop", F.lit(0)))
    used = None
    for hop in range(1, max_hops + 1):
        shared = frontier.select("qid", F.col("id").alias("event_id")).join(links, "event_id").select("qid", "entity_id").distinct()
        shared = cut(shared if used is None else shared.join(used, ["qid", "entity_id"], "left_anti"))
        used = shared if used is None else used.union(shared)
        new = shared.join(links, "entity_id").select("qid", F.col("event_id").alias("id")).distinct()
        frontier = cut(new.join(visited, ["qid", "id"], "left_anti").select("qid", "id", F.lit(hop).alias("hop")))
        visited = visited.union(frontier)
    return visited
