"""Top-k retrieval: exact vectors, fusion of rankings, caps per source, dual mode, and events with shared entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from . import graph

#: Edges that dual retrieval follows.
FOLLOWED = ["contains", "links_to", "mentions", "relates_to"]


def nearest(vectors: DataFrame, query: Column, k: int, metric: str = "l2", digits: int | None = None) -> DataFrame:
    """vectors (id, vector) -> the k nearest to a literal vector: (id, distance or cosine), ties by id. With digits,
    values are rounded to so many first, so that those that differ by their rounding errors alone are ties. A top-k in
    each partition and one merge; nothing is shuffled but k rows a partition."""
    if metric == "cosine":
        return vectors.select("id", rounded(text.cosine(F.col("vector"), query), digits).alias("cosine")).orderBy(F.desc("cosine"), "id").limit(k)
    return vectors.select("id", rounded(text.squared_l2(F.col("vector"), query), digits).alias("distance")).orderBy("distance", "id").limit(k)


def rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def score(distance: Column) -> Column:
    return 1 / (1 + distance)


def fuse(rankings: list[DataFrame], weights: list[float] | None = None, k: int = 60) -> DataFrame:
    """Rankings (id, rank from 1) -> (id, score): the sum of weight / (k + rank)."""
    weights = weights or [1.0] * len(rankings)
    parts = [r.select("id", (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("s")) for r, w in zip(rankings, weights, strict=True)]
    return reduce(DataFrame.union, parts).groupBy("id").agg(F.sum("s").alias("score"))


def cap(scored: DataFrame, source: str, per_source: int | None, k: int) -> DataFrame:
    """The k best of (id, score, source), at most per_source of a source."""
    if per_source is not None:
        w = Window.partitionBy(source).orderBy(F.desc("score"), "id")
        scored = scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_source).drop("_n")
    return scored.orderBy(F.desc("score"), "id").limit(k)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def vector_table(chunks: DataFrame, dim: int = 16) -> DataFrame:
    return chunks.select("id", "doc_id", text.embed(F.col("text"), dim).alias("vector"))


def dual(
    chunks: DataFrame, vectors: DataFrame, nodes: DataFrame, edges: DataFrame, query: Column, k: int = 8, hops: int = 2, vector_weight: float = 1.0, graph_weight: float = 0.5, per_doc: int | None = 2, digits: int | None = None
) -> DataFrame:
    """Nearest chunks and the chunks within some hops of them, their rankings fused, a cap per document: (id, doc_id,
    score, from_graph). query is a literal vector; null finds nothing. digits as for nearest()."""
    hits = graph.cut(graph.ranked(nearest(vectors.where(query.isNotNull() & F.col("vector").isNotNull()).withColumn("vector", F.col("vector").cast("array<double>")), query, k, digits=digits), "distance", "id"))
    reached = graph.expand(nodes, edges, hits, hops, FOLLOWED).join(chunks.select("id"), "id", "left_semi")
    # Without a cap, no chunk beyond the first k of the graph's ranking can be among the k best.
    best = graph.ranked(reached.orderBy("hop", "id").limit(k), "hop", "id") if per_doc is None else graph.ranked_all(reached, "hop", "id")
    fused = fuse([hits.select("id", "rank"), best.select("id", "rank")], [vector_weight, graph_weight])
    named = fused.withColumn("doc_id", ids.doc_of_chunk(F.col("id")))
    found = cap(named, "doc_id", per_doc, k)
    return found.join(hits.select("id", F.lit(False).alias("h")), "id", "left").select("id", "doc_id", "score", F.coalesce("h", F.lit(True)).alias("from_graph"))


def contexts(found: DataFrame, chunks: DataFrame, preview: int | None = None) -> DataFrame:
    """found (id, score and others; k rows) with each chunk's text, path and heading; blanks where there is no chunk.
    With preview, the text's first characters on one line."""
    body = F.col("text") if preview is None else F.translate(F.substring("text", 1, preview), "\n", " ")
    own = chunks.select("id", body.alias("text"), F.col("path").alias("source_path"), F.col("section_path").alias("heading_path"))
    there = own.join(F.broadcast(found.select("id")), "id", "left_semi")  # k ids
    out = found.join(there, "id", "left")
    return out.select(*found.columns, *(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "source_path", "heading_path")))


def compared(one: DataFrame, other: DataFrame) -> DataFrame:
    """(id, side): what two results have in common, and what only one of them has."""
    j = one.select("id", F.lit(1).alias("a")).join(other.select("id", F.lit(1).alias("b")), "id", "full")
    return j.select("id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "lost").otherwise("both").alias("side"))


def match_entities(entities: DataFrame, tokens: list[str], limit: int = 50) -> DataFrame:
    """Entities (entity_id, name, normal) whose normalised name holds one of the tokens, the first by id."""
    found = reduce(lambda a, b: a | b, [F.col("normal").like(f"%{t}%") for t in tokens], F.lit(False))
    return entities.where(found).select("entity_id", "name").orderBy("entity_id").limit(limit)


def expand_events(links: DataFrame, seeds: DataFrame, max_hops: int = 2) -> DataFrame:
    """seeds (id) -> (id, hop): events that share an entity with those of the hop before. Each hop is cut by a
    checkpoint and joins the frontier only; entities that a hop before has used up aren't joined again."""
    visited = frontier = graph.cut(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    used = None
    for hop in range(1, max_hops + 1):
        shared = frontier.select(F.col("id").alias("event_id")).join(links, "event_id").select("entity_id").distinct()
        shared = graph.cut(shared if used is None else shared.join(used, "entity_id", "left_anti"))
        used = shared if used is None else used.union(shared)
        new = shared.join(links, "entity_id").select(F.col("event_id").alias("id")).distinct()
        frontier = graph.cut(new.join(visited, "id", "left_anti").select("id", F.lit(hop).alias("hop")))
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    return visited


def retrieve_events(events: DataFrame, links: DataFrame, entities: DataFrame, tokens: list[str], k: int = 8, max_hops: int = 2, query: Column | None = None, named: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(id, hop, shared, overlap, score, connected_via), k rows: by cosine, hop and id with a vector, else by shared seed
    entities, words in common with title and keywords, hop and id.

    Seeds are the events of the entities that the tokens (of more than one character) name and, with a vector, the
    max(k, 10) nearest events. connected_via lists an event's seed entities, sorted. The entities that the tokens name
    may be given (by names.match()); else all entities are looked at. digits as for nearest()."""
    tokens = [t for t in tokens if len(t) > 1]
    seed_entities = graph.cut((match_entities(entities, tokens) if named is None else named).select("entity_id"))
    touched = graph.cut(links.join(F.broadcast(seed_entities), "entity_id", "left_semi").select(F.col("event_id").alias("id"), "entity_id").distinct())  # 50 entities at most
    seeds = touched.select("id")
    vector = F.col("embedding").cast("array<double>")
    if query is not None:
        near = nearest(events.where("embedding is not null").withColumn("vector", vector), query, max(k, 10), "cosine", digits)
        seeds = seeds.union(near.select("id"))
    reached = expand_events(links, seeds, max_hops)
    via = touched.groupBy("id").agg(F.count("*").alias("shared"), F.sort_array(F.collect_list("entity_id")).alias("connected_via"))
    said = F.flatten(F.transform(F.concat(F.array("title"), "keywords"), lambda w: F.split(ids.normalize_name(w), " ")))
    overlap = F.size(F.array_intersect(said, F.array(*[F.lit(t) for t in tokens]).cast("array<string>"))).cast("long")
    close = F.coalesce(rounded(text.cosine(vector, query), digits), F.lit(0.0)) if query is not None else F.lit(0.0)
    out = reached.join(events.select("id", overlap.alias("overlap"), close.alias("cosine")), "id").join(via, "id", "left")
    out = out.withColumn("shared", F.coalesce("shared", F.lit(0).cast("long"))).withColumn("connected_via", F.coalesce("connected_via", F.array().cast("array<string>")))
    columns = ["id", "hop", "shared", "overlap", "score", "connected_via"]
    if query is not None:
        return out.withColumn("score", F.col("cosine")).orderBy(F.desc("score"), "hop", "id").limit(k).select(*columns)
    out = out.withColumn("score", (F.col("shared") + F.col("overlap")).cast("double"))
    return out.orderBy(F.desc("shared"), F.desc("overlap"), "hop", "id").limit(k).select(*columns)


def event_contexts(found: DataFrame, events: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """found (id and others; k rows) with title, chunk, content (the chunk's text where it has none), path, heading and
    the entities' ids, sorted."""
    few = F.broadcast(found.select("id"))  # k ids
    own = events.join(few, "id", "left_semi").select("id", "title", "chunk_id", "content")
    place = chunks.select(F.col("id").alias("chunk_id"), "text", "path", "section_path").join(F.broadcast(own.select("chunk_id")), "chunk_id", "left_semi")
    has = links.withColumnRenamed("event_id", "id").join(few, "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("entity_id")).alias("entities"))
    out = found.join(own, "id", "left").join(place, "chunk_id", "left").join(has, "id", "left")
    content = F.when(F.coalesce("content", F.lit("")) == "", F.coalesce("text", F.lit(""))).otherwise(F.col("content"))
    return out.select(*found.columns, "title", "chunk_id", content.alias("content"), F.coalesce("path", F.lit("")).alias("source_path"), F.coalesce("section_path", F.lit("")).alias("heading_path"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


def event_graph(found: DataFrame, events: DataFrame, links: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events found (k rows) and their entities as nodes (id, type, name), and which has which as edges."""
    few = F.broadcast(found.select(F.col("id").alias("event_id")))
    has = graph.cut(links.join(few, "event_id", "left_semi").select("event_id", "entity_id").distinct())
    named = entities.join(has.select("entity_id").distinct(), "entity_id", "left_semi")
    nodes = events.join(found.select("id"), "id", "left_semi").select("id", F.lit("event").alias("type"), F.col("title").alias("name"))
    nodes = nodes.union(named.select("entity_id", F.lit("sag_entity"), "name"))
    return nodes, has.select(F.col("event_id").alias("src"), F.col("entity_id").alias("dst"), F.lit("has_entity").alias("type"))


def first_seen(found: DataFrame, links: DataFrame) -> DataFrame:
    """(entity_id, rank, pos): the entities of ranked events (id, rank), each where it is seen first."""
    seen = links.withColumnRenamed("event_id", "id").join(F.broadcast(found.select("id", "rank")), "id")
    return seen.groupBy("entity_id").agg(F.min(F.struct("rank", "pos")).alias("at")).select("entity_id", "at.rank", "at.pos")


def forget_events(events: DataFrame, links: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and links without those of the chunks (id) listed; entities stay."""
    gone = graph.cut(events.join(chunks.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_semi").select("id"))
    return events.join(gone, "id", "left_anti"), links.join(gone.withColumnRenamed("id", "event_id"), "event_id", "left_anti")
