"""The typed graph as two DataFrames, nodes(id, type, doc_id) and edges(src, dst, type), and what is computed on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..sources.scratch import cut


def mentions(chunks: DataFrame) -> DataFrame:
    """(chunk_id, pos, name, entity_id) of each entity name in each chunk, in order."""
    out = chunks.select(F.col("id").alias("chunk_id"), F.posexplode(text.entity_names(F.col("text"))).alias("pos", "name"))
    return out.withColumn("entity_id", ids.entity_id(F.col("name")))


def relations(chunks: DataFrame) -> DataFrame:
    """(src, dst) of entities that follow each other in a chunk, once each."""
    out = chunks.withColumn("names", text.entity_names(F.col("text"))).where("size(names) > 1")
    out = out.select(F.explode(F.expr("zip_with(slice(names, 1, size(names) - 1), slice(names, 2, size(names) - 1), (a, b) -> struct(a, b))")).alias("p"))
    return out.select(ids.entity_id(F.col("p.a")).alias("src"), ids.entity_id(F.col("p.b")).alias("dst")).distinct()


def entities(found: DataFrame) -> DataFrame:
    """mentions (seq struct, name, type, description, entity_id) -> one row per entity: the first name, others as
    sorted aliases, the first type that says more than "concept", the first description that isn't empty."""
    strong = F.col("type").isNotNull() & ~F.col("type").isin("", "concept")
    g = found.groupBy(F.col("entity_id").alias("id")).agg(
        F.min_by("name", "seq").alias("name"),
        F.collect_set("name").alias("names"),
        F.min_by(F.when(strong, F.col("type")), F.when(strong, F.col("seq"))).alias("strong"),
        F.max(F.col("type") == "concept").alias("weak"),
        F.min_by(F.when(F.col("description") != "", F.col("description")), F.when(F.col("description") != "", F.col("seq"))).alias("description"),
    )
    kind = F.coalesce("strong", F.when(F.col("weak"), "concept").otherwise(""))
    return g.select("id", "name", kind.alias("type"), F.coalesce("description", F.lit("")).alias("description"), F.array_sort(F.array_except("names", F.array("name"))).alias("aliases"))


def both_ways(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    e = edges.where(F.col("type").isin(types)) if types else edges
    return e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 1, types: list[str] | None = None) -> DataFrame:
    """seeds (id) -> (id, hop): nodes within so many hops, edges taken either way, seeds left out; unknown seeds count
    for nothing. Seeds are worked out once; edges should be a stored table, which each hop reads. Each hop joins the
    frontier only, and is stored from the third one on."""
    around = both_ways(edges, types)
    start = cut(seeds.select("id").distinct().join(nodes.select("id"), "id", "left_semi"))
    visited = frontier = start.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        new = frontier.select(F.col("id").alias("src")).join(around, "src").select(F.col("dst").alias("id")).distinct()
        frontier = new.join(visited, "id", "left_anti").select("id", F.lit(hop).alias("hop"))
        if hop > 2:
            frontier = cut(frontier)
            if frontier.isEmpty():
                break
        visited = visited.union(frontier)
    return visited.where("hop > 0")


def subgraph(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes listed and all their neighbours, and every edge among them."""
    core = keep.select("id").distinct().join(nodes.select("id"), "id", "left_semi")
    near = core.select(F.col("id").alias("src")).join(both_ways(edges), "src").select(F.col("dst").alias("id"))
    inside = core.union(near).distinct()
    side = lambda c: inside.select(F.col("id").alias(c))
    return nodes.join(inside, "id", "left_semi"), edges.join(side("src"), "src", "left_semi").join(side("dst"), "dst", "left_semi")


def without_nodes(nodes: DataFrame, edges: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays when nodes (id) go, with every edge at either end."""
    side = lambda c: dead.select(F.col("id").alias(c))
    return nodes.join(dead, "id", "left_anti"), edges.join(side("src"), "src", "left_anti").join(side("dst"), "dst", "left_anti")


def delete_documents(nodes: DataFrame, edges: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletes documents (doc_id) with their sections and chunks."""
    return without_nodes(nodes, edges, nodes.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("id"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that nothing mentions and tags that tag nothing."""
    parts = [nodes.where(F.col("type") == kind).join(edges.where(F.col("type") == by).select(F.col("dst").alias("id")), "id", "left_anti").select("id", "type") for kind, by in (("entity", "mentions"), ("tag", "tagged"))]
    return reduce(DataFrame.union, parts)


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_mentions) of all entities, those without mentions with 0."""
    n = edges.where("type = 'mentions'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return nodes.where("type = 'entity'").select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_mentions"))


def detail(edges: DataFrame, node: str) -> DataFrame:
    """A node's neighbours: (direction, id, edge_type)."""
    out = edges.where(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("id"), F.col("type").alias("edge_type"))
    return out.union(edges.where(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("id"), F.col("type").alias("edge_type")))


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of rows with equal keys, the one of the greatest seq."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def fill_if_empty(rows: DataFrame, key: str, seq: str, keep: list[str], fill: list[str]) -> DataFrame:
    """Of rows with an equal key: the first value of the columns to keep, the first value that isn't empty of those to fill."""
    first = [F.min_by(c, seq).alias(c) for c in keep]
    filled = [F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col(seq))), F.lit("")).alias(c) for c in fill]
    return rows.groupBy(key).agg(*first, *filled)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def route(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Manifests (id, hash) -> (id, action): build (new or changed), unchanged or removed."""
    j = stored.withColumnRenamed("hash", "was").join(found.withColumnRenamed("hash", "is"), "id", "full")
    return j.select("id", F.when(F.col("is").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("is")), "unchanged").otherwise("build").alias("action"))


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Ranks from 1 of a table that a limit bounds (one task numbers it)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def ranked_all(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Ranks from 1 of a table of any size: dealt by ranges, numbered in each, and the numbers of the ranges before
    added. The driver sees a count for each partition."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    dealt = cut(dealt)
    part, within = F.shiftright("_n", 33), F.col("_n").bitwiseAND((1 << 33) - 1)
    counts = dict(map(tuple, dealt.groupBy(part.alias("part")).count().collect()))
    before, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(i, 0)
    if not before:
        return dealt.drop("_n").withColumn(name, F.lit(0).cast("long"))
    return dealt.withColumn(name, within + 1 + F.element_at(F.array(*map(F.lit, before)).cast("array<bigint>"), part.cast("int") + 1)).drop("_n")


def expand_and_induce(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """The subgraph of the seeds and what is within so many hops: subgraph() goes one hop further."""
    reached = expand(nodes, edges, seeds, hops).select("id")
    return subgraph(nodes, edges, cut(seeds.select("id").union(reached)))


def document_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, linked): other documents that a document, its sections or chunks link to; links to sections don't count."""
    docs = nodes.where("type = 'document'").select(F.col("id").alias("linked"))
    own = nodes.where("doc_id is not null").select(F.col("id").alias("src"), "doc_id")
    out = edges.where("type = 'links_to'").select("src", F.col("dst").alias("linked")).join(docs, "linked", "left_semi").join(own, "src")
    return out.where("doc_id <> linked").select("doc_id", "linked").distinct()


def truncated(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first nodes by id, the edges among them, and (total_nodes, truncated)."""
    kept = cut(nodes.orderBy("id").limit(limit))
    side = lambda c: kept.select(F.col("id").alias(c))
    inside = edges.join(side("src"), "src", "left_semi").join(side("dst"), "dst", "left_semi")
    total = nodes.agg(F.count("*").alias("total_nodes")).withColumn("truncated", F.col("total_nodes") > limit)
    return kept, inside, total


def without_dangling(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (of some types only) and the edges whose ends are both there."""
    n = nodes.where(F.col("type").isin(types)) if types else nodes
    side = lambda c: n.select(F.col("id").alias(c))
    return n, edges.join(side("src"), "src", "left_semi").join(side("dst"), "dst", "left_semi")


def merged(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Subgraphs in one: nodes by id, edges by both ends and type."""
    nodes, edges = (reduce(DataFrame.unionByName, [p[i] for p in parts]) for i in (0, 1))
    return nodes.dropDuplicates(["id"]), edges.dropDuplicates(["src", "dst", "type"])


def export(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON lines of nodes (by id) and edges (by src, dst, type), in a column of their own."""
    n = nodes.orderBy("id").select(F.to_json(F.struct("id", "type", F.coalesce("meta", F.lit("{}")).alias("meta"))).alias("json"))
    return n, edges.orderBy("src", "dst", "type").select(F.to_json(F.struct("src", "dst", "type")).alias("json"))


def reclaimed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without orphans and without the edges at them."""
    return without_nodes(nodes, edges, cut(orphans(nodes, edges)).select("id"))
