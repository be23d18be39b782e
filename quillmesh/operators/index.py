"""Building an index: documents, chunks, graph, vectors and events of a corpus as tables, whole or incrementally."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, providers, text
from ..sources import markdown, scratch, store
from ..sources.scratch import cut
from ..sources.store import Change
from . import graph, names

#: The name of the rule that embeds texts without an embedder.
OFFLINE = "mock-embed"


def structure(parsed: DataFrame, found: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document, section and chunk nodes (id, type, doc_id, meta as JSON) and what contains what (src, dst, doc_id)."""
    good = parsed.where("error is null")
    node = lambda df, key, kind, *meta: df.select(key.alias("id"), F.lit(kind).alias("type"), "doc_id", F.to_json(F.struct(*meta)).alias("meta"))
    section = ids.section_id(F.col("doc_id"), F.col("sec_idx"))
    nodes = (
        node(good, F.col("doc_id"), "document", "path")
        .union(node(found, section, "section", F.col("section_path").alias("heading_path"), "level"))
        .union(node(chunks, F.col("id"), "chunk", "section_path"))
    )
    above = F.when(F.col("parent_idx").isNull(), F.col("doc_id")).otherwise(ids.section_id(F.col("doc_id"), F.col("parent_idx")))
    edges = found.select(above.alias("src"), section.alias("dst"), "doc_id").union(chunks.select(section.alias("src"), F.col("id").alias("dst"), "doc_id"))
    return nodes, edges


def with_unresolved(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Chunk nodes that keep the list of their links that lead nowhere."""
    lost = F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"])
    lists = links.where("dst is null").groupBy(F.col("src").alias("id")).agg(lost.alias("lost"))
    meta = F.to_json(F.struct(F.get_json_object("meta", "$.section_path").alias("section_path"), F.col("lost").alias("unresolved_links")))
    others = [c for c in nodes.columns if c != "meta"]
    return nodes.join(lists, "id", "left").select(*others, F.when(F.col("lost").isNull(), F.col("meta")).otherwise(meta).alias("meta")).select(*nodes.columns)


def tag_nodes(tags: DataFrame) -> DataFrame:
    """Of tag_links(): tag nodes, of several spellings the last."""
    nodes = tags.groupBy(F.col("dst").alias("id")).agg(F.max("name").alias("name"))
    return nodes.select("id", F.lit("tag").alias("type"), F.lit(None).cast("string").alias("doc_id"), F.to_json(F.struct("name")).alias("meta"))


def _seq() -> Column:
    """What is first and last among mentions: by the parts of the file's path, section, chunk and place."""
    return F.struct(F.split("path", "/").alias("parts"), "sec_idx", "chunk_idx", "pos")


def mentioned(found: DataFrame) -> DataFrame:
    """Chunks with entities (of extract_with) -> (chunk_id, doc_id, entity_id, name, type, description, seq)."""
    e = found.where("error is null").select("id", "doc_id", "path", "sec_idx", "chunk_idx", F.posexplode("entities").alias("pos", "e"))
    return e.select(F.col("id").alias("chunk_id"), "doc_id", ids.entity_id(F.col("e.name")).alias("entity_id"), "e.name", "e.type", "e.description", _seq().alias("seq"))


def related(found: DataFrame) -> DataFrame:
    """Chunks with entities and relations -> (src, dst, relation, seq), between entities that the chunk mentions."""
    own = F.transform("entities", lambda e: ids.normalize_name(e["name"]))
    r = found.where("error is null").select("path", "sec_idx", "chunk_idx", own.alias("own"), F.posexplode("relations").alias("pos", "r"))
    r = r.select("path", "sec_idx", "chunk_idx", "pos", "own", *(ids.normalize_name(F.col(f"r.{c}")).alias(c) for c in ("source", "target")), F.col("r.type").alias("relation"))
    r = r.where(F.array_contains("own", F.col("source")) & F.array_contains("own", F.col("target")))
    return r.select(ids.entity_id(F.col("source")).alias("src"), ids.entity_id(F.col("target")).alias("dst"), "relation", _seq().alias("seq"))


def entity_nodes(mentions: DataFrame) -> DataFrame:
    nodes = graph.entities(mentions)
    return nodes.select("id", F.lit("entity").alias("type"), F.lit(None).cast("string").alias("doc_id"), F.to_json(F.struct("name", "type", "description", "aliases")).alias("meta"))


def offline_entities(chunks: DataFrame) -> DataFrame:
    """extract_with for the offline rule, as native expressions: capitalised words, each related to the next."""
    entity = lambda n: F.struct(n.alias("name"), F.lit("concept").alias("type"), F.lit("").alias("description"))
    relation = lambda a, b: F.struct(a.alias("source"), b.alias("target"), F.lit("related_to").alias("type"))
    follow = lambda n: F.zip_with(F.slice(n, 1, F.greatest(F.size(n) - 1, F.lit(0))), F.slice(n, 2, F.greatest(F.size(n) - 1, F.lit(0))), relation)
    # The names are bound by the outer transform, and found once.
    both = F.transform(F.array(text.entity_names(F.col("text"))), lambda n: F.struct(F.transform(n, entity).alias("entities"), follow(n).alias("relations")))
    out = chunks.withColumn("_both", both[0])
    return out.select(*chunks.columns, "_both.entities", "_both.relations", F.lit(None).cast("string").alias("error"))


def vector_table(embedder: providers.Embedder | None = None, dim: int = 16) -> str:
    """The name of the table that holds a model's vectors."""
    return ids.table_name(OFFLINE, dim) if embedder is None else ids.table_name(embedder.name, embedder.dim)


def vectors(spark: SparkSession, root: str, embedder: providers.Embedder | None = None, dim: int = 16) -> DataFrame:
    """(id, doc_id, vector) of the chunks that a model has embedded."""
    found = store.load(spark, root, vector_table(embedder, dim))
    if found is None:
        raise ValueError(f"the index has no vectors of {vector_table(embedder, dim)}")
    return found.where("error is null").select("id", "doc_id", "vector")


def unresolved(spark: SparkSession, root: str) -> DataFrame:
    """(src, doc_id, raw, pos) of the links that lead nowhere."""
    return store.load(spark, root, "links").where("dst is null").select("src", "doc_id", "raw", "pos")


def _embedded(rows: DataFrame, embedder: providers.Embedder | None, dim: int, column: str = "text") -> DataFrame:
    """rows with vector and error instead of the text."""
    if embedder is not None:
        return providers.embed_with(rows, embedder, column).drop(column)
    made = rows.withColumn("vector", text.embed(F.col(column), dim)).withColumn("error", F.lit(None).cast("string"))
    return made.drop(column)


def _owners(column: Column | str, *tables: DataFrame | None) -> DataFrame | None:
    parts = [t.select((F.col(column) if isinstance(column, str) else column).alias("owner")) for t in tables if t is not None]
    return reduce(DataFrame.union, parts) if parts else None


def build(
    spark: SparkSession, corpus: DataFrame, root: str, embedder: providers.Embedder | None = None, extractor: providers.Extractor | None = None, dim: int = 16, max_chars: int = 1200, overlap: int = 150, incremental: bool = True, semantic: bool = True, partial: bool = False, embed: bool = True
) -> DataFrame:
    """Write a new version of the index at root from the files of corpus (path, text, and hash, mtime, error where there
    are any); a report of one row.

    Without an embedder or extractor the offline rules take their place. Incrementally, only files whose hash isn't that
    of the current version are parsed, embedded and extracted from, and what is written is in proportion to them: their
    rows, the entities, relations and tags that they have or had, and the links of other files that lead elsewhere now.
    Vectors are kept by model and size: those that a model lacks, or that failed, are made, also for unchanged files;
    so are extractions that failed. Entities and tags that nothing mentions any more go. Files with an error are
    reported and left out. With partial, files that corpus doesn't have stay as they are: it brings additions and changes
    only. Without embed, no vectors are made, by this build; add_vectors() makes them. Raises store.Conflict if another build
    was faster."""
    with scratch.scope(spark):
        return _build(spark, corpus, root, embedder, extractor, dim, max_chars, overlap, incremental, semantic, partial, embed)


def _build(spark, corpus, root, embedder, extractor, dim, max_chars, overlap, incremental, semantic, partial, embed) -> DataFrame:
    based = store.current(spark, root)
    known = store.listing(spark, root, based)
    full = "documents" not in known or not (incremental or partial)
    old = {n: store.load(spark, root, n, based, owners=True) for n in known}
    given = markdown.manifest(corpus)
    good = given.where("error is null")
    stored = old["documents"].select("id", "hash") if "documents" in old else good.select(F.col("doc_id").alias("id"), "hash").limit(0)
    actions = graph.route(stored, good.select(F.col("doc_id").alias("id"), "hash"))
    actions = cut(actions.where("action <> 'removed'") if partial else actions)
    gone = actions.where("action <> 'unchanged'").select(F.col("id").alias("doc_id"))
    todo = actions.where("action = 'build'").select(F.col("id").alias("doc_id"))

    parsed = cut(markdown.parse(good if full else good.join(todo, "doc_id", "left_semi")))
    found = markdown.section_table(parsed)
    chunks = cut(markdown.section_chunks(found, max_chars, overlap))
    docs = parsed.select(F.col("doc_id").alias("id"), "path", "hash", "mtime", "frontmatter")
    sections = found.select("doc_id", "sec_idx", "level", "parent_idx", "section_path", "char_start")
    tags = cut(markdown.tag_links(parsed, found, chunks))
    warnings = parsed.select("doc_id", "path", F.explode("warnings").alias("warning"))
    changes: dict[str, Change] = {}

    def put(name: str, add: DataFrame | None, gone_owners: DataFrame | None) -> None:
        changes[name] = Change(add, None if full else gone_owners, replace=full)

    def left(name: str, key: str = "doc_id") -> DataFrame | None:
        """The old rows of files that stay as they are."""
        return None if full or name not in old else old[name].join(gone.withColumnRenamed("doc_id", key), key, "left_anti")

    def both(name: str, new: DataFrame, key: str = "doc_id") -> DataFrame:
        stay = left(name, key)
        return new if stay is None else new.unionByName(stay.select(*new.columns))

    for name, rows in (("documents", docs), ("sections", sections), ("chunks", chunks), ("tags", tags), ("warnings", warnings)):
        put(name, rows, _owners("doc_id", gone))

    # Chunks whose vectors and extractions go: those of changed files, and those that have none yet, or failed.
    gone_chunks = None if full else cut(old["chunks"].join(gone, "doc_id", "left_semi").select("id"))
    stay_chunks = left("chunks")

    def lacking(table: str) -> DataFrame | None:
        if stay_chunks is None:
            return None
        have = old[table].where("error is null").select("id") if table in old else gone_chunks.limit(0)
        some = cut(stay_chunks.select("id").join(have, "id", "left_anti"))
        return None if some.isEmpty() else some

    def wanted(more: DataFrame | None) -> DataFrame:
        return chunks if more is None else chunks.unionByName(stay_chunks.join(more, "id", "left_semi").select(*chunks.columns))

    table = vector_table(embedder, dim) if embed else None
    failed = chunks.select("id", F.lit(None).cast("string").alias("error")).limit(0)
    if embed:
        more = lacking(table)
        made = cut(_embedded(wanted(more).select("id", "doc_id", "text"), embedder, dim))
        put(table, made, _owners("id", gone_chunks, more))
        failed = made.where("error is not null").select("id", "error")
    for other in known:  # other models' vectors of what has changed
        if other.startswith("vectors_") and other != table:
            put(other, None, gone_chunks and _owners("id", gone_chunks))

    nodes, contains = structure(parsed, found, chunks)
    edge = lambda df, kind, owner, meta=F.lit(None).cast("string"): df.select("src", "dst", F.lit(kind).alias("type"), meta.alias("meta"), owner.alias("owner"))
    edges = edge(contains, "contains", F.col("doc_id")).union(edge(tags.select("src", "dst", "doc_id").distinct(), "tagged", F.col("doc_id")))
    gone_nodes = [] if full else [old["nodes"].join(gone, "doc_id", "left_semi").select("id")]
    gone_edges = [gone.select("doc_id")]
    touched = []

    # Entities and relations of what is new, and of what the changed chunks had before.
    if semantic or "extractions" in old:
        more = lacking("extractions") if semantic else None
        source = wanted(more) if semantic else chunks.limit(0)
        columns = ["id", "doc_id", "path", "sec_idx", "chunk_idx", "entities", "relations", "error"]
        new = cut((offline_entities(source) if extractor is None else providers.extract_with(source, extractor)).select(*columns))
        put("extractions", new, _owners("id", gone_chunks, more))
        failed = failed.union(new.where("error is not null").select("id", "error"))
        own = cut(mentioned(new))
        every, links = own, related(new)
        edges = edges.union(edge(own.select(F.col("chunk_id").alias("src"), F.col("entity_id").alias("dst"), "doc_id").distinct(), "mentions", F.col("doc_id")))
        if not full and "extractions" in old:
            was = mentioned(old["extractions"].join(gone_chunks, "id", "left_semi"))
            some = cut(own.select("entity_id").union(was.select("entity_id")).distinct())
            pairs = cut(links.select("src", "dst").union(related(old["extractions"].join(gone_chunks, "id", "left_semi")).select("src", "dst")).distinct())
            near = old["edges"].where("type = 'mentions'").join(some.withColumnRenamed("entity_id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
            kept = cut(old["extractions"].where("error is null").join(gone_chunks, "id", "left_anti").join(near, "id", "left_semi"))
            around = mentioned(kept)
            every = own.unionByName(around.join(some, "entity_id", "left_semi").select(*own.columns))
            links = links.unionByName(related(kept).join(pairs, ["src", "dst"], "left_semi").select(*links.columns))
            touched.append(some.select(F.col("entity_id").alias("id")))
            gone_edges.append(pairs.select(_pair().alias("doc_id")))
        nodes = nodes.union(entity_nodes(every))
        links = links.groupBy("src", "dst").agg(F.max_by("relation", "seq").alias("relation"))
        edges = edges.union(edge(links, "relates_to", _pair(), F.to_json(F.struct(F.col("relation").alias("type")))))

    # Tags, counted anew where a changed file has or had them.
    if not full:
        some = cut(tags.select("dst").union(old["tags"].join(gone, "doc_id", "left_semi").select("dst")).distinct())
        touched.append(some.select(F.col("dst").alias("id")))
        nodes = nodes.union(tag_nodes(both("tags", tags).join(some, "dst", "left_semi")))
    else:
        nodes = nodes.union(tag_nodes(tags))

    # Links of the changed files, and those of others whose targets the change may have moved.
    paths = both("documents", docs, "id").select(F.col("id").alias("doc_id"), "path")
    places = both("sections", sections)
    links = cut(markdown.resolved_links(markdown.placed_links(found, chunks, max_chars), paths, places))
    moved = None
    if not full:
        was = old["documents"].join(gone.withColumnRenamed("doc_id", "id"), "id", "left_semi").select("path").union(docs.select("path"))
        keys = was.select(F.explode(F.array(F.concat(F.lit("t:"), markdown.stem(F.col("path"))), F.concat(F.lit("p:"), "path"))).alias("key")).distinct()
        others = left("links")
        near = others.select("*", F.explode("keys").alias("key")).join(keys, "key", "left_semi").drop("key").distinct()
        again = cut(markdown.resolved_links(near.drop("dst"), paths, places).withColumnRenamed("dst", "now").join(near.select("src", "pos", "kind", "dst"), ["src", "pos", "kind"]))
        moved = cut(again.where(~F.col("now").eqNullSafe(F.col("dst"))).select("doc_id").distinct())
        moved = None if moved.isEmpty() else moved
    if moved is not None:
        rest = others.join(moved, "doc_id", "left_semi")
        rest = rest.join(again.select("src", "pos", "kind", "now", F.lit(True).alias("seen")), ["src", "pos", "kind"], "left")
        rest = cut(rest.withColumn("dst", F.when(F.col("seen"), F.col("now")).otherwise(F.col("dst"))).select(*links.columns))
        links = links.union(rest)
        again_nodes = stay_chunks.join(rest.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
        nodes = nodes.union(again_nodes.select("id", F.lit("chunk"), "doc_id", F.to_json(F.struct("section_path"))))
        gone_nodes.append(rest.select(F.col("src").alias("id")))
    put("links", links, _owners("doc_id", gone, moved))
    led = lambda c: F.concat(F.lit("l:"), c)
    edges = edges.union(edge(links.where("dst is not null").select("src", "dst", "doc_id").distinct(), "links_to", led(F.col("doc_id"))))
    gone_edges += [t.select(led(F.col("doc_id")).alias("doc_id")) for t in (gone, moved) if t is not None]
    nodes = with_unresolved(nodes, links)
    nodes = cut(nodes.withColumn("owner", F.col("id")))
    put("nodes", nodes, _owners("id", *gone_nodes, *touched))
    put("edges", edges, _owners("doc_id", *gone_edges))
    errors = given.where("error is not null").select("path", "error").union(failed)
    changes["errors"] = Change(errors, replace=True)

    reclaimed = 0
    if touched:
        reclaimed = old["nodes"].join(reduce(DataFrame.union, touched), "id", "left_semi").join(nodes, "id", "left_anti").count()
    version = store.commit(spark, root, changes, based)
    return _report(spark, root, version, actions, full, reclaimed)


def _pair() -> Column:
    return F.concat(F.lit("r:"), "src", F.lit("|"), "dst")


def _report(spark: SparkSession, root: str, version: int, actions: DataFrame, full: bool, reclaimed: int) -> DataFrame:
    table = lambda name: store.load(spark, root, name, version)
    several = markdown.titles(table("documents").select(F.col("id").alias("doc_id"), "path")).where("n > 1")
    counted = {
        "errors": table("errors"), "warnings": table("warnings"), "several": several, "unresolved": table("links").where("dst is null"), "entities": table("nodes").where("type = 'entity'"),
        **{a: actions.where(F.col("action") == a) for a in ("build", "unchanged", "removed")},
    }
    n = dict(zip(counted, store.at_once(lambda t: t.count(), counted.values()), strict=True))
    row = {
        "indexed": n["build"] + (n["unchanged"] if full else 0), "unchanged": 0 if full else n["unchanged"], "removed": n["removed"], "reclaimed": reclaimed, "errors": n["errors"],
        "warnings": n["warnings"] + n["several"], "unresolved": n["unresolved"], "entities": n["entities"],
    }
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row))


def add_vectors(spark: SparkSession, root: str, embedder: providers.Embedder | None = None, dim: int = 16) -> int:
    """Embed the current version's chunks that a model lacks, or failed at, as a new version; its number."""
    with scratch.scope(spark):
        based, table = store.current(spark, root), vector_table(embedder, dim)
        chunks, have = store.load(spark, root, "chunks", based).select("id", "doc_id", "text"), store.load(spark, root, table, based)
        todo = chunks if have is None else chunks.join(have.where("error is null").select("id"), "id", "left_anti")
        made = cut(_embedded(todo, embedder, dim))
        return store.commit(spark, root, {table: Change(made, None if have is None else _owners("id", made), have is None)}, based)


def follow(spark: SparkSession, files: DataFrame, root: str, checkpoint: str, **options):
    """A corpus as a stream: files (path, text and others, streaming) go into the index batch by batch, as partial builds.
    Of several rows of a path in a batch the last by mtime counts. A batch that is replayed changes nothing, as its files
    have the hashes that the index has. The writer, to be started; options as for build()."""

    def add(batch: DataFrame, _: int) -> None:
        given = markdown.manifest(batch)
        rest = [c for c in given.columns if c != "path"]
        newest = given.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("mtime", "hash")).alias("r")).select("path", *(f"r.{c}" for c in rest))
        build(batch.sparkSession, newest.drop("doc_id"), root, partial=True, **options)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def warnings(spark: SparkSession, root: str) -> DataFrame:
    """(path, warning): of files, and of stems that several files have (with a null path)."""
    docs = store.load(spark, root, "documents").select(F.col("id").alias("doc_id"), "path")
    several = markdown.titles(docs).where("n > 1").select(F.lit(None).cast("string"), F.concat(F.lit("several files are named "), "stem"))
    return store.load(spark, root, "warnings").select("path", "warning").union(several)


def stats(spark: SparkSession, root: str, embedder: providers.Embedder | None = None, dim: int = 16) -> DataFrame:
    """Numbers of documents, chunks, nodes, edges and of a model's vectors of the current version."""
    named = {n: n for n in ("documents", "chunks", "nodes", "edges")} | {"vectors": vector_table(embedder, dim)}
    parts = [store.load(spark, root, t).agg(F.count("*").alias(n)) for n, t in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # of one row each
    return out


def build_events(spark: SparkSession, root: str, extractor: providers.EventExtractor | None = None, embedder: providers.Embedder | None = None, dim: int = 16, full: bool = False) -> DataFrame:
    """Events of the current version's chunks as a new version: events, event_entities, event_nodes (the entities: first
    name, first type and description that aren't empty, those of earlier builds first). A report of one row: events,
    entities and links there are now, chunks of this build without an event (failed), and chunks it has looked at.

    Chunks that are new, that have another text than at the last build, or that have no event are looked at; with full,
    all are. Events of chunks that are gone go, their entities stay. Without an extractor, a chunk's event has its first
    five words as title, its text as content and its capitalised words as entities; without an embedder, contents are
    embedded by the offline rule. Events whose vectors are another model's get new ones."""
    with scratch.scope(spark):
        return _build_events(spark, root, extractor, embedder, dim, full)


def _build_events(spark, root, extractor, embedder, dim, full) -> DataFrame:
    based = store.current(spark, root)
    model = vector_table(embedder, dim)
    table = lambda name: store.load(spark, root, name, based)
    chunks, before = table("chunks").withColumn("digest", F.sha2("text", 256)), table("events")
    full = full or before is None
    if full:
        todo, gone, stale = chunks, None, None
    else:
        now = chunks.select(F.col("id").alias("chunk_id"), "digest")
        done = cut(before.join(now, ["chunk_id", "digest"], "left_semi"))
        todo = cut(chunks.join(done.select(F.col("chunk_id").alias("id")), "id", "left_anti"))
        gone = cut(before.join(done.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id"))
        stale = cut(done.where(F.col("model") != model).drop("embedding", "model"))
        stale = None if stale.isEmpty() else stale
    titled = todo.withColumn("doc_title", markdown.stem(F.col("path")))
    if extractor is None:
        plain = {"title": text.title(F.col("text")), "summary": F.lit(""), "content": F.col("text"), "category": F.lit(""), "keywords": F.array().cast("array<string>")}
        made = offline_entities(titled).select("*", *(c.alias(n) for n, c in plain.items()))
        made = made.withColumn("error", F.when(F.size("entities") == 0, "no event"))
    else:
        made = providers.events_with(titled, extractor)
    made = cut(made)
    columns = ["id", "doc_id", "chunk_id", "title", "summary", "content", "category", "keywords", "digest"]
    rows = made.where("error is null").withColumn("chunk_id", F.col("id")).withColumn("id", ids.event_id(F.col("chunk_id"))).select(*columns, "entities")
    fresh = rows.drop("entities") if stale is None else rows.drop("entities").unionByName(stale.select(*columns))
    told = _embedded(fresh.where("content <> ''").select("id", "content"), embedder, dim, "content").select("id", F.col("vector").alias("embedding"))
    events = fresh.join(told, "id", "left").withColumn("model", F.lit(model))

    e = rows.select("id", "chunk_id", F.posexplode("entities").alias("pos", "e"))
    e = cut(e.select(F.col("id").alias("event_id"), "chunk_id", ids.entity_id(F.col("e.name")).alias("entity_id"), "pos", "e.*"))
    links = e.groupBy("event_id", "entity_id").agg(F.first("chunk_id").alias("chunk_id"), F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos"))
    said = e.select("entity_id", "name", "type", "description", F.struct(F.lit(1).alias("build"), "event_id", "pos").alias("seq"))
    if not full:
        earlier = table("event_nodes").join(e.select("entity_id").distinct(), "entity_id", "left_semi")
        said = said.union(earlier.select("entity_id", "name", "type", "description", F.struct(F.lit(0).alias("build"), F.lit("").alias("event_id"), F.lit(0).alias("pos"))))
    nodes = cut(graph.fill_if_empty(said, "entity_id", "seq", ["name"], ["type", "description"]).withColumn("normal", ids.normalize_name(F.col("name"))))
    gone_chunks = None if full else _owners("chunk_id", gone, stale)
    gone_links = None if full else _owners("chunk_id", gone)
    version = store.commit(
        spark, root,
        {
            "events": Change(events, gone_chunks, full), "event_entities": Change(links, gone_links, full),
            "event_nodes": Change(nodes, None if full else _owners("entity_id", nodes), full), "event_grams": Change(names.grams(nodes), None if full else _owners("entity_id", nodes), full),
        }, based,
    )
    counted = ("events", "event_nodes", "event_entities")
    n = dict(zip(counted, store.at_once(lambda name: store.load(spark, root, name, version).count(), counted), strict=True))
    failed, seen = made.agg(F.count_if(F.col("error").isNotNull()), F.count("*")).first()
    row = (n["events"], failed, n["event_nodes"], n["event_entities"], seen)
    return spark.createDataFrame([row], "events long, failed long, entities long, links long, seen long")
