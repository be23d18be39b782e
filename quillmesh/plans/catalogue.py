"""Registered queries of the retrieval engine and their SQL oracles.

The corpus of most of them is the documents table, a file of one section for each document; `md_` queries and those
on links and tags have a corpus of markdown files made of nations, regions and suppliers. Graph and event queries read
an index of their corpus, written once for each session and folder of tables. Graph queries start from the first
documents' chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import graph, index, names, retrieve
from ..sources import corpus, markdown, scratch, store

QUERY = "The thing with another Ration"
#: They name some twenty entities at sf0.01, one as a whole word.
TOKENS = ["ument", "bleth", "of"]
SEEDS = "SELECT id FROM chunks WHERE doc_id IN (SELECT did FROM docs WHERE doc_id < 3)"

_BASE = r"""
docs AS (SELECT doc_id, text, 'd_' || substr(sha256('source/' || doc_id || '.md'), 1, 16) AS did, CAST(length(text) AS BIGINT) AS n FROM documents),
win AS (SELECT did, text, n, unnest(generate_series(0, greatest((n - 1) // 1200, 0))) AS i FROM docs WHERE trim(text, E' \n\t\r') <> ''),
chunks AS (SELECT did || '_s0_c' || i AS id, did AS doc_id, i, CASE WHEN i = 0 THEN 0 ELSE i * 1200 - 150 END AS s, least(n, (i + 1) * 1200) AS e, substr(text, CASE WHEN i = 0 THEN 1 ELSE i * 1200 - 149 END, least(n, (i + 1) * 1200) - CASE WHEN i = 0 THEN 0 ELSE i * 1200 - 150 END) AS text FROM win)"""
_NAMES = r""",
tok AS (SELECT id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda t: regexp_full_match(t, '[A-Z][a-zA-Z0-9]+')) AS l FROM chunks),
occ AS (SELECT id, unnest(l) AS name, generate_subscripts(l, 1) AS pos FROM tok),
named AS (SELECT id AS chunk_id, name, min(pos) AS pos, 'e_' || substr(sha256(trim(regexp_replace(lower(name), '[^\p{L}\p{N}_]+', ' ', 'g'))), 1, 16) AS entity_id FROM occ GROUP BY id, name),
follows AS (SELECT chunk_id, entity_id, lead(entity_id) OVER (PARTITION BY chunk_id ORDER BY pos) AS next FROM named)"""
_GRAPH = r""",
nodes AS (SELECT did AS id, 'document' AS type FROM docs UNION ALL SELECT DISTINCT doc_id || '_s0', 'section' FROM chunks UNION ALL SELECT id, 'chunk' FROM chunks UNION ALL SELECT DISTINCT entity_id, 'entity' FROM named),
edges AS (SELECT DISTINCT doc_id AS src, doc_id || '_s0' AS dst, 'contains' AS type FROM chunks UNION ALL SELECT doc_id || '_s0', id, 'contains' FROM chunks UNION ALL SELECT DISTINCT chunk_id, entity_id, 'mentions' FROM named
    UNION ALL SELECT DISTINCT entity_id, next, 'relates_to' FROM follows WHERE next IS NOT NULL),
around AS (SELECT src, dst, type FROM edges UNION ALL SELECT dst, src, type FROM edges)"""
_EMBED = r""",
hashed AS (SELECT id, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: strpos('0123456789abcdef', substr(sha256(t), 64, 1)) - 1) AS h FROM chunks),
counted AS (SELECT id, list_transform(range(0, 16), lambda i: CAST(len(list_filter(h, lambda x: x = i)) AS DOUBLE)) AS v FROM hashed),
vectors AS (SELECT id, CASE WHEN sqrt(list_dot_product(v, v)) = 0 THEN v ELSE list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) END AS vector FROM counted),
q0 AS (SELECT list_transform(range(0, 16), lambda i: CAST(len(list_filter(list_transform(regexp_extract_all(lower('{q}'), '[\p{L}\p{N}_]+'), lambda t: strpos('0123456789abcdef', substr(sha256(t), 64, 1)) - 1), lambda x: x = i)) AS DOUBLE)) AS v),
q AS (SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS qv FROM q0),
dist AS (SELECT id, round(list_sum(list_transform(list_zip(vector, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS d FROM vectors, q)""".replace("{q}", QUERY)
_EXPAND = r""",
h1 AS (SELECT DISTINCT dst AS id FROM around WHERE src IN (SELECT id FROM seeds) AND dst NOT IN (SELECT id FROM seeds)),
h2 AS (SELECT DISTINCT dst AS id FROM around WHERE src IN (SELECT id FROM h1) AND dst NOT IN (SELECT id FROM seeds) AND dst NOT IN (SELECT id FROM h1)),
reach AS (SELECT id, 1 AS hop FROM h1 UNION ALL SELECT id, 2 FROM h2)"""
_EVENTS = r""",
links AS (SELECT DISTINCT 'ev_' || substr(sha256(chunk_id), 1, 16) AS event_id, entity_id FROM named),
evs AS (SELECT chunk_id, name, entity_id, pos, 'ev_' || substr(sha256(chunk_id), 1, 16) AS event_id FROM named),
names AS (SELECT entity_id, arg_min(name, (event_id, pos)) AS name, trim(regexp_replace(lower(arg_min(name, (event_id, pos))), '[^\p{L}\p{N}_]+', ' ', 'g')) AS normal FROM evs GROUP BY entity_id),
seed_e AS (SELECT entity_id, name FROM names WHERE normal LIKE '%ument%' OR normal LIKE '%bleth%' OR normal LIKE '%of%' ORDER BY entity_id LIMIT 50),
s0 AS (SELECT DISTINCT event_id AS id FROM links WHERE entity_id IN (SELECT entity_id FROM seed_e)),
s1 AS (SELECT DISTINCT b.event_id AS id FROM links a JOIN links b USING (entity_id) WHERE a.event_id IN (SELECT id FROM s0) AND b.event_id NOT IN (SELECT id FROM s0)),
ev AS (SELECT id, 0 AS hop FROM s0 UNION ALL SELECT id, 1 FROM s1)"""

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registry(queries: dict, oracles: dict) -> Callable:
    """A decorator that enters a query, and its SQL where there is any."""

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return query


query = registry(Q, SQL)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.chunks(corpus.from_table(_t(spark, sf, "documents")))


_ROOTS: dict[tuple[str, str, str], str] = {}


def _index(spark: SparkSession, sf: str, kind: str = "documents") -> str:
    """The root of this session's index of a corpus; it is built at its first use."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _ROOTS:
        root = f"{scratch.shared_dir(spark)}/index-{uuid.uuid4().hex}"
        files = corpus.from_table(_t(spark, sf, "documents")) if kind == "documents" else _files(spark, sf)
        index.build(spark, files, root, semantic=kind == "documents", embed=kind != "documents")
        _ROOTS[key] = root
    return _ROOTS[key]


def _made(spark: SparkSession, root: str, names: tuple[str, ...]) -> str:
    """The root, once the index has what the queries of these tables read: vectors and events of documents are made at
    their first use."""
    have = store.listing(spark, root)
    if "vectors" in names and index.vector_table() not in have:
        index.add_vectors(spark, root)
    if "events" not in have and any(n.startswith("event") for n in names):
        index.build_events(spark, root)
    return root


def _of(spark: SparkSession, sf: str, *names: str, kind: str = "documents") -> list[DataFrame]:
    root = _index(spark, sf, kind)
    root = _made(spark, root, names)
    return [store.load(spark, root, index.vector_table() if n == "vectors" else n) for n in names]


def _graph(spark: SparkSession, sf: str, kind: str = "documents") -> tuple[DataFrame, DataFrame]:
    nodes, edges = _of(spark, sf, "nodes", "edges", kind=kind)
    return nodes.select("id", "type", "doc_id"), edges.select("src", "dst", "type")


def _asked(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df with the query's vector as qv: one row goes to the tasks."""
    return df.crossJoin(F.broadcast(spark.range(1).select(text.embed(F.lit(QUERY)).alias("qv"))))


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.chunks(corpus.from_table(_t(spark, sf, "documents").where("doc_id < 3"))).select("id")


def _with(*parts: str) -> str:
    return "WITH " + "".join(parts)


@query("SELECT doc_id, 'd_' || substr(sha256('source/' || doc_id || '.md'), 1, 16) AS id FROM documents")
def doc_ids(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select("doc_id", ids.doc_id(F.concat(F.lit("source/"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("id"))


@query(r"SELECT n_nationkey, 't_' || substr(sha256(lower(n_name)), 1, 16) AS tag, 'e_' || substr(sha256(trim(regexp_replace(lower(n_name), '[^\p{L}\p{N}_]+', ' ', 'g'))), 1, 16) AS entity, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM nation")
def name_ids(spark, sf):
    n = F.col("n_name")
    return _t(spark, sf, "nation").select("n_nationkey", ids.tag_id(n).alias("tag"), ids.entity_id(n).alias("entity"), ids.slug(n).alias("slug"))


@query("SELECT 'd_' || substr(sha256('source/' || doc_id || '.md'), 1, 16) AS id, sha256(text) AS hash FROM documents")
def content_hash_manifest(spark, sf):
    return corpus.from_table(_t(spark, sf, "documents")).select(ids.doc_id(F.col("path")).alias("id"), F.sha2("text", 256).alias("hash"))


@query(_with(_BASE) + " SELECT id, doc_id, CAST(s AS INT) AS char_start, CAST(e AS INT) AS char_end, sha256(text) AS digest FROM chunks")
def chunk_windows(spark, sf):
    return _chunks(spark, sf).select("id", "doc_id", "char_start", "char_end", F.sha2("text", 256).alias("digest"))


@query(_with(_BASE) + " SELECT docs.did AS doc_id, count(chunks.id) AS n_chunks FROM docs LEFT JOIN chunks ON chunks.doc_id = docs.did GROUP BY docs.did")
def chunks_per_document(spark, sf):
    docs = corpus.from_table(_t(spark, sf, "documents")).select(ids.doc_id(F.col("path")).alias("doc_id"))
    return docs.join(_chunks(spark, sf).select("doc_id", "id"), "doc_id", "left").groupBy("doc_id").agg(F.count("id").alias("n_chunks"))


@query(_with(_BASE, _NAMES, _GRAPH) + " SELECT src, dst FROM edges WHERE type = 'contains'")
def contains_edges(spark, sf):
    return _graph(spark, sf)[1].where("type = 'contains'").select("src", "dst")


@query(_with(_BASE, _NAMES, _GRAPH) + " SELECT id, type FROM nodes")
def node_table(spark, sf):
    return _graph(spark, sf)[0].select("id", "type")


@query(_with(_BASE, _NAMES, _GRAPH) + " SELECT src, dst, type FROM edges")
def edge_table(spark, sf):
    return _graph(spark, sf)[1]


@query(_with(_BASE, _EMBED) + " SELECT id, list_transform(vector, lambda x: round(x, 6)) AS vector FROM vectors")
def mock_embedding(spark, sf):
    return retrieve.vector_table(_chunks(spark, sf)).select("id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query(_with(_BASE, _NAMES) + " SELECT DISTINCT chunk_id, entity_id FROM named")
def entity_mentions(spark, sf):
    return graph.mentions(_chunks(spark, sf)).select("chunk_id", "entity_id").distinct()


@query(_with(_BASE, _NAMES) + " SELECT DISTINCT entity_id AS src, next AS dst FROM follows WHERE next IS NOT NULL")
def entity_relations(spark, sf):
    return graph.relations(_chunks(spark, sf))


@query(_with(_BASE, _NAMES) + """, f AS (SELECT entity_id AS id, arg_min(name, (chunk_id, pos)) AS name, list_distinct(list(name)) AS names FROM named GROUP BY entity_id)
SELECT id, name, 'concept' AS type, '' AS description, list_sort(list_filter(names, lambda x: x <> name)) AS aliases FROM f""")
def entity_aggregate(spark, sf):
    m = graph.mentions(_chunks(spark, sf))
    return graph.entities(m.select("entity_id", "name", F.struct("chunk_id", "pos").alias("seq"), F.lit("concept").alias("type"), F.lit("").alias("description")))


@query(_with(_BASE, _NAMES) + " SELECT entity_id AS id, count(DISTINCT chunk_id) AS n_mentions FROM named GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_entities(spark, sf):
    n, e = _graph(spark, sf)
    return graph.in_degree(n, e).orderBy(F.desc("n_mentions"), "id").limit(20)


@query(_with(_BASE, _NAMES, _GRAPH) + " SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_type_stats(spark, sf):
    return _graph(spark, sf)[0].groupBy("type").agg(F.count("*").alias("n"))


@query(_with(_BASE, _NAMES, _GRAPH) + " SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def table_counts(spark, sf):
    c, n, e = _of(spark, sf, "chunks", "nodes", "edges")
    parts = [df.select(F.lit(k).alias("k")) for k, df in (("documents", _t(spark, sf, "documents")), ("chunks", c), ("nodes", n), ("edges", e))]
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return every.agg(*[F.sum((F.col("k") == k).cast("long")).alias(k) for k in ("documents", "chunks", "nodes", "edges")])


_V0 = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), q AS (SELECT vector AS qv FROM v WHERE id = 0)"


def _vectors(spark, sf):
    """All vectors, each with the one of id 0 as the query (none, if there is no such id)."""
    v = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return v.crossJoin(F.broadcast(v.where("id = 0").select(F.col("vector").alias("qv")).limit(1))), F.col("qv")


@query(f"WITH {_V0} SELECT id, round(list_sum(list_transform(list_zip(vector, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance FROM v, q ORDER BY list_sum(list_transform(list_zip(vector, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), id LIMIT 8")
def knn_l2(spark, sf):
    v, q = _vectors(spark, sf)
    return retrieve.nearest(v, q, 8).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_V0} SELECT id, round(list_cosine_similarity(vector, qv), 6) AS cosine FROM v, q ORDER BY list_cosine_similarity(vector, qv) DESC, id LIMIT 8")
def knn_cosine(spark, sf):
    v, q = _vectors(spark, sf)
    return retrieve.nearest(v, q, 8, "cosine").select("id", F.round("cosine", 6).alias("cosine"))


_RANKS = f"""WITH {_V0}, d AS (SELECT id, list_sum(list_transform(list_zip(vector, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS l, list_cosine_similarity(vector, qv) AS c FROM v, q),
a AS (SELECT id, row_number() OVER (ORDER BY l, id) AS rank FROM d QUALIFY rank <= 50), b AS (SELECT id, row_number() OVER (ORDER BY c DESC, id) AS rank FROM d QUALIFY rank <= 50)"""


def _rankings(spark, sf):
    v, q = _vectors(spark, sf)
    return [graph.ranked(retrieve.nearest(v, q, 50), "distance", "id"), graph.ranked(retrieve.nearest(v, q, 50, "cosine"), F.desc("cosine"), "id")]


@query(_RANKS + " SELECT id, round(sum(s), 9) AS score FROM (SELECT id, 1.0::DOUBLE / (60 + rank) AS s FROM a UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank) FROM b) GROUP BY id")
def rrf_fusion(spark, sf):
    return retrieve.fuse(_rankings(spark, sf)).select("id", F.round("score", 9).alias("score"))


@query(_RANKS + " SELECT id, round(sum(s), 9) AS score FROM (SELECT id, 1.0::DOUBLE / (60 + rank) AS s FROM a UNION ALL SELECT id, 0.5::DOUBLE / (60 + rank) FROM b) GROUP BY id")
def rrf_weighted(spark, sf):
    return retrieve.fuse(_rankings(spark, sf), [1.0, 0.5]).select("id", F.round("score", 9).alias("score"))


@query("SELECT id, source, score FROM (SELECT doc_id AS id, source, CAST(n_chars AS DOUBLE) AS score FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 2) ORDER BY score DESC, id LIMIT 20")
def per_source_cap_topk(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.col("n_chars").cast("double").alias("score"))
    return retrieve.cap(d, "source", 2, 20)


@query(_with(_BASE, _NAMES, _GRAPH, f", seeds AS ({SEEDS})", _EXPAND) + " SELECT id FROM reach WHERE hop = 1")
def graph_neighbors(spark, sf):
    n, e = _graph(spark, sf)
    return graph.expand(n, e, _seeds(spark, sf), 1).select("id")


@query(_with(_BASE, _NAMES, _GRAPH, f", seeds AS ({SEEDS})", _EXPAND) + " SELECT id, hop FROM reach")
def graph_expand_2hop(spark, sf):
    n, e = _graph(spark, sf)
    return graph.expand(n, e, _seeds(spark, sf), 2)


@query(_with(_BASE, _NAMES, _GRAPH, f", seeds AS ({SEEDS})", _EXPAND.replace("FROM around WHERE", "FROM around WHERE type = 'contains' AND")) + " SELECT id, hop FROM reach")
def graph_expand_filtered(spark, sf):
    n, e = _graph(spark, sf)
    return graph.expand(n, e, _seeds(spark, sf), 2, ["contains"])


_INSIDE = ", inside AS (SELECT id FROM seeds UNION SELECT dst FROM around WHERE src IN (SELECT id FROM seeds))"


@query(_with(_BASE, _NAMES, _GRAPH, f", seeds AS ({SEEDS})", _INSIDE) + " SELECT id, type FROM nodes WHERE id IN (SELECT id FROM inside)")
def induced_subgraph_nodes(spark, sf):
    n, e = _graph(spark, sf)
    return graph.subgraph(n, e, _seeds(spark, sf))[0].select("id", "type")


@query(_with(_BASE, _NAMES, _GRAPH, f", seeds AS ({SEEDS})", _INSIDE) + " SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM inside) AND dst IN (SELECT id FROM inside)")
def induced_subgraph_edges(spark, sf):
    n, e = _graph(spark, sf)
    return graph.subgraph(n, e, _seeds(spark, sf))[1]


_DEAD = ", dead AS (SELECT did AS id FROM docs WHERE doc_id % 10 = 0 UNION ALL SELECT did || '_s0' FROM docs WHERE doc_id % 10 = 0 UNION ALL SELECT id FROM chunks WHERE doc_id IN (SELECT did FROM docs WHERE doc_id % 10 = 0))"


def _deleted(spark, sf):
    gone = corpus.from_table(_t(spark, sf, "documents").where("doc_id % 10 = 0")).select(ids.doc_id(F.col("path")).alias("doc_id"))
    return graph.delete_documents(*_graph(spark, sf), gone)


@query(_with(_BASE, _NAMES, _GRAPH, _DEAD) + " SELECT src, dst, type FROM edges WHERE src NOT IN (SELECT id FROM dead) AND dst NOT IN (SELECT id FROM dead)")
def delete_cascade(spark, sf):
    return _deleted(spark, sf)[1]


@query(_with(_BASE, _NAMES, _GRAPH, _DEAD) + " SELECT id, type FROM nodes WHERE type = 'entity' AND id NOT IN (SELECT dst FROM edges WHERE type = 'mentions' AND src NOT IN (SELECT id FROM dead))")
def reclaim_orphans(spark, sf):
    return graph.orphans(*_deleted(spark, sf))


@query("""SELECT CASE WHEN doc_id % 10 = 0 THEN 'removed' WHEN doc_id % 10 = 1 THEN 'build' WHEN doc_id % 10 = 2 THEN 'build' ELSE 'unchanged' END AS action, 'd_' || substr(sha256('source/' || doc_id || '.md'), 1, 16) AS id FROM documents""")
def incremental_routing(spark, sf):
    d = _t(spark, sf, "documents")
    m = d.select("doc_id", ids.doc_id(F.concat(F.lit("source/"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("id"), F.sha2("text", 256).alias("hash"))
    found = m.where("doc_id % 10 <> 0").withColumn("hash", F.when(F.col("doc_id") % 10 == 1, F.sha2(F.concat("hash", F.lit("x")), 256)).otherwise(F.col("hash")))
    return graph.route(m.where("doc_id % 10 <> 2").select("id", "hash"), found.select("id", "hash"))


@query("SELECT count(*) FILTER (doc_id % 10 IN (1, 2)) AS indexed, count(*) FILTER (doc_id % 10 > 2) AS unchanged, count(*) FILTER (doc_id % 10 = 0) AS removed FROM documents")
def index_report(spark, sf):
    r = incremental_routing(spark, sf)
    n = lambda a, name: F.sum((F.col("action") == a).cast("long")).alias(name)
    return r.agg(n("build", "indexed"), n("unchanged", "unchanged"), n("removed", "removed"))


@query("SELECT source AS id, arg_max(lang, doc_id) AS lang, max(doc_id) AS doc_id FROM documents GROUP BY source")
def upsert_last_wins(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("source").alias("id"), "lang", "doc_id", F.col("doc_id").alias("seq"))
    return graph.last_wins(d, ["id"], "seq").select("id", "lang", "doc_id")


@query("SELECT source AS id, arg_min(doc_id, doc_id) AS name, coalesce(arg_min(lang, doc_id) FILTER (lang <> 'en'), '') AS type FROM documents GROUP BY source")
def entity_fill_if_empty(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("name"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("type"), F.col("doc_id").alias("seq"))
    return graph.fill_if_empty(d, "id", "seq", ["name"], ["type"])


@query("SELECT DISTINCT source, lang FROM documents")
def link_ignore(spark, sf):
    d = _t(spark, sf, "documents").select("source", "lang")
    return graph.insert_ignore(d.where("lang = 'en'").distinct(), d, ["source", "lang"])


_DUAL = _with(_BASE, _NAMES, _GRAPH, _EMBED) + """, hits AS (SELECT id, row_number() OVER (ORDER BY d, id) AS rank FROM dist QUALIFY rank <= 8),
seeds AS (SELECT id FROM hits)""" + _EXPAND + """, g AS (SELECT id, row_number() OVER (ORDER BY hop, id) AS rank FROM reach WHERE id IN (SELECT id FROM chunks)),
fused AS (SELECT id, sum(s) AS score FROM (SELECT id, 1.0::DOUBLE / (60 + rank) AS s FROM hits UNION ALL SELECT id, 0.5::DOUBLE / (60 + rank) FROM g) GROUP BY id),
capped AS (SELECT id, substr(id, 1, 18) AS doc_id, score FROM fused QUALIFY row_number() OVER (PARTITION BY substr(id, 1, 18) ORDER BY score DESC, id) <= 2),
found AS (SELECT id, doc_id, score, id NOT IN (SELECT id FROM hits) AS from_graph FROM capped ORDER BY capped.score DESC, id LIMIT 8)"""


def _dual(spark, sf):
    c, v, n, e = _of(spark, sf, "chunks", "vectors", "nodes", "edges")
    return retrieve.dual(c, _asked(spark, v), n, e, F.col("qv"), digits=9)


@query(_DUAL + " SELECT found.id, found.doc_id, round(score, 9) AS score, from_graph, text, 'source/' || docs.doc_id || '.md' AS source_path, '' AS heading_path FROM found JOIN (SELECT id, text FROM chunks) USING (id) JOIN (SELECT did, doc_id FROM docs) docs ON docs.did = found.doc_id")
def dual_retrieve(spark, sf):
    return retrieve.contexts(_dual(spark, sf).withColumn("score", F.round("score", 9)), _of(spark, sf, "chunks")[0])


@query(_DUAL + ", seeds2 AS (SELECT id FROM found), inside AS (SELECT id FROM seeds2 UNION SELECT dst FROM around WHERE src IN (SELECT id FROM seeds2)) SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM inside) AND dst IN (SELECT id FROM inside)")
def dual_subgraph(spark, sf):
    return graph.subgraph(*_graph(spark, sf), graph.cut(_dual(spark, sf)))[1]


@query(_DUAL + ", v8 AS (SELECT id FROM hits) SELECT coalesce(found.id, v8.id) AS id, CASE WHEN v8.id IS NULL THEN 'added' WHEN found.id IS NULL THEN 'lost' ELSE 'both' END AS side FROM found FULL JOIN v8 ON v8.id = found.id")
def ab_compare(spark, sf):
    v = _asked(spark, _of(spark, sf, "vectors")[0])
    return retrieve.compared(retrieve.nearest(v, F.col("qv"), 8, digits=9), _dual(spark, sf))


@query(_with(_BASE, _EMBED) + " SELECT id, round(1 / (1 + d), 6) AS score FROM dist ORDER BY d, id LIMIT 8")
def vector_only(spark, sf):
    near = retrieve.nearest(_asked(spark, _of(spark, sf, "vectors")[0]), F.col("qv"), 8, digits=9)
    return near.select("id", F.round(retrieve.score(F.col("distance")), 6).alias("score"))


@query(_with(_BASE, _NAMES, _EVENTS) + " SELECT entity_id, name FROM seed_e")
def sag_seed_entities(spark, sf):
    grams, entities = _of(spark, sf, "event_grams", "event_nodes")
    return names.match(grams, entities, TOKENS).select("entity_id", "name")


@query(_with(_BASE, _NAMES, _EVENTS) + " SELECT id, hop FROM ev")
def sag_expand(spark, sf):
    links, entities = _of(spark, sf, "event_entities", "event_nodes")
    seeds = links.join(retrieve.match_entities(entities, TOKENS), "entity_id", "left_semi").select(F.col("event_id").alias("id"))
    return retrieve.expand_events(links, seeds, 1)


_RANKED = r""", sh AS (SELECT event_id AS id, count(*) AS shared, array_to_string(list_sort(list(entity_id)), ',') AS via FROM links WHERE entity_id IN (SELECT entity_id FROM seed_e) GROUP BY 1),
rows AS (SELECT 'ev_' || substr(sha256(id), 1, 16) AS id, id AS chunk_id, array_to_string(list_slice(regexp_extract_all(text, '[\p{L}\p{N}_]+'), 1, 5), ' ') AS title FROM chunks),
words AS (SELECT id, chunk_id, title, trim(regexp_replace(lower(title), '[^\p{L}\p{N}_]+', ' ', 'g')) AS t FROM rows),
r AS (SELECT ev.id, hop, coalesce(shared, 0) AS shared, CAST(len(list_intersect(list_distinct(string_split(t, ' ')), ['ument', 'bleth', 'of'])) AS BIGINT) AS overlap, coalesce(via, '') AS connected_via, chunk_id, title FROM ev JOIN words USING (id) LEFT JOIN sh USING (id)),
top AS (SELECT id, hop, shared, overlap, CAST(shared + overlap AS DOUBLE) AS score, connected_via, chunk_id, title FROM r ORDER BY shared DESC, overlap DESC, hop, id LIMIT 8)"""


def _ranked_events(spark, sf, hops=1, query=None):
    events, links, entities = _of(spark, sf, "events", "event_entities", "event_nodes")
    return retrieve.retrieve_events(events if query is None else _asked(spark, events), links, entities, TOKENS, 8, hops, query, digits=9)


@query(_with(_BASE, _NAMES, _EVENTS) + _RANKED + " SELECT id, hop, shared, overlap, score, connected_via FROM top")
def sag_rank_lexical(spark, sf):
    return _ranked_events(spark, sf).withColumn("connected_via", F.array_join("connected_via", ","))


@query(_with(_BASE, _NAMES, _EVENTS) + _RANKED + ", has AS (SELECT event_id AS id, array_to_string(list_sort(list(DISTINCT entity_id)), ',') AS entities FROM links GROUP BY 1) SELECT top.id, title, chunk_id, (SELECT text FROM chunks WHERE chunks.id = chunk_id) AS content, 'source/' || docs.doc_id || '.md' AS source_path, '' AS heading_path, entities FROM top JOIN has USING (id) JOIN docs ON docs.did = substr(chunk_id, 1, 18)")
def sag_contexts(spark, sf):
    events, links, chunks = _of(spark, sf, "events", "event_entities", "chunks")
    found = retrieve.event_contexts(_ranked_events(spark, sf).select("id"), events, links, chunks)
    return found.withColumn("entities", F.array_join("entities", ","))


@query(_with(_BASE, _NAMES, _EVENTS) + _RANKED + " SELECT DISTINCT event_id AS src, entity_id AS dst, 'has_entity' AS type FROM links WHERE event_id IN (SELECT id FROM top)")
def sag_graph(spark, sf):
    events, links, entities = _of(spark, sf, "events", "event_entities", "event_nodes")
    return retrieve.event_graph(graph.cut(_ranked_events(spark, sf)), events, links, entities)[1]


@query(_with(_BASE, _NAMES, _EMBED, _EVENTS) + """, cos AS (SELECT 'ev_' || substr(sha256(id), 1, 16) AS id, CASE WHEN list_dot_product(vector, vector) = 0 THEN 0 ELSE list_cosine_similarity(vector, qv) END AS c FROM vectors, q WHERE id IN (SELECT chunk_id FROM named)),
near AS (SELECT id FROM cos ORDER BY round(c, 9) DESC, id LIMIT 10), t0 AS (SELECT id FROM s0 UNION SELECT id FROM near),
t1 AS (SELECT DISTINCT b.event_id AS id FROM links a JOIN links b USING (entity_id) WHERE a.event_id IN (SELECT id FROM t0) AND b.event_id NOT IN (SELECT id FROM t0)),
tv AS (SELECT id, 0 AS hop FROM t0 UNION ALL SELECT id, 1 FROM t1) SELECT id, hop, round(c, 6) AS score FROM tv JOIN cos USING (id) ORDER BY round(c, 9) DESC, hop, id LIMIT 8""")
def sag_rank_vector(spark, sf):
    return _ranked_events(spark, sf, query=F.col("qv")).select("id", "hop", F.round("score", 6).alias("score"))


# Markdown files of nations, regions and suppliers. What they hold follows from their keys, so that the SQL need not parse.
_NATION = "'---\ntitle: ' || n_name || '\ntags: [nation, k' || n_nationkey % 5 || ']\n---\nIntro of ' || n_name || '.\n\n# Nation ' || n_nationkey || '\nSee [[r' || n_regionkey || '#Facts|its region]] and [next](n' || (n_nationkey + 1) || '.md).\n\n```\n[[decoy]] #decoy\n```\n## Notes\nText #note' || n_nationkey % 3 || ' and `#code` with [[nowhere' || n_nationkey || ']].\n'"
_REGION = "'# Region\nOverview\n## Facts\nLinks [home](../nations/n' || r_regionkey || '.md#Notes) [web](https://x.org) [self](#facts)\n'"
_SUPPLIER = "'# Supplier ' || s_suppkey || '\nFrom [[n' || s_nationkey || ']] #supplier\n'"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda table, path, body: _t(spark, sf, table).select(F.expr(path).alias("path"), F.expr(body).alias("text"))
    return (
        part("nation", "'nations/n' || n_nationkey || '.md'", _NATION)
        .union(part("region", "'regions/r' || r_regionkey || '.md'", _REGION))
        .union(part("supplier", "'suppliers/s' || s_suppkey || '.md'", _SUPPLIER))
    )


_MD = """WITH d AS (SELECT 'n' || n_nationkey AS key, 'd_' || substr(sha256('nations/n' || n_nationkey || '.md'), 1, 16) AS did, 'nations/n' || n_nationkey || '.md' AS path FROM nation
    UNION ALL SELECT 'r' || r_regionkey, 'd_' || substr(sha256('regions/r' || r_regionkey || '.md'), 1, 16), 'regions/r' || r_regionkey || '.md' FROM region
    UNION ALL SELECT 's' || s_suppkey, 'd_' || substr(sha256('suppliers/s' || s_suppkey || '.md'), 1, 16), 'suppliers/s' || s_suppkey || '.md' FROM supplier),
sec AS (SELECT did, unnest([0, 1, 2]) AS i, unnest([0, 1, 2]) AS level, unnest(['', 'Nation ' || substr(key, 2), 'Nation ' || substr(key, 2) || ' > Notes']) AS section_path, unnest([NULL, NULL, 1]) AS parent FROM d WHERE key LIKE 'n%'
    UNION ALL SELECT did, unnest([0, 1]), unnest([1, 2]), unnest(['Region', 'Region > Facts']), unnest([NULL, 0]) FROM d WHERE key LIKE 'r%'
    UNION ALL SELECT did, 0, 1, 'Supplier ' || substr(key, 2), NULL FROM d WHERE key LIKE 's%'),
l AS (SELECT d.did || '_s1_c0' AS src, t.did || '_s1' AS dst, '[[r' || n_regionkey || '#Facts|its region]]' AS raw, d.did AS doc FROM nation JOIN d ON d.key = 'n' || n_nationkey JOIN d t ON t.key = 'r' || n_regionkey
    UNION ALL SELECT d.did || '_s1_c0', t.did, '[next](n' || (n_nationkey + 1) || '.md)', d.did FROM nation JOIN d ON d.key = 'n' || n_nationkey LEFT JOIN d t ON t.key = 'n' || (n_nationkey + 1)
    UNION ALL SELECT did || '_s2_c0', NULL, '[[nowhere' || substr(key, 2) || ']]', did FROM d WHERE key LIKE 'n%'
    UNION ALL SELECT d.did || '_s1_c0', t.did || '_s2', '[home](../nations/n' || r_regionkey || '.md#Notes)', d.did FROM region JOIN d ON d.key = 'r' || r_regionkey JOIN d t ON t.key = 'n' || r_regionkey
    UNION ALL SELECT did || '_s1_c0', did || '_s1', '[self](#facts)', did FROM d WHERE key LIKE 'r%'
    UNION ALL SELECT d.did || '_s0_c0', t.did, '[[n' || s_nationkey || ']]', d.did FROM supplier JOIN d ON d.key = 's' || s_suppkey JOIN d t ON t.key = 'n' || s_nationkey),
tg AS (SELECT did AS src, unnest(['nation', 'k' || CAST(substr(key, 2) AS INT) % 5]) AS name FROM d WHERE key LIKE 'n%' UNION ALL SELECT did || '_s2_c0', 'note' || CAST(substr(key, 2) AS INT) % 3 FROM d WHERE key LIKE 'n%' UNION ALL SELECT did || '_s0_c0', 'supplier' FROM d WHERE key LIKE 's%' UNION ALL SELECT did || '_s1_c0', 'facts' FROM d WHERE key LIKE 'r%'),
nodes AS (SELECT did AS id, 'document' AS type FROM d UNION ALL SELECT did || '_s' || i, 'section' FROM sec UNION ALL SELECT did || '_s' || i || '_c0', 'chunk' FROM sec UNION ALL SELECT DISTINCT 't_' || substr(sha256(name), 1, 16), 'tag' FROM tg),
edges AS (SELECT CASE WHEN parent IS NULL THEN did ELSE did || '_s' || parent END AS src, did || '_s' || i AS dst, 'contains' AS type FROM sec UNION ALL SELECT did || '_s' || i, did || '_s' || i || '_c0', 'contains' FROM sec
    UNION ALL SELECT DISTINCT src, dst, 'links_to' FROM l WHERE dst IS NOT NULL UNION ALL SELECT DISTINCT src, 't_' || substr(sha256(name), 1, 16), 'tagged' FROM tg)"""
_NODE0 = "'d_' || substr(sha256('nations/n0.md'), 1, 16) || '_s1_c0'"


@query(_MD + " SELECT did AS doc_id, i AS sec_idx, level, section_path, parent AS parent_idx FROM sec")
def md_sections(spark, sf):
    return markdown.section_table(markdown.parse(_files(spark, sf))).select("doc_id", "sec_idx", "level", "section_path", "parent_idx")


@query(_MD + " SELECT src, dst, raw FROM l WHERE dst IS NOT NULL")
def md_links_resolved(spark, sf):
    parsed = markdown.parse(_files(spark, sf))
    found = markdown.section_table(parsed)
    return markdown.resolve_links(parsed, found, markdown.section_chunks(found)).where("dst is not null").select("src", "dst", "raw")


@query(_MD + " SELECT src, raw FROM l WHERE dst IS NULL")
def md_links_unresolved(spark, sf):
    return index.unresolved(spark, _index(spark, sf, "files")).select("src", "raw")


@query(_MD + " SELECT src, dst, type FROM edges WHERE type = 'tagged'")
def md_tag_edges(spark, sf):
    return _graph(spark, sf, "files")[1].where("type = 'tagged'")


@query(_MD + " SELECT id, type FROM nodes")
def md_nodes(spark, sf):
    return _graph(spark, sf, "files")[0].select("id", "type")


@query(_MD + " SELECT src, dst, type FROM edges")
def md_edges(spark, sf):
    return _graph(spark, sf, "files")[1]


@query(_MD + f" SELECT 'out' AS direction, dst AS id, type AS edge_type FROM edges WHERE src = {_NODE0} UNION ALL SELECT 'in', src, type FROM edges WHERE dst = {_NODE0}")
def node_detail(spark, sf):
    node = spark.range(1).select(F.concat(ids.doc_id(F.lit("nations/n0.md")), F.lit("_s1_c0"))).first()[0]
    return graph.detail(_graph(spark, sf, "files")[1], node)


@query(_MD + " SELECT DISTINCT doc AS doc_id, dst AS linked FROM l WHERE dst IN (SELECT did FROM d) AND dst <> doc")
def document_links(spark, sf):
    return graph.document_links(*_graph(spark, sf, "files"))


@query(_MD + " SELECT '{\"src\":\"' || src || '\",\"dst\":\"' || dst || '\",\"type\":\"' || type || '\"}' AS json FROM edges")
def export_edges(spark, sf):
    return graph.export(*_of(spark, sf, "nodes", "edges", kind="files"))[1]


@query(_MD + " SELECT id, type FROM nodes")
def export_nodes(spark, sf):
    lines = graph.export(*_of(spark, sf, "nodes", "edges", kind="files"))[0]
    return lines.select(F.get_json_object("json", "$.id").alias("id"), F.get_json_object("json", "$.type").alias("type"))


@query(_MD + ", kept AS (SELECT id FROM nodes ORDER BY id LIMIT 60) SELECT (SELECT count(*) FROM kept) AS kept, (SELECT count(*) FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)) AS edges, (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM nodes) > 60 AS truncated")
def graph_truncated(spark, sf):
    kept, inside, total = graph.truncated(*_graph(spark, sf, "files"), 60)
    return kept.agg(F.count("*").alias("kept")).crossJoin(inside.agg(F.count("*").alias("edges"))).crossJoin(total)  # of one row each


@query(_MD + f""", around AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), h0 AS (SELECT {_NODE0} AS id), h1 AS (SELECT id FROM h0 UNION SELECT dst FROM around WHERE src IN (SELECT id FROM h0)),
h2 AS (SELECT id FROM h1 UNION SELECT dst FROM around WHERE src IN (SELECT id FROM h1)) SELECT id, type FROM nodes WHERE id IN (SELECT id FROM h2)""")
def graph_expand_induced(spark, sf):
    n, e = _graph(spark, sf, "files")
    seeds = spark.range(1).select(F.concat(ids.doc_id(F.lit("nations/n0.md")), F.lit("_s1_c0")).alias("id"))
    return graph.expand_and_induce(n, e, seeds, 1)[0].select("id", "type")


@query(_with(_BASE) + """ SELECT id, chunks.doc_id, CAST(s AS INT) AS char_start, CAST(row_number() OVER (ORDER BY id) AS INT) AS place FROM chunks
JOIN (SELECT did FROM docs ORDER BY n DESC, doc_id LIMIT 1) ON did = chunks.doc_id""")
def document_chunks(spark, sf):
    """The chunks of the longest document in the order of their ids as text, in which the tenth comes before the second."""
    longest = _t(spark, sf, "documents").orderBy(F.desc(F.length("text")), "doc_id").limit(1)
    doc = corpus.from_table(longest).select(ids.doc_id(F.col("path"))).first()
    found = store.chunks_of(_of(spark, sf, "chunks")[0], doc[0] if doc else "")
    return graph.ranked(found, "id", name="place").select("id", "doc_id", "char_start", "place")


@query(_with(_BASE) + " SELECT id, sha256(text) AS digest FROM chunks WHERE id IN (SELECT did || '_s0_c0' FROM docs WHERE doc_id % 7 = 0)")
def chunk_lookup(spark, sf):
    wanted = _t(spark, sf, "documents").where("doc_id % 7 = 0").select(F.concat(ids.doc_id(F.concat(F.lit("source/"), F.col("doc_id").cast("string"), F.lit(".md"))), F.lit("_s0_c0")).alias("id"))
    return store.lookup(_of(spark, sf, "chunks")[0], wanted).select("id", F.sha2("text", 256).alias("digest"))


@query(_MD + " SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM sec) AS chunks, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM sec) AS vectors")
def index_stats(spark, sf):
    return index.stats(spark, _index(spark, sf, "files"))


@query("""SELECT (SELECT count(*) FROM nation WHERE n_nationkey % 5 IN (1, 2)) AS indexed, (SELECT count(*) FROM region) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation WHERE n_nationkey % 5 IN (3, 4)) AS unchanged,
(SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0) AS removed""")
def index_incremental(spark, sf):
    """A second build: nations of remainder 0 are gone, those of 1 changed, those of 2 new."""
    root, files = f"{scratch.shared_dir(spark)}/index-{uuid.uuid4().hex}", _files(spark, sf)
    of = F.when(F.col("path").startswith("nations/"), F.regexp_extract("path", "n([0-9]+)[.]", 1).cast("int") % 5).otherwise(4)
    index.build(spark, files.where(of != 2), root, semantic=False)
    report = index.build(spark, files.where(of != 0).withColumn("text", F.when(of == 1, F.concat("text", F.lit("more\n"))).otherwise(F.col("text"))), root, semantic=False)
    return report.select("indexed", "unchanged", "removed")


#: Of each supplier a text: two paragraphs longer than a window, a long run of short ones, and blank lines with spaces.
_PARAGRAPHS = "repeat('a', 700) || '\n\n' || repeat('b', 600 + s_suppkey % 700) || '\n \n' || repeat('c' || chr(10) || chr(10), s_suppkey % 300) || repeat('d', 1300 + s_suppkey % 2000) || '\n\n' || s_name"


@query(
    f"""WITH RECURSIVE t AS (SELECT s_suppkey, {_PARAGRAPHS} AS body FROM supplier),
ends AS (SELECT s_suppkey, body, unnest(list_append(list_filter(generate_series(1, length(body)), lambda i: i > 1 AND substr(body, i, 1) = chr(10) AND (substr(body, i - 1, 1) = chr(10) OR (i > 2 AND substr(body, i - 2, 3) = chr(10) || ' ' || chr(10))) AND (i < 4 OR substr(body, i - 2, 2) <> chr(10) || chr(10) OR substr(body, i, 1) <> chr(10))), length(body))) AS e FROM t),
p AS (SELECT DISTINCT s_suppkey, e FROM ends),
spans AS (SELECT s_suppkey, row_number() OVER w AS n, coalesce(lag(e) OVER w, 0) AS s, e FROM p WINDOW w AS (PARTITION BY s_suppkey ORDER BY e)),
walk AS (SELECT s_suppkey, n, s, e, s AS cs FROM spans WHERE n = 1
    UNION ALL SELECT b.s_suppkey, b.n, b.s, b.e, CASE WHEN b.e - b.s > 1200 OR a.e - a.s > 1200 OR b.e - a.cs > 1200 THEN b.s ELSE a.cs END FROM walk a JOIN spans b ON b.s_suppkey = a.s_suppkey AND b.n = a.n + 1),
packed AS (SELECT s_suppkey, cs AS s, max(e) AS e FROM walk GROUP BY s_suppkey, cs),
cut AS (SELECT s_suppkey, s + i * 1200 AS s, least(e, s + (i + 1) * 1200) AS e FROM packed, range(0, 100) r(i) WHERE s + i * 1200 < e)
SELECT s_suppkey, CAST(CASE WHEN s = 0 THEN 0 ELSE s - 150 END AS INT) AS char_start, CAST(e AS INT) AS char_end FROM cut"""
)
def paragraph_windows(spark, sf):
    rows = _t(spark, sf, "supplier").select("s_suppkey", F.expr(_PARAGRAPHS).alias("body"))
    return rows.select("s_suppkey", F.explode(text.windows("body")).alias("w")).select("s_suppkey", F.col("w.s").alias("char_start"), F.col("w.e").alias("char_end"))
