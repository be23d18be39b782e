"""Registered queries of sources, interval joins, indexes for look-ups, table functions and tables of queries."""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, providers, tables, text
from ..operators import batch, clusters, graph, names
from ..operators.interval import first_range, interval_join
from ..sources import corpus, files, scratch
from .catalogue import _BASE, _EMBED, _EVENTS, _GRAPH, _MD, _NAMES, TOKENS, _chunks, _files, _graph, _of, _t, _with, registry

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
query = registry(Q, SQL)


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """Every 170th place of each document."""
    docs = _t(spark, sf, "documents").where("length(text) > 0")
    at = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(170))).alias("place")
    return docs.select(ids.doc_id(F.concat(F.lit("source/"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("doc_id"), at)


_AT = ", pl AS (SELECT did AS doc_id, unnest(generate_series(0, n - 1, 170)) AS place FROM docs WHERE n > 0)"


@query(_with(_BASE, _AT) + " SELECT doc_id, CAST(place AS INT) AS place, id FROM pl JOIN chunks USING (doc_id) WHERE s <= place AND place < e")
def chunks_at_places(spark, sf):
    """All chunks that hold a place: two where they overlap."""
    return interval_join(_places(spark, sf), _chunks(spark, sf).select("doc_id", "id", "char_start", "char_end"), ["doc_id"], "place", "char_start", "char_end", 1200).select("doc_id", "place", "id")


@query(_with(_BASE, _AT) + " SELECT pl.doc_id, CAST(place AS INT) AS place, arg_min(id, i) AS id FROM pl LEFT JOIN chunks ON chunks.doc_id = pl.doc_id AND s <= place AND place < e GROUP BY ALL")
def first_chunk_at_place(spark, sf):
    chunks = _chunks(spark, sf).select("doc_id", "id", "char_start", "char_end", "chunk_idx")
    return first_range(_places(spark, sf), chunks, ["doc_id"], "place", "char_start", "char_end", 1200, "chunk_idx", "id", "found").select("doc_id", "place", F.col("found").alias("id"))


def _packed(t: pa.Table, to: str) -> pa.Table:
    """Documents (doc_id, text, n) of one number as an archive below `to`: a zip for even numbers, a tar.gz for others."""
    n, out = t.column("n")[0].as_py(), io.BytesIO()
    members = [(f"d/{i}.md", (x or "").encode()) for i, x in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True)]
    if n % 2 == 0:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in members:
                z.writestr(name, body)
    else:
        with tarfile.open(fileobj=out, mode="w:gz") as z:
            for name, body in members:
                m = tarfile.TarInfo(name)
                m.size = len(body)
                z.addfile(m, io.BytesIO(body))
    system, at = files.opened(f"{to}/{n}")
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(out.getvalue())
    return pa.table({"path": [f"{to}/{n}"]})


@query(r"SELECT 'd/' || doc_id || '.md' AS path, sha256(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS hash FROM documents")
def archive_members(spark, sf):
    """Documents, packed by tasks into archives of 20, and read back by the archive source."""
    to = f"{scratch.shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    docs = _t(spark, sf, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 20).alias("n"))
    paths = scratch.cut(docs.groupBy("n").applyInArrow(lambda t: _packed(t, to), "path string"))
    return corpus.from_archive_table(paths, file_bytes=1 << 30, total_bytes=1 << 34).select("path", "hash")


def _laid(batches: Iterator[pa.RecordBatch], to: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, body in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
            system, at = files.opened(f"{to}/{path}")
            system.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(at) as f:
                f.write(body.encode())
        yield b.select(["path"])


@query("""SELECT 'r' || s_nationkey % 5 || '/' || ['', '_', '.'][1 + s_suppkey % 3] || 's' || s_suppkey || '.md' AS path, sha256('# ' || s_name || chr(10)) AS hash FROM supplier WHERE s_nationkey % 5 <> 4""")
def folder_listing(spark, sf):
    """Suppliers as files, laid down by tasks in folders, names hidden by _ and . among them; a folder is left out."""
    to = f"{scratch.shared_dir(spark)}/folders-{uuid.uuid4().hex}"
    path = F.expr("'r' || s_nationkey % 5 || '/' || element_at(array('', '_', '.'), cast(1 + s_suppkey % 3 AS int)) || 's' || s_suppkey || '.md'")
    rows = _t(spark, sf, "supplier").select(path.alias("path"), F.concat(F.lit("# "), "s_name", F.lit("\n")).alias("text"))
    rows.mapInArrow(partial(_laid, to=to), "path string").count()
    return corpus.from_files(spark, to, (f"{to}/r4",)).select("path", "hash")


def _clustered(spark: SparkSession, sf: str, metric: str) -> clusters.Found:
    v = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    path = f"{scratch.shared_dir(spark)}/clusters-{uuid.uuid4().hex}"
    clusters.write(v, path, metric=metric)
    asked = [list(map(float, r.vector)) for r in v.where("id = 0").limit(1).collect()]
    return clusters.search(spark, path, asked[0] if asked else [0.0], 8 if asked else 0)


_V0 = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), q AS (SELECT vector AS qv FROM v WHERE id = 0)"


@query(f"WITH {_V0}, d AS (SELECT id, list_sum(list_transform(list_zip(vector, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, q) SELECT id, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT 8")
def knn_l2_clustered(spark, sf):
    return _clustered(spark, sf, "l2").rows.select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_V0} SELECT id, round(list_cosine_similarity(vector, qv), 6) AS cosine FROM v, q ORDER BY list_cosine_similarity(vector, qv) DESC, id LIMIT 8")
def knn_cosine_clustered(spark, sf):
    return _clustered(spark, sf, "cosine").rows.select("id", F.round("cosine", 6).alias("cosine"))


#: Some tokens of one to eight letters; the last means any name with an o and, two letters on, a t.
_TOKENS = ["q", "zz", "ith", "tion", "ument", "bleth", "o_t"]


@query(_with(_BASE, _NAMES, _EVENTS) + ", m AS (SELECT entity_id, name FROM names WHERE " + " OR ".join(f"normal LIKE '%{t}%'" for t in _TOKENS) + ") SELECT entity_id, name FROM m ORDER BY entity_id LIMIT 400")
def name_matches(spark, sf):
    """Names by the substring index."""
    postings, entities = _of(spark, sf, "event_grams", "event_nodes")
    return names.match(postings, entities, _TOKENS, 400).select("entity_id", "name")


@query(_MD + " SELECT did AS doc_id, i AS sec_idx, level, section_path FROM sec")
def md_sections_sql(spark, sf):
    tables.register(spark)
    _files(spark, sf).createOrReplaceTempView("quillmesh_files")
    found = spark.sql("SELECT path, s.sec_idx, s.level, s.section_path FROM quillmesh_files, LATERAL markdown_sections(path, text) s")
    return found.select(ids.doc_id(F.col("path")).alias("doc_id"), "sec_idx", "level", "section_path")


@query(_MD + " SELECT doc AS doc_id, raw FROM l")
def md_links_sql(spark, sf):
    tables.register(spark)
    _files(spark, sf).createOrReplaceTempView("quillmesh_files")
    return spark.sql("SELECT path, l.raw FROM quillmesh_files, LATERAL markdown_links(path, text) l").select(ids.doc_id(F.col("path")).alias("doc_id"), "raw")


@query(_with(_BASE) + " SELECT doc_id, CAST(s AS INT) AS char_start, CAST(e AS INT) AS char_end FROM chunks")
def chunk_windows_sql(spark, sf):
    tables.register(spark)
    corpus.from_table(_t(spark, sf, "documents")).createOrReplaceTempView("quillmesh_documents")
    found = spark.sql("SELECT path, w.char_start, w.char_end FROM quillmesh_documents, LATERAL chunk_windows(text) w")
    return found.select(ids.doc_id(F.col("path")).alias("doc_id"), "char_start", "char_end")


#: The questions of a batch: what the first 50 documents begin with.
_ASKED = r""", asked AS (SELECT doc_id AS qid, substr(text, 1, 60) AS q FROM documents WHERE doc_id < 50 AND trim(text, E' 
	
') <> ''),
hq AS (SELECT qid, list_transform(regexp_extract_all(lower(q), '[\p{L}\p{N}_]+'), lambda t: strpos('0123456789abcdef', substr(sha256(t), 64, 1)) - 1) AS h FROM asked),
cq AS (SELECT qid, list_transform(range(0, 16), lambda i: CAST(len(list_filter(h, lambda x: x = i)) AS DOUBLE)) AS v FROM hq),
qs AS (SELECT qid, CASE WHEN sqrt(list_dot_product(v, v)) = 0 THEN v ELSE list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) END AS qv FROM cq),
qd AS (SELECT qid, id, round(list_sum(list_transform(list_zip(vector, qs.qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS d FROM vectors, qs),
hits AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM qd QUALIFY rank <= 8),
b1 AS (SELECT DISTINCT qid, dst AS id FROM hits JOIN around ON src = id ANTI JOIN hits h ON h.qid = hits.qid AND h.id = dst),
b2 AS (SELECT DISTINCT b1.qid, dst AS id FROM b1 JOIN around ON src = b1.id ANTI JOIN hits h ON h.qid = b1.qid AND h.id = dst ANTI JOIN b1 g ON g.qid = b1.qid AND g.id = dst),
reached AS (SELECT qid, id, 1 AS hop FROM b1 UNION ALL SELECT qid, id, 2 FROM b2),
g AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY hop, id) AS rank FROM reached SEMI JOIN chunks USING (id)),
fused AS (SELECT qid, id, sum(s) AS score FROM (SELECT qid, id, 1.0::DOUBLE / (60 + rank) AS s FROM hits UNION ALL SELECT qid, id, 0.5::DOUBLE / (60 + rank) FROM g) GROUP BY ALL),
capped AS (SELECT qid, id, substr(id, 1, 18) AS doc_id, score FROM fused QUALIFY row_number() OVER (PARTITION BY qid, substr(id, 1, 18) ORDER BY score DESC, id) <= 2),
best AS (SELECT qid, id, doc_id, score FROM capped QUALIFY row_number() OVER (PARTITION BY qid ORDER BY capped.score DESC, id) <= 8)"""


@query(_with(_BASE, _NAMES, _GRAPH, _EMBED, _ASKED) + " SELECT qid, id, doc_id, round(score, 9) AS score, NOT EXISTS (SELECT 1 FROM hits WHERE hits.qid = best.qid AND hits.id = best.id) AS from_graph FROM best")
def dual_retrieve_batch(spark, sf):
    asked = _t(spark, sf, "documents").where(r"doc_id < 50 AND trim(BOTH ' \n\t\r' FROM text) <> ''").select(F.col("doc_id").alias("qid"), F.substring("text", 1, 60).alias("q"))
    asked = asked.select("qid", text.embed(F.col("q")).alias("query"))
    chunks, vectors = _of(spark, sf, "chunks", "vectors")
    # Distances that differ by rounding alone are ties, as in the SQL.
    return batch.dual(asked, chunks, vectors, *_graph(spark, sf), digits=9).withColumn("score", F.round("score", 9))


@query("""SELECT arg_max(l_comment, (l_orderkey, l_linenumber)) AS meta, l_suppkey % 7 AS src, l_partkey % 11 AS dst, l_returnflag AS type FROM (SELECT *, CAST(l_quantity AS VARCHAR) AS l_comment FROM lineitem) GROUP BY ALL""")
def upsert_edges(spark, sf):
    """Edges written again and again: of each (src, dst, type) the last one stays."""
    rows = _t(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("src"), (F.col("l_partkey") % 11).alias("dst"), F.col("l_returnflag").alias("type"), F.struct("l_orderkey", "l_linenumber").alias("seq"), F.col("l_quantity").cast("string").alias("meta")
    )
    return graph.last_wins(rows, ["src", "dst", "type"], "seq").select("src", "dst", "type", "meta")


@query("""WITH h AS (SELECT doc_id AS ord, 'source/' || CASE WHEN doc_id % 3 = 0 THEN -doc_id - 1 ELSE doc_id END || '.md' AS path, CASE WHEN doc_id % 5 = 1 THEN '  ' ELSE source END AS snippet FROM documents),
ok AS (SELECT * FROM h WHERE trim(snippet) <> '' AND path IN (SELECT 'source/' || doc_id || '.md' FROM documents) ORDER BY ord LIMIT 12)
SELECT path, snippet, (12 - row_number() OVER (ORDER BY ord) + 1) / 12 AS score FROM ok""")
def picked_passages(spark, sf):
    """A model's picks, some of them blank or of files that don't exist."""
    docs = _t(spark, sf, "documents")
    path = F.concat(F.lit("source/"), F.when(F.col("doc_id") % 3 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).cast("string"), F.lit(".md"))
    hits = docs.select(F.col("doc_id").alias("ord"), path.alias("path"), F.when(F.col("doc_id") % 5 == 1, "  ").otherwise(F.col("source")).alias("snippet"))
    return providers.known_hits(hits, corpus.from_table(docs), 12)
