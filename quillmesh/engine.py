"""The engine at one place: an index on disk, the providers to build it with, and what it is asked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids, providers, text
from .operators import batch, graph, index, names, retrieve
from .sources import corpus, store


@dataclass
class Offline:
    """Embeds by the offline rule, in Spark itself."""

    dim: int = 16


@dataclass
class Engine:
    """An index at root. Without an embedder it is built without vectors' use: questions by vector raise."""

    spark: SparkSession
    root: str
    embedder: Offline | providers.Embedder | None = None
    extractor: providers.Extractor | None = None
    events: providers.EventExtractor | None = None

    def _model(self) -> dict:
        return {"dim": self.embedder.dim} if isinstance(self.embedder, Offline) else {"embedder": self.embedder}

    def build(self, folders: str | list[str] | None = None, files: DataFrame | None = None, exclude: tuple[str, ...] = (), **options) -> DataFrame:
        """index.build() of folders, or of files as a table (path, text)."""
        given = corpus.from_files(self.spark, folders, exclude) if files is None else files
        return index.build(self.spark, given, self.root, extractor=self.extractor, **self._model(), **options)

    def build_events(self, full: bool = False) -> DataFrame:
        return index.build_events(self.spark, self.root, self.events, full=full, **self._model())

    def _table(self, name: str) -> DataFrame:
        found = store.load(self.spark, self.root, name)
        if found is None:
            raise ValueError(f"the index has no {name}")
        return found

    def _asked(self, queries: DataFrame, column: str = "text") -> DataFrame:
        """(qid, text) -> (qid, query): blank texts have no query."""
        if self.embedder is None:
            raise RuntimeError("no embedder is configured")
        own = queries.select("qid", F.when(F.trim(F.regexp_replace(column, r"\s+", " ")) != "", F.col(column)).alias("text")).where("text is not null")
        if isinstance(self.embedder, Offline):
            return own.select("qid", text.embed(F.col("text"), self.embedder.dim).alias("query"))
        return providers.embed_with(own, self.embedder).where("error is null").select("qid", F.col("vector").alias("query"))

    def retrieve_all(self, queries: DataFrame, k: int = 8, **options) -> DataFrame:
        """Dual retrieval for a table of queries (qid, text): (qid, id, doc_id, score, from_graph, text, source_path,
        heading_path). Blank texts find nothing; k must be at least 1."""
        if k < 1:
            raise ValueError("k is at least 1")
        asked = self._asked(queries)
        chunks = self._table("chunks")
        found = batch.dual(asked, chunks, index.vectors(self.spark, self.root, **self._model()), self._table("nodes"), self._table("edges"), k, **options)
        own = chunks.select("id", "text", F.col("path").alias("source_path"), F.col("section_path").alias("heading_path"))
        return found.join(own, "id", "left").select("qid", "id", "doc_id", "score", "from_graph", *(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "source_path", "heading_path")))

    def retrieve(self, question: str, k: int = 8, **options) -> DataFrame:
        """retrieve_all() for one text, by falling score."""
        one = self.spark.createDataFrame([(0, question)], "qid int, text string")
        return self.retrieve_all(one, k, **options).drop("qid").orderBy(F.desc("score"), "id")

    def retrieve_events(self, question: str, k: int = 8, max_hops: int = 2) -> DataFrame:
        """Events by the entities that a text names and, with an embedder, by vector; empty before events are built. Names
        are found by their grams."""
        events = store.load(self.spark, self.root, "events")
        empty = "id string, hop int, shared long, overlap long, score double, connected_via array<string>"
        if events is None or not (question or "").strip() or events.isEmpty():
            return self.spark.createDataFrame([], empty)
        words = self.spark.createDataFrame([(question,)], "q string").select(ids.normalize_name(F.col("q"))).first()[0]
        tokens = list(dict.fromkeys(t for t in words.split(" ") if len(t) > 1))
        links, entities = self._table("event_entities"), self._table("event_nodes")
        named = names.match(self._table("event_grams"), entities, tokens)
        query = None
        if self.embedder is not None:
            asked = self._asked(self.spark.createDataFrame([(0, question)], "qid int, text string"))
            events = events.crossJoin(F.broadcast(asked.select(F.col("query").cast("array<double>").alias("qv")).limit(1)))  # of one row
            events = events.where(F.col("model") == index.vector_table(**self._model()))
            query = F.col("qv")
        return retrieve.retrieve_events(events, links, entities, tokens, k, max_hops, query, named=named)

    def documents(self) -> DataFrame:
        """(id, path, hash, n_chunks), by id."""
        n = self._table("chunks").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_chunks"))
        return self._table("documents").select("id", "path", "hash").join(n, "id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("long"))).orderBy("id")

    def document(self, doc_id: str) -> dict | None:
        return store.get(self.spark, self.root, "documents", doc_id)

    def node(self, node_id: str) -> dict | None:
        return store.get(self.spark, self.root, "nodes", node_id)

    def chunk(self, chunk_id: str) -> dict | None:
        return store.get(self.spark, self.root, "chunks", chunk_id)

    def neighbours(self, node_id: str) -> DataFrame:
        return graph.detail(self._table("edges"), node_id)

    def stats(self) -> dict[str, int]:
        """Numbers of documents, chunks, nodes, edges and, with an embedder, vectors."""
        tables = ["documents", "chunks", "nodes", "edges"]
        counted = dict(zip(tables, store.at_once(lambda t: self._table(t).count(), tables), strict=True))
        return counted | ({"vectors": index.vectors(self.spark, self.root, **self._model()).count()} if self.embedder is not None else {})
