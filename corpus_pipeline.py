"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Stages decide row by row. Rows that agree in doc_id and text are one document: they stay or go together, with a null
doc_id too. Null and empty texts are neither toxic nor near-duplicates nor contaminated, and stay. Columns besides
those of documents are dropped by the first stage. Empty tables give empty results.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import decontaminate, minhash_dedup, packing, pii, toxicity
from quillmesh.llm.common import discard, drop_written, tables_written, written
from quillmesh.llm.queries import table, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_LEFT: list[str] = []


def _stage(function):
    """A stage that first deletes the intermediate tables of the stages before it in a run: their results are stored
    by then. Tables that docs still reads (if it wasn't stored) stay."""

    @wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if function.__name__ == STAGES[0][1].__name__:
            _LEFT.clear()  # of another run, whose last result may still be read
        drop_written(spark, _LEFT, keep=docs)
        before = set(tables_written())
        out = function(spark, docs, sf_dir)
        _LEFT[:] = [p for p in tables_written() if p in _LEFT or p not in before]
        return out

    return stage


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text_key aren't listed; null ids are compared like others."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left_anti").select(*COLUMNS)


@_stage
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects (score of one half or more) go."""
    keyed = _keyed(docs)
    scored = toxicity.toxicity(keyed, table(spark, sf_dir, "labels"), carry=("text_key",))
    return _without(keyed, scored.where("predicted = 1"))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of least id stays (of several texts with that id, the one whose
    hash is least); documents without an id or without words are in no group."""
    keyed = _keyed(docs)
    found = written(minhash_dedup.near_duplicates(keyed, carry=("text_key",)).where("doc_id is not null and n_shingles > 0"))
    several = found.where("kept").groupBy("doc_id", "component_id").agg(F.min("text_key").alias("least"), F.max("text_key").alias("most")).where("least <> most")
    more = found.where("kept").join(several, ["doc_id", "component_id"]).where("text_key <> least")
    return _without(keyed, found.where("not kept").select("doc_id", "text_key").unionByName(more.select("doc_id", "text_key")))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS[1:])
    return found.where("not contaminated").select(*COLUMNS)


@_stage
def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers, plain or disguised, give way to their kinds; n_chars follows the text."""
    new = pii.redact(docs.select(*COLUMNS))
    return new.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*COLUMNS)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", redaction),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the first stage's model, and so not the rows of run(); tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; each one's result is written to the shared folder and read again."""
    docs, stored = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        discard(*stored)
        stored = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
