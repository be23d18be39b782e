"""Corpora as DataFrames of (path, text), and their chunks."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from . import files
from .scratch import cut


def from_table(docs: DataFrame) -> DataFrame:
    """One file for each document of a table (doc_id, text): (path, text)."""
    return docs.select(F.concat(F.lit("source/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")


def _decoded(files: DataFrame) -> DataFrame:
    """files with content -> (text, hash, error and the rest): line ends become \\n before hashing; what isn't UTF-8 has an
    error and no text."""
    good = F.is_valid_utf8(F.col("content").cast("string"))
    body = F.when(good, F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n"))
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    rest = [c for c in files.columns if c not in ("content", "error")]
    return files.select(*rest, body.alias("text"), F.sha2(body, 256).alias("hash"), F.coalesce(error, F.when(~good, "not UTF-8")).alias("error"))


def from_files(spark: SparkSession, roots: str | list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """All *.md files below the roots (or roots themselves), each once: (path relative to the first root that holds it,
    text, hash, mtime, error), whatever their names begin with. Files below an excluded folder are left out, and roots
    that aren't there. A task for each folder; it must be able to open the roots (see sources.files)."""
    spark.dataSource.register(files.FolderSource)
    roots = [roots] if isinstance(roots, str) else list(roots)
    reader = spark.read.format("markdown_folders").option("roots", "\n".join(roots)).option("exclude", "\n".join(exclude))
    return _decoded(reader.load()).select("path", "text", "hash", "mtime", "error")


def from_spark_files(spark: SparkSession, roots: str | list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """from_files() for a store that only Spark's readers open; names with _ or . in front are hidden there."""
    roots = [roots] if isinstance(roots, str) else list(roots)
    inside = lambda folder: spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(roots)
    at = F.regexp_replace(F.col("path"), "^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?", "")
    found = found.withColumn("at", at).dropDuplicates(["at"])
    for folder in exclude:
        found = found.where(~F.col("at").startswith(inside(folder)))
    path = F.coalesce(*(F.when(F.col("at").startswith(inside(r)), F.substring("at", len(inside(r)) + 1, 1 << 20)) for r in roots), F.col("at"))
    own = found.select(path.alias("path"), "content", F.unix_timestamp("modificationTime").cast("double").alias("mtime"))
    return _decoded(own).select("path", "text", "hash", "mtime", "error")


def from_archives(spark: SparkSession, paths: str | list[str], entries: int = 5000, file_bytes: int = 5 << 20, total_bytes: int = 200 << 20) -> DataFrame:
    """Markdown members (.md, .markdown, any case) of zip and tar archives (plain, gz, bz2, xz) as files named .md:
    (archive, path, text, hash, error). The members of a zip archive are dealt to tasks.

    Raises for members with absolute paths, drives or "..", links and special files, two that become one file, and beyond
    the limits of an archive."""
    spark.dataSource.register(files.ArchiveSource)
    reader = spark.read.format("markdown_archives").option("paths", "\n".join([paths] if isinstance(paths, str) else paths))
    return _decoded(reader.option("entries", entries).option("fileBytes", file_bytes).option("totalBytes", total_bytes).load())


def from_archive_table(archives: DataFrame, entries: int = 5000, file_bytes: int = 5 << 20, total_bytes: int = 200 << 20, part_bytes: int = 16 << 20) -> DataFrame:
    """from_archives() for a table of archives (path), of any number: tasks list them too, and their parts are dealt to as
    many tasks as their bytes ask for, so that many small archives share a task and no path passes through the driver."""
    spark = archives.sparkSession
    options = {"entries": str(entries), "fileBytes": str(file_bytes), "totalBytes": str(total_bytes), "partitionBytes": str(part_bytes)}
    pieces = cut(archives.select("path").mapInArrow(partial(files.planned, options=options), files.PIECES))
    total = pieces.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    dealt = pieces.repartition(max(spark.sparkContext.defaultParallelism, -(-total // part_bytes)))
    return _decoded(dealt.mapInArrow(partial(files.unpacked, options=options), "archive string, path string, content binary"))


def chunks(corpus: DataFrame, max_chars: int = 1200, overlap: int = 150) -> DataFrame:
    """(path, text) of one section each -> (id, doc_id, sec_idx, chunk_idx, section_path, text, char_start, char_end)."""
    did = corpus.select(ids.doc_id(F.col("path")).alias("doc_id"), "text").withColumn("w", text.windows("text", max_chars, overlap))
    out = did.select("doc_id", "text", F.posexplode("w").alias("chunk_idx", "w"))
    return out.select(ids.chunk_id(F.col("doc_id"), F.lit(0), F.col("chunk_idx")).alias("id"), "doc_id", F.lit(0).alias("sec_idx"), "chunk_idx", F.lit("").alias("section_path"), F.expr("substring(text, w.s + 1, w.e - w.s)").alias("text"), F.col("w.s").alias("char_start"), F.col("w.e").alias("char_end"))
