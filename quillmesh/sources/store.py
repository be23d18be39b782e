"""An index as a log of versions over Parquet files.

root/log/<n> lists, for each table of version n, the folders that hold its rows and the lists of what has gone since. A
build writes its rows and its lists into folders of its own and then puts the next number into the log, which only one
build can do: another that started from the same version is told so, and readers see the old version or the new one.

Rows belong to an owner (a document, a chunk, an entity ...). A row is dead where a later version lists its owner as gone.
So a small change writes a few rows and a short list; compact() rewrites tables that have many of them, vacuum() deletes
what no version names any more.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from .scratch import filesystem

#: By which columns a table's rows are dealt and sorted, so that look-ups read few row groups.
ORDER = {"documents": ["id"], "chunks": ["doc_id", "id"], "nodes": ["id"], "edges": ["src", "dst"], "vectors": ["id"], "events": ["id"], "event_entities": ["entity_id", "event_id"], "event_grams": ["gram", "entity_id"]}
#: Which column names a row's owner.
OWNER = {
    "documents": "id", "sections": "doc_id", "chunks": "doc_id", "links": "doc_id", "tags": "doc_id", "warnings": "doc_id", "nodes": "owner", "edges": "owner",
    "vectors": "id", "extractions": "id", "events": "chunk_id", "event_entities": "chunk_id", "event_nodes": "entity_id", "event_grams": "entity_id",
}


class Conflict(RuntimeError):
    """Another build has made the version that this one would have made."""


@dataclass
class Change:
    """What a build does to a table: rows to add, owners (a column `owner`) whose earlier rows go, or all of them."""

    add: DataFrame | None = None
    gone: DataFrame | None = None
    replace: bool = False


def kind(table: str) -> str:
    """A table's name without the model, for vector tables."""
    return "vectors" if table.startswith("vectors_") else table


def current(spark: SparkSession, root: str) -> int:
    """The number of the newest version; 0 before the first build."""
    fs, at = filesystem(spark, f"{root}/log")
    if not fs.exists(at):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return max((int(n) for n in names if re.fullmatch("[0-9]+", n)), default=0)


def listing(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """Of each table of a version: schema (JSON), rows and gone (folders below root)."""
    version = current(spark, root) if version is None else version
    if not version:
        return {}
    fs, at = filesystem(spark, f"{root}/log/{version:08d}")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _log(spark: SparkSession, root: str, version: int, tables: dict) -> None:
    """Put a version into the log; the renaming fails where there is one of that number."""
    fs, new = filesystem(spark, f"{root}/log/.new-{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(json.dumps(tables).encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(new), fs.makeQualified(hadoop.Path(f"{root}/log/{version:08d}")), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception as e:
        fs.delete(new, False)
        if "AlreadyExists" in str(e):
            raise Conflict(f"version {version} of {root} is there already") from e
        raise


def at_once(f: Callable, names: Iterable, jobs: int = 4) -> list:
    """f of each name, several Spark jobs at a time: the tables of a version are small against each other."""
    with ThreadPoolExecutor(jobs) as pool:
        return list(pool.map(f, names))


def commit(spark: SparkSession, root: str, changes: dict[str, Change], based: int | None = None) -> int:
    """Write changes as the version after `based` (the current one); its number. Raises Conflict, and leaves the index
    as it is, if that number is taken by then."""
    based = current(spark, root) if based is None else based
    tables, version, tag = listing(spark, root, based), based + 1, uuid.uuid4().hex[:12]

    def write(name: str) -> None:
        change, own = changes[name], tables[name]
        if change.gone is not None and not change.replace:
            at = f"gone/{name}/v={version}/b={tag}"
            change.gone.select(F.col("owner").cast("string").alias("owner")).distinct().write.mode("overwrite").parquet(f"{root}/{at}")
            own["gone"].append(at)
        if change.add is not None:
            at = f"rows/{name}/v={version}/b={tag}"
            by = [c for c in ORDER.get(kind(name), []) if c in change.add.columns]
            dealt = change.add.repartitionByRange(*by).sortWithinPartitions(*by) if by else change.add
            dealt.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{at}")
            own["rows"].append(at)
            own["schema"] = own["schema"] or json.loads(change.add.schema.json())

    for name, change in changes.items():
        own = tables.setdefault(name, {"schema": None, "rows": [], "gone": []})
        if change.replace:
            own["rows"], own["gone"] = [], []
    at_once(write, changes)
    _log(spark, root, version, tables)
    return version


def load(spark: SparkSession, root: str, name: str, version: int | None = None, owners: bool = False) -> DataFrame | None:
    """The living rows of a table; None if the version hasn't got it. With owners, the column `owner` stays."""
    own = listing(spark, root, version).get(name)
    if own is None or own["schema"] is None:
        return None
    schema = StructType.fromJson(own["schema"])
    columns = [f.name for f in schema.fields if owners or f.name != "owner"]
    if not own["rows"]:
        return spark.createDataFrame([], schema).select(*columns)
    at = lambda parts: [f"{root}/{p}" for p in parts]
    rows = spark.read.schema(StructType([*schema.fields]).add("v", IntegerType()).add("b", StringType())).option("basePath", f"{root}/rows/{name}").parquet(*at(own["rows"]))
    if own["gone"]:
        gone = spark.read.schema("owner string, v int, b string").option("basePath", f"{root}/gone/{name}").parquet(*at(own["gone"]))
        gone = gone.groupBy(F.col("owner").alias("_owner")).agg(F.max("v").alias("_since"))
        key = OWNER[kind(name)]
        rows = rows.join(gone, (F.col(key) == F.col("_owner")) & (F.col("v") < F.col("_since")), "left_anti")
    return rows.select(*columns)


def delta(spark: SparkSession, root: str, version: int) -> dict[str, tuple[int, int]]:
    """Of each table that a version has changed: how many rows it has added, and how many owners it has listed as gone."""
    out = {}
    for name, own in listing(spark, root, version).items():
        parts = [[f"{root}/{p}" for p in own[c] if f"/v={version}/" in p] for c in ("rows", "gone")]
        if any(parts):
            out[name] = tuple(spark.read.parquet(*p).count() if p else 0 for p in parts)
    return out


def compact(spark: SparkSession, root: str, most: int = 8, names: Iterable[str] | None = None) -> list[str]:
    """Rewrite the tables that are spread over more than `most` folders of rows, as a new version; their names."""
    version = current(spark, root)
    tables = listing(spark, root, version)
    wide = [n for n in names or tables if n in tables and len(tables[n]["rows"]) + len(tables[n]["gone"]) > most]
    if wide:
        commit(spark, root, {n: Change(load(spark, root, n, version, owners=True), replace=True) for n in wide}, version)
    return wide


def vacuum(spark: SparkSession, root: str, keep: int = 1, seconds: float = 86_400) -> int:
    """Delete the folders that none of the newest `keep` versions names, and older versions from the log; how many
    folders. Those that were written less than so many seconds ago stay: a build may be about to name them."""
    newest = current(spark, root)
    kept = range(max(1, newest - keep + 1), newest + 1)
    named = {p for n in kept for t in listing(spark, root, n).values() for p in t["rows"] + t["gone"]}
    fs, _ = filesystem(spark, root)
    before, gone, path = (time.time() - seconds) * 1000, 0, spark._jvm.org.apache.hadoop.fs.Path
    for part in fs.globStatus(path(f"{root}/*/*/v=*/b=*")) or []:
        at = "/".join(part.getPath().toString().split("/")[-4:])
        if at not in named and part.getModificationTime() <= before:
            fs.delete(part.getPath(), True)
            gone += 1
    for old in fs.listStatus(path(f"{root}/log")):
        name = old.getPath().getName()
        if re.fullmatch("[0-9]+", name) and int(name) < kept.start:
            fs.delete(old.getPath(), False)
    return gone


def chunks_of(chunks: DataFrame, doc_id: str) -> DataFrame:
    """A document's chunks in the order of their ids as text."""
    return chunks.where(F.col("doc_id") == doc_id).orderBy("id")


def lookup(table: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The rows of the ids listed; those that aren't there are left out."""
    return table.join(wanted.select(key).distinct(), key, "left_semi")


def get(spark: SparkSession, root: str, table: str, id: str) -> dict | None:
    """One row by its id, or None. The filter reaches the files, which are sorted by it."""
    rows = load(spark, root, table)
    found = rows.where(F.col("id") == id).limit(1).collect() if rows is not None else []
    return found[0].asDict(recursive=True) if found else None
