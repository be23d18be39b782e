"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark's items. For each pattern length, a shift table says for the block of
two words that ends at a position how far the search may go on; where it may not, the block (the windows' suffix)
selects a bucket, the two words at the window's beginning narrow it, and a direct comparison confirms.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, rename_columns, slices, texts, written


class Searcher:
    """Finds the windows of items (id or None, text) in lists of words."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        patterns: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, text in items:
            words = alnum_words(text)
            m = min(window, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                named = patterns.setdefault(m, {}).setdefault(tuple(words[i : i + m]), set())
                if item is not None:
                    named.add(str(item))
        self.tables = []
        for m, found in sorted(patterns.items()):
            size = min(2, m)
            shift: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
            for words, named in found.items():
                for j in range(size, m + 1):
                    block = words[j - size : j]
                    shift[block] = min(shift.get(block, m), m - j)
                buckets.setdefault(words[m - size :], {}).setdefault(words[:size], []).append((list(words), named))
            self.tables.append((m, size, shift, m - size + 1, buckets))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges (start, end) of the occurrences, those that touch in one, and the items."""
        ranges, items, n = [], set(), len(words)
        for m, size, shift, far, buckets in self.tables:
            i = m
            while i <= n:
                block = tuple(words[i - size : i])
                if step := shift.get(block, far):
                    i += step
                    continue
                for pattern, named in buckets[block].get(tuple(words[i - m : i - m + size]), ()):
                    if words[i - m : i] == pattern:
                        ranges.append((i - m, i))
                        items |= named
                i += 1
        return merge(ranges), items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_WORKER: dict[str, Searcher] = {}


def _searcher(block, window: int) -> Searcher:
    name, items = block.value
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Searcher(items, window)
    return _WORKER[name]


def _found(batches: Iterator[pa.RecordBatch], block, window: int) -> Iterator[pa.RecordBatch]:
    searcher = _searcher(block, window)
    for batch in slices(batches):
        n, hits, named = [], [], []
        for text in texts(batch.column("text")):
            words = alnum_words(text)
            ranges, items = searcher.find(words)
            n.append(len(words)), hits.append([x for r in ranges for x in r]), named.append(sorted(items))
        keep = [c for c in batch.schema.names if c != "text"]
        made = [pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(named, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*map(batch.column, keep), *made], names=[*keep, "n_words", "hits", "items"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document, what the blocks have found (lists of ranges and of items) in one."""
    for batch in slices(batches):
        hits = []
        for parts in batch.column("all_hits").to_pylist():
            hits.append([x for r in merge([(p[i], p[i + 1]) for p in parts for i in range(0, len(p), 2)]) for x in r])
        items = [sorted({x for p in parts for x in p}) for parts in batch.column("all_items").to_pylist()]
        keep = [c for c in batch.schema.names if c not in ("all_hits", "all_items")]
        yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=[*keep, "hits", "items"])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    held, size = [], 0
    for item, text in benchmark.toLocalIterator():
        held.append((item, text or ""))
        size += len(held[-1][1].encode("utf-8", "surrogatepass"))
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = (), window: int = 10, block_bytes: int = 1 << 20
) -> DataFrame:
    """docs -> (doc_id, n_words long, hits array<long>, items array<string>, and the columns of carry): the document's
    words, where windows of the benchmark occur in them (start and end of each word range in turn), and the ids of their
    items, sorted.

    Words are runs of letters and digits (A-Z lowered) and of characters beyond ASCII. Null and empty texts have no
    words and no hits; an item without words has no windows; the windows of an item without an id hit, but aren't
    named. Each row of docs gives a row. Other columns are ignored, and either table may be empty.

    The benchmark reaches the tasks in blocks of block_bytes (a worker's tables take some 300 times that), one pass over
    docs for each; the driver holds one at a time. All passes but the first keep only the documents that are hit.
    """
    spark = docs.sparkSession
    own = rename_columns(docs, doc_id=id_col, text=text_col, **{f"_{i}": c for i, c in enumerate(carry)})
    fields = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "text")
    made = ", n_words long, hits array<long>, items array<string>"
    blocks = _blocks(rename_columns(benchmark, item=item_col, text=item_text_col), block_bytes)
    this, after = next(blocks, []), next(blocks, None)
    send = lambda items: spark.sparkContext.broadcast((uuid.uuid4().hex, items))
    search = lambda df, items: df.mapInArrow(partial(_found, block=send(items), window=window), fields(df) + made)
    renamed = [F.col(f"_{i}").alias(c) for i, c in enumerate(carry)]
    if after is None:
        return search(own, this).select("doc_id", "n_words", "hits", "items", *renamed)
    # Rows of one id and text have the same hits.
    own = own.withColumn("t", F.xxhash64("text"))
    rows = written(search(own, this))
    parts = []
    while after is not None:
        parts.append(written(search(own.select("doc_id", "t", "text"), after).where("size(hits) > 0")))
        after = next(blocks, None)
    more = reduce(DataFrame.union, parts).groupBy(F.col("doc_id").alias("id2"), F.col("t").alias("t2")).agg(F.collect_set("hits").alias("more_hits"), F.collect_set("items").alias("more_items"))
    every = rows.join(more, rows["doc_id"].eqNullSafe(more["id2"]) & (rows["t"] == more["t2"]), "left")
    both = [F.concat(F.array(c), F.coalesce(f"more_{c}", F.array())).alias(f"all_{c}") for c in ("hits", "items")]
    every = every.select("doc_id", "n_words", *(f"_{i}" for i in range(len(carry))), *both)
    kept = every.drop("all_hits", "all_items")
    return every.mapInArrow(_joined, fields(kept) + ", hits array<long>, items array<string>").select("doc_id", "n_words", "hits", "items", *renamed)


def contamination(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """overlaps() as (doc_id, n_words, n_hit, n_items long, items_sha256 string, contaminated boolean, carry)."""
    found = overlaps(docs, benchmark, carry=carry, **options)
    n_hit = F.expr("aggregate(transform(hits, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (s, x) -> s + x)")  # ends less starts
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        *carry,
    )


ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM bi),
sizes AS (SELECT DISTINCT k FROM win),
di AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k),
pos AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM di),
occ AS (SELECT doc_id, item_id, i, k FROM pos JOIN win USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
