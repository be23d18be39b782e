"""Source divergence audit: which sources of a language use its terms otherwise than the language and than each other.

1. A count-min sketch of document frequencies by (lang, term) is filled in each task and merged block by block. Its
   counters stop at the number of documents that a term needs; they never say less than the truth below that, so a term
   with a counter short of it can't be kept.
2. A second scan counts the terms that the sketch lets through, exactly, and only those are shuffled.
3. Pairs of sources are compared on the terms that either has, in blocks of sources and buckets of terms: a task holds
   two blocks of sources in one bucket. Terms that neither has add one closed form for each pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, mix64, rename_columns, slices, written

#: ASCII letters lowered, every other ASCII character turned into a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Cells of a sketch that travel in one row.
_BLOCK = 1 << 16


@dataclass(frozen=True)
class Params:
    """min_docs (255 at most): in how many documents of its lang a kept term is. depth, bits: rows of the sketch and the
    binary logarithm of their cells; a task holds depth * 2^bits bytes, and all tasks get an eighth of that. top: terms
    reported for a group. window: distinct terms that a task gathers before it passes their counts on. sources, entries:
    how many sources a block holds, and about how many counts a task compares at once."""

    min_docs: int = 10
    depth: int = 2
    bits: int = 24
    top: int = 10
    window: int = 1 << 19
    sources: int = 256
    entries: int = 1 << 16


def _gap(text: bytes, at: int, step: int = 1 << 16) -> int:
    """The first place from `at` on that is no part of a term."""
    while at < len(text):
        found = text[at : at + step].translate(LETTERS).find(b" ")
        if found >= 0:
            return at + found
        at += step
    return len(text)


def _word_lists(text: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists from pieces of about a megabyte."""
    at = 0
    while at < len(text):
        end = _gap(text, at + piece)
        yield text[at:end].translate(LETTERS).split()
        at = end


def _cells(lang: str, terms: list[bytes], p: Params) -> list[np.ndarray]:
    """Each term's cell in each row of the sketch."""
    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
    own = np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in terms), np.uint64, len(terms))
    return [(mix64(own + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - p.bits)).astype(np.int64) for r in range(p.depth)]


def _sketched(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> the task's sketch as rows of (block, cells and counts that aren't zero)."""
    sketch = np.zeros((p.depth, 1 << p.bits), np.uint8)
    seen: dict[str, Counter] = {}

    def flush() -> None:
        for lang, terms in seen.items():
            counts = np.minimum(np.fromiter(terms.values(), np.int64, len(terms)), p.min_docs)
            for row, at in zip(sketch, _cells(lang, list(terms), p), strict=True):
                cells, place = np.unique(at, return_inverse=True)
                row[cells] = np.minimum(row[cells] + np.bincount(place, counts), p.min_docs)
        seen.clear()

    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            own: set[bytes] = set()
            for words in _word_lists(text):
                own.update(words)
            seen.setdefault(lang, Counter()).update(own)
        if sum(map(len, seen.values())) >= p.window:
            flush()
    flush()
    yield from sketch_rows(sketch)


def sketch_rows(sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A sketch as rows of (block, cells and counts that aren't zero)."""
    blocks, payloads = [], []
    for i, cells in enumerate(sketch.reshape(-1, min(_BLOCK, sketch.shape[1]))):
        at = np.flatnonzero(cells)
        if len(at):
            blocks.append(i), payloads.append(at.astype("<u2").tobytes() + cells[at].tobytes())
    for i in range(0, len(blocks), 64):
        yield pa.RecordBatch.from_arrays([pa.array(blocks[i : i + 64], pa.int32()), pa.array(payloads[i : i + 64], pa.binary())], names=["block", "cells"])


def _merged(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block -> (block, a bit for each cell: whether it has min_docs)."""
    own, cells = None, np.zeros(min(_BLOCK, 1 << p.bits), np.uint8)
    done = lambda: pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([np.packbits(cells >= p.min_docs).tobytes()], pa.binary())], names=["block", "bits"])
    for batch in batches:
        for block, payload in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            if block != own:
                if own is not None:
                    yield done()
                own = block
                cells[:] = 0
            n = len(payload) // 3
            at = np.frombuffer(payload, "<u2", n)
            cells[at] = np.minimum(cells[at] + np.frombuffer(payload, np.uint8, n, 2 * n), p.min_docs)
    if own is not None:
        yield done()


def frequent(docs: DataFrame, p: Params, fill: Callable = _sketched) -> np.ndarray:
    """(lang, text), or what fill takes -> depth rows of bits: whether a cell's terms may be in min_docs documents. The
    driver gets depth * 2^bits / 8 bytes, whatever the size of docs."""
    made = docs.mapInArrow(partial(fill, p=p), "block int, cells binary")
    merged = made.repartition("block").sortWithinPartitions("block").mapInArrow(partial(_merged, p=p), "block int, bits binary")
    width = min(_BLOCK, 1 << p.bits) // 8
    out = np.zeros((p.depth << p.bits) // 8, np.uint8)
    for block, bits in merged.toLocalIterator():
        out[block * width : (block + 1) * width] = np.frombuffer(bits, np.uint8)
    return out.reshape(p.depth, -1)


def _counted(batches: Iterator[pa.RecordBatch], may, p: Params) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs) of the terms that the sketch lets through, summed up within
    windows of the task."""
    bits, one = may.value, 1 << 40
    seen: dict[tuple[str, str], dict[bytes, int]] = {}  # of each term: one * its documents + its number

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), held in seen.items():
            terms = list(held)
            good = np.ones(len(terms), bool)
            for row, at in zip(bits, _cells(lang, terms, p), strict=True):
                good &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
            some = [t for t, g in zip(terms, good.tolist(), strict=True) if g]
            for i in range(0, len(some), 8192):
                part = some[i : i + 8192]
                both = [held[t] for t in part]
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([v % one for v in both]), pa.array([v // one for v in both])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        seen.clear()

    for batch in slices(batches):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            own: Counter = Counter()
            for words in _word_lists(text):
                own.update(words)
            held = seen.setdefault((lang, source), {})
            for term, n in own.items():
                held[term] = held.get(term, 0) + n + one
        if sum(map(len, seen.values())) >= p.window:
            yield from flush()
    yield from flush()


def _share(n: Column | str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exact up to 18 digits of n."""
    return F.expr(f"1 + (cast(1000000000 AS decimal(10,0)) * cast({n} + 2 AS decimal(19,0))) div cast({total} + 2 * {terms} AS decimal(20,0))")


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so 64 bits hold the square."""
    return (p - q) * (p - q) // (p + q)


_PAIRS = "lang string, source string, item string, value long, n long, rest long, terms long"


def _compared(t: pa.Table) -> pa.Table:
    """Two blocks of sources in one bucket of terms: a row without a term for each source (its share of terms that it
    hasn't), and a row for each count. For each pair of sources: the sum over the terms that either has, how many those
    are, and what a term that neither has adds."""
    t = t.combine_chunks()
    names = pc.unique(t.column("source"))
    who = pc.index_in(t.column("source"), value_set=names).to_numpy()
    term = pa.concat_arrays(t.column("term").chunks).dictionary_encode()
    code = pc.fill_null(term.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    p, own = t.column("p").to_numpy(), t.column("own").to_numpy()
    mark = code < 0
    z, block = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    z[who[mark]], block[who[mark]] = p[mark], own[mark]
    x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
    code, who, p = code[~mark], who[~mark], p[~mark]
    has = np.bincount(who, minlength=len(names))
    sort = np.argsort(who, kind="stable")
    starts = np.concatenate([[0], np.cumsum(has)])
    right = np.flatnonzero(block == y)
    inside = np.flatnonzero(block[who] == y)
    ty, jy, py = code[inside], who[inside], p[inside]
    sums = lambda j, v: np.bincount(j, v, len(names)).astype(np.int64)[right]
    out: list[list] = [[], [], [], [], []]
    shares, mine = np.zeros(len(term.dictionary), np.int64), np.zeros(len(term.dictionary), bool)
    for i in np.flatnonzero(block == x).tolist():
        rows = sort[starts[i] : starts[i + 1]]
        shares[:], mine[:] = z[i], False
        shares[code[rows]], mine[code[rows]] = p[rows], True
        both = mine[ty]
        value = sums(jy, _apart(shares[ty], py)) - sums(jy[both], _apart(shares[ty[both]], z[jy[both]]))
        for k in range(0, len(rows), 4096):
            value += _apart(p[rows[k : k + 4096], None], z[right]).sum(axis=0)
        n = has[i] + has[right] - np.bincount(jy[both], minlength=len(names))[right]
        rest = _apart(np.full(len(right), z[i]), z[right])
        other = right != i
        for column, part in zip(out, (np.full(len(right), i), right, value, n, rest), strict=True):
            column.append(part[other])
    a, b, value, n, rest = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
    if x != y:
        a, b, value, n, rest = np.concatenate([a, b]), np.concatenate([b, a]), *(np.tile(c, 2) for c in (value, n, rest))
    lang, terms = t.column("lang")[0].as_py(), t.column("terms")[0].as_py()
    columns = [pa.array([lang] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(value), pa.array(n), pa.array(rest), pa.array([terms] * len(a), pa.int64())]
    return pa.Table.from_arrays(columns, names=["lang", "source", "item", "value", "n", "rest", "terms"])


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", params: Params = Params()) -> DataFrame:
    """docs -> (lang, source, part, item, value long, rank int).

    Terms are runs of letters (A-Z lowered) and of characters beyond ASCII; a lang keeps those that at least min_docs of
    its rows hold. Part `pair` has each other source of the lang with the divergence of both over all kept terms, part
    `term` the `top` kept terms that a group uses more than its lang, by their part of the divergence. Ranks are by
    value, then by item as UTF-8.

    Null texts, langs and sources are empty ones. Each row counts as a document, also if it repeats another. A group
    without terms, or a lang without kept terms, has its pairs (of value 0 in the latter); a lang of one source has
    none. Other columns are ignored, and an empty table gives an empty result.
    """
    p = params
    own = rename_columns(docs, lang=lang_col, source=source_col, text=text_col)
    own = own.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    may = docs.sparkSession.sparkContext.broadcast(frequent(own.select("lang", "text"), p))
    counts = own.mapInArrow(partial(_counted, may=may, p=p), "lang string, source string, term string, n long, docs long")
    counts = written(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= p.min_docs)
    exact = written(counts.select("lang", "source", "term", "n").join(kept.drop("docs"), ["lang", "term"]))
    discard(counts)

    langs = exact.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    sums = exact.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("entries"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = own.groupBy("lang", "source").agg(F.count("*").alias("rows")).join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.select("lang", "source", *map(zero, ("total", "entries", "terms", "lang_total"))))
    entries = exact.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "terms"))

    best = entries.withColumn("q", _share("lang_n", "lang_total", "terms")).where("p > q")
    best = best.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.top)

    # So many blocks of sources, and of terms for each two of them, has a lang.
    shape = groups.groupBy("lang").agg(F.count("*").alias("s"), F.sum("entries").alias("e"))
    shape = shape.select("lang", F.ceil(F.col("s") / p.sources).cast("int").alias("blocks"), "e")
    shape = shape.select("lang", "blocks", F.greatest(F.lit(1), F.ceil(2 * F.col("e") / (F.col("blocks") * p.entries))).cast("int").alias("buckets"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    dealt = lambda df, p_, term, bucket: df.join(shape, "lang").select("lang", "source", "terms", p_.alias("p"), term.alias("term"), bucket.alias("bucket"), block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    none = F.when(F.col("terms") == 0, F.lit(1).cast("long")).otherwise(F.expr("1 + cast(2000000000 AS long) div greatest(total + 2 * terms, 1)"))
    marks = groups.withColumn("z", none).join(shape, "lang").select("*", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket")).drop("blocks", "buckets")
    sides = dealt(marks, F.col("z"), F.lit(None).cast("string"), F.col("bucket"))
    sides = sides.union(dealt(entries, F.col("p"), F.col("term"), F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")))
    sides = sides.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other")
    pairs = sides.groupBy("lang", "x", "y", "bucket").applyInArrow(_compared, _PAIRS)
    pairs = pairs.groupBy("lang", "source", "item").agg((F.sum("value") + (F.max("terms") - F.sum("n")) * F.max("rest")).alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(w).alias("rank"))
    return pairs.union(best)


ORACLE_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
occ AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
gp AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n, (sum(coalesce(n, 0)) OVER (PARTITION BY lang, source))::HUGEINT AS total, v FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN occ USING (lang, source, term)),
gs AS (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v))::HUGEINT AS p FROM gp),
lp AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM gp GROUP BY ALL),
ls AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 2) // ((sum(n) OVER (PARTITION BY lang))::HUGEINT + 2 * v))::HUGEINT AS q FROM lp JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM gs a JOIN gs b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM gs JOIN ls USING (lang, term) WHERE n > 0 AND p > q)
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value, CAST(row_number() OVER (PARTITION BY a.lang, a.source ORDER BY coalesce(value, 0) DESC, b.source) AS INT) AS rank
FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
UNION ALL SELECT lang, source, 'term', item, value::BIGINT, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM term QUALIFY rank <= 10
"""
