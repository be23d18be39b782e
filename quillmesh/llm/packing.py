"""Best-fit packing after Martello-Toth dominance reduction.

A piece's place depends on its length alone, so the packing is worked out on the histogram of lengths (at most
`size` numbers, whatever the corpus): sets of pieces that provably dominate every alternative are fixed for good,
the rest is packed best fit, decreasing. The plan says which ranks of each length go where; each piece finds its rank
from its partition's own numbering plus the counts of the partitions before, so that no length is gathered in a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rename_columns, slices, texts, written
from .tokens import encoder


#: Counts of lengths by partition that are sent whole to the tasks (some 24 bytes each); beyond it, they are joined by a shuffle.
SENT_COUNTS = 500_000


@dataclass
class Plan:
    """runs: (length, first rank, pieces, first sequence, pieces of this run in a sequence, offset of the first).
    sequences: how many. fixed: how many of them the reduction fixed."""

    size: int
    sequences: int = 0
    fixed: int = 0
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)


def plan_packing(histogram: dict[int, int], size: int) -> Plan:
    """histogram: number of pieces of each length from 1 to size. Deterministic."""
    plan, left, rank = Plan(size), np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= size:
            raise ValueError(f"a piece of {length} doesn't fit {size}")
        left[length] = n

    def put(length: int, pieces: int, first: int, per: int, offset: int) -> None:
        plan.runs.append((length, int(rank[length]), pieces, first, per, offset))
        rank[length] += pieces
        left[length] -= pieces

    def fix(n: int, *lengths: int) -> None:
        offset = 0
        for length in lengths:
            put(length, n, plan.sequences, 1, offset)
            offset += length
        plan.sequences += n
        plan.fixed += n

    _reduce(left, size, fix)
    groups: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by free space: (first sequence, how many)
    some = np.zeros(size + 1, bool)

    def add(free: int, first: int, n: int) -> None:
        if n and free:
            groups[free].append((first, n))
            some[free] = True

    for length in np.flatnonzero(left)[::-1].tolist():
        for free in (np.flatnonzero(some[length:]) + length).tolist():
            per = free // length
            while left[length] and groups[free]:
                first, n = groups[free].pop()
                full = min(n, int(left[length]) // per)
                if full:
                    put(length, full * per, first, per, size - free)
                    add(free - per * length, first, full)
                if full < n and 0 < left[length] < per:
                    rest = int(left[length])
                    put(length, rest, first + full, per, size - free)
                    add(free - rest * length, first + full, 1)
                    full += 1
                add(free, first + full, n - full)
            some[free] = bool(groups[free])
            if not left[length]:
                break
        if n := int(left[length]):
            per = size // length
            new = -(-n // per)
            put(length, n, plan.sequences, per, 0)
            add(size - per * length, plan.sequences, n // per)
            if n % per:
                add(size - n % per * length, plan.sequences + new - 1, 1)
            plan.sequences += new
    return plan


def _reduce(left: np.ndarray, size: int, fix) -> None:
    """Fixes sets that dominate: a piece that fits with no other; a piece and one that fills the rest exactly; a piece
    and the largest that fits with it, if no two others fit; the same if at most two others fit, and no two of them
    hold more. left changes with each fixed set. All copies of a case are fixed at once: taking the largest partner
    away leaves fewer alternatives, so what held for the first holds for the next."""

    def fitting(room: int, taken: int) -> np.ndarray:
        have = left[: room + 1].copy()
        if taken <= room:
            have[taken] -= 1
        return have

    for length in range(size, 0, -1):
        while left[length] > 0:
            room = size - length
            have = fitting(room, length)
            small = np.flatnonzero(have)
            if not len(small):
                # alone, unless two of this very length fit (then it is among the small ones)
                fix(int(left[length]), length)
                break
            partner = int(small[-1])
            least = np.repeat(small[:3], np.minimum(have[small[:3]], 3))[:3]
            two = int(least[:2].sum()) if len(least) > 1 else size + 1
            three = int(least.sum()) if len(least) > 2 else size + 1
            if partner != room and two <= room and not (three > room and _best_two(have, small, room) <= partner):
                break
            n = int(left[length]) // 2 if partner == length else int(min(left[length], left[partner]))
            fix(n, length, partner)


def _best_two(have: np.ndarray, small: np.ndarray, room: int) -> int:
    """The most that two of the pieces hold without exceeding room."""
    best = 0
    for a in small.tolist():
        fits = small[: np.searchsorted(small, room - a, side="right")]
        if len(fits) and fits[-1] == a and have[a] < 2:
            fits = fits[:-1]
        if len(fits):
            best = max(best, a + int(fits[-1]))
    return best


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary, size: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc, part, seen = encoder(vocabulary.value), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
    for batch in slices(batches, 256):
        docs, piece, start, length, crc, blob, rank = [], [], [], [], [], [], []
        encoded = enc.encode(texts(batch.column("text")))
        for i, ids in enumerate(encoded):
            raw = np.append(ids, enc.dtype.type(end_id)).astype("<u4")
            n = len(raw)
            first = n % size or size
            for k, (a, b) in enumerate(zip([0, *range(first, n, size)], [*range(first, n, size), n], strict=True)):
                body = raw[a:b].tobytes()
                docs.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(body))
                rank.append(int(seen[b - a]))
                seen[b - a] += 1
                if with_ids:
                    blob.append(body)
        columns = [batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(docs), pa.int32()), pa.array(rank, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
        if with_ids:
            columns.append(pa.array(blob, pa.binary()))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _placed(batches: Iterator[pa.RecordBatch], runs) -> Iterator[pa.RecordBatch]:
    r = runs.value  # sorted by length, first rank
    keys = r[:, 0].astype(np.float64) * 2.0**40 + r[:, 1]
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        at = np.searchsorted(keys, length * 2.0**40 + rank, side="right") - 1
        row = r[at] if len(at) else np.zeros((0, 6), np.int64)
        k = rank - row[:, 1]
        out = [batch.column(c) for c in batch.schema.names if c != "rank"]
        out += [pa.array(row[:, 3] + k // np.maximum(row[:, 4], 1)), pa.array(row[:, 5] + k % np.maximum(row[:, 4], 1) * length)]
        yield pa.RecordBatch.from_arrays(out, names=[*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"])


def pack(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """docs -> one row per piece: doc_id, piece int, start, length, ids_crc32, sequence_id, offset (long), and with
    with_ids the piece's ids as little-endian unsigned 32-bit integers (binary).

    A document is its text's ids by the tokenizers library, then end_id. One of more than size ids is cut from its
    end into pieces of size, so that the first may be shorter; others stay whole. Null and empty texts are the end id
    alone. Ids may be null or repeat: each row is packed for itself. Other columns are ignored, and an empty table
    gives an empty result. Sequences are numbered from 0 without gaps, and pieces lie in them without gaps.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:  # the driver's; executors get the content
        vocabulary = spark.sparkContext.broadcast(f.read())
    own = rename_columns(docs, doc_id=id_col, text=text_col)
    kind = dict(own.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids
    made = written(own.mapInArrow(partial(_pieces, vocabulary=vocabulary, size=size, end_id=end_id, with_ids=with_ids), schema))

    counts = written(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    plan = plan_packing(histogram, size)
    runs = spark.sparkContext.broadcast(np.array(sorted(plan.runs), np.int64).reshape(-1, 6))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    few = counts.count() <= SENT_COUNTS
    ranked = made.join(F.broadcast(first) if few else first.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(partial(_placed, runs=runs), out)
