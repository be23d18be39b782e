"""Hard-negative mining by dual-tree search over inner products.

Anchors come in chunks of a bounded size, which every task gets whole, as a tree; the other rows stay where they are: a
task takes them in slices and grows a tree over each. A pair of nodes, one of either tree, has an interval that holds all
inner products between its members. Pairs that can't give a result for any anchor of the node end there, with all anchors
below at once; pairs of leaves are scored exactly, the most promising first.

1. Positives: an anchor's best rows of its label. A node pair ends below the least of the anchors' worst positives so far.
2. Negatives: rows of other labels whose scores lie in the windows that the anchor's positives set. A node pair ends
   outside the hull of the anchors' windows, each one raised to its worst negative so far.

What leaves a task is bounded by the anchors of a chunk; Spark ranks what the tasks found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, rename_columns, written


@dataclass(frozen=True)
class Params:
    """positives, negatives: how many at most for an anchor, for each of its positives. low, high: a negative has low to
    high hundredths of the positive's score. scale: components count as floor(scale * x). chunk_bytes: of anchors that
    go to the tasks at once, a pass over all rows for each. leaf_anchors, leaf_rows: members of a leaf. slice_rows: rows
    under one tree. task_rows: small partitions are put together to about so many rows."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    chunk_bytes: int = 32 << 20
    leaf_anchors: int = 32
    leaf_rows: int = 128
    slice_rows: int = 1 << 15
    task_rows: int = 1 << 17


_NONE = np.iinfo(np.int64).min


class Tree:
    """A binary tree over rows: order, and for each node its part of that order, children (-1 in a leaf), box and ball.

    Nodes are halved across the line between two far members, by the median, so that copies don't make long branches."""

    def __init__(self, rows: np.ndarray, leaf: int, groups: list[np.ndarray] | None = None):
        self.order = np.arange(len(rows)) if groups is None else np.concatenate([*groups, np.zeros(0, np.int64)])
        ends = np.cumsum([len(rows)] if groups is None else [len(g) for g in groups]).tolist()
        spans = [(e - n, e) for e, n in zip(ends, [len(rows)] if groups is None else map(len, groups), strict=True)]
        self.roots, left, right = len(spans), [], []
        i = 0
        while i < len(spans):
            a, b = spans[i]
            if b - a <= leaf:
                left.append(-1), right.append(-1)
            else:
                own = rows[self.order[a:b]]
                far = own[((own - own[0]) ** 2).sum(axis=1).argmax()]
                line = own @ (own[((own - far) ** 2).sum(axis=1).argmax()] - far)
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(line, half)]
                left.append(len(spans)), right.append(len(spans) + 1)
                spans += [(a, a + half), (a + half, b)]
            i += 1
        self.spans = np.array(spans, np.int64).reshape(-1, 2)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.rows = rows[self.order]
        parts = [self.rows[a:b] for a, b in spans]
        wide = rows.shape[1]
        each = lambda f: np.array([f(p) if len(p) else np.zeros(wide) for p in parts]).reshape(len(spans), wide)
        self.lo, self.hi, self.mid = each(lambda p: p.min(axis=0)), each(lambda p: p.max(axis=0)), each(lambda p: p.mean(axis=0))
        self.radius = np.array([np.sqrt(((p - m) ** 2).sum(axis=1).max()) if len(p) else 0.0 for p, m in zip(parts, self.mid, strict=True)])
        self.norm = np.sqrt((self.mid**2).sum(axis=1))

    def fold(self, values: np.ndarray, f: Callable) -> np.ndarray:
        """For each node, f over the values of its members (values in the rows' own order)."""
        own = values[self.order]
        return np.array([f(own[a:b]) if b > a else 0 for a, b in self.spans.tolist()])


def _bounds(one: Tree, a: np.ndarray, other: Tree, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of the inner products between nodes a and c: of their boxes and of their balls, the narrower ends."""
    products = [x[a] * y[c] for x in (one.lo, one.hi) for y in (other.lo, other.hi)]
    low, high = (reduce(f, products).sum(axis=1) for f in (np.minimum, np.maximum))
    middle = (one.mid[a] * other.mid[c]).sum(axis=1)
    around = one.norm[a] * other.radius[c] + other.norm[c] * one.radius[a] + one.radius[a] * other.radius[c]
    slack = 1 + 1e-9 * (np.abs(low) + np.abs(high) + np.abs(middle) + around)  # for the rounding of what isn't whole
    return np.maximum(low, middle - around) - slack, np.minimum(high, middle + around) + slack


def _leaf_pairs(one: Tree, other: Tree, a: np.ndarray, c: np.ndarray, alive: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From node pairs down to the pairs of leaves that stay alive: (a, c, low, high), by a and falling high."""
    found = []
    while len(a):
        low, high = _bounds(one, a, other, c)
        keep = alive(a, low, high)
        a, c, low, high = a[keep], c[keep], low[keep], high[keep]
        la, lc = one.left[a] < 0, other.left[c] < 0
        ends = la & lc
        found.append((a[ends], c[ends], low[ends], high[ends]))
        turn = ~ends & ~la & (lc | (one.radius[a] >= other.radius[c]))  # the wider of two inner nodes is opened
        rest = ~ends & ~turn
        a, c = (
            np.concatenate([one.left[a[turn]], one.right[a[turn]], a[rest], a[rest]]),
            np.concatenate([c[turn], c[turn], other.left[c[rest]], other.right[c[rest]]]),
        )
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
    a, c, low, high = map(np.concatenate, zip(*found, strict=True))
    by = np.lexsort((-high, a))
    return a[by], c[by], low[by], high[by]


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whole inner products; by floating point where that is exact."""
    most = x.shape[1] * (np.abs(x).max(initial=0) * np.abs(y).max(initial=0))
    return (x @ y.T).astype(np.int64) if most < 1 << 53 else x.astype(np.int64) @ y.astype(np.int64).T


class Best:
    """The k best (score falling, id rising) of several lists."""

    def __init__(self, lists: int, k: int):
        self.score, self.id, self.k = np.full((lists, k), _NONE), np.zeros((lists, k), np.int64), k

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Offers to lists; those below a list's worst should be left out before."""
        if not len(of):
            return
        some = np.unique(of)
        of = np.concatenate([of, np.repeat(some, self.k)])
        score, ids = np.concatenate([score, self.score[some].ravel()]), np.concatenate([ids, self.id[some].ravel()])
        real = score > _NONE
        of, score, ids = of[real], score[real], ids[real]
        by = np.lexsort((ids, -score, of))
        of, score, ids = of[by], score[by], ids[by]
        first = np.searchsorted(of, of)
        place = np.arange(len(of)) - first
        good = place < self.k
        self.score[of[good], place[good]], self.id[of[good], place[good]] = score[good], ids[good]


def _clean(batch: pa.RecordBatch, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: the places of the rows that take part, and their scaled components as floats."""
    column = batch.column("embedding")
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    own = np.floor(pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64) * p.scale)
    n = np.maximum(size, 0)
    starts = np.cumsum(n) - n
    of = np.repeat(np.arange(len(size)), n)
    limit = np.sqrt((1 << 62) / np.maximum(n, 1))
    bad = np.bincount(of[~(np.abs(own) <= limit[of])], minlength=len(size)) > 0  # not finite, or too large for a score of 64 bits
    good = (size >= 0) & ~bad
    for c in ("vec_id", "label"):
        good &= pc.is_valid(batch.column(c)).to_numpy(zero_copy_only=False)
    for wide in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == wide))
        yield rows, own[starts[rows, None] + np.arange(wide)]


def _cleaned(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in _clean(batch, p):
            part = batch.take(pa.array(rows))
            values = pa.array(x.astype(np.int64).ravel(), pa.int64())
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * x.shape[1], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), column], names=["vec_id", "label", "parts"])


def _sliced(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            held.append(batch.slice(i, 4096))
            n += held[-1].num_rows
            if n >= p.slice_rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _slices(batches: Iterator[pa.RecordBatch], labels: dict[str, int], p: Params) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows that take part, in slices of one length of vectors: (ids, numbers of labels or -1, components)."""
    for table in _sliced(batches, p):
        batch = table.combine_chunks().to_batches()[0] if table.num_rows else None
        for rows, x in _clean(batch, p) if batch is not None else ():
            part = batch.take(pa.array(rows))
            yield part.column("vec_id").to_numpy(), np.array([labels.get(v, -1) for v in part.column("label").to_pylist()], np.int64), x


@dataclass
class Anchors:
    """A chunk of anchors of one length of vectors: ids, numbers of labels, a tree of each label and one of all."""

    first: int
    ids: np.ndarray
    label: np.ndarray
    of_label: Tree
    all: Tree


def _positive(batches: Iterator[pa.RecordBatch], sent, p: Params) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) -> (anchor, score, id): for the anchors of the chunk, the task's best of their label."""
    groups, labels, total = sent.value["groups"], sent.value["labels"], sent.value["total"]
    best = Best(total, p.positives)
    for ids, label, x in _slices(batches, labels, p):
        g = groups.get(x.shape[1])
        if g is None:
            continue
        mine = slice(g.first, g.first + len(g.ids))
        roots = np.unique(g.label)
        parts = [np.flatnonzero(label == v) for v in roots.tolist()]
        tree = Tree(x, p.leaf_rows, parts)
        start = np.array([i for i, part in enumerate(parts) if len(part)], np.int64)
        least = g.of_label.fold(best.worst()[mine], np.min)
        pairs = _leaf_pairs(g.of_label, tree, start, start, lambda a, low, high: high >= least[a])  # noqa: B023
        _score(g.of_label, tree, pairs, lambda who, s, cand: _offer_positive(best, g, who, s, ids[cand]), lambda who: best.worst()[g.first + who].min())  # noqa: B023
    yield from _told(best, np.arange(total), p.positives, None)


def _offer_positive(best: Best, g: Anchors, who: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
    i, j = np.nonzero((s >= best.worst()[g.first + who][:, None]) & (ids[None] != g.ids[who][:, None]))
    best.add(g.first + who[i], s[i, j], ids[j])


def _score(one: Tree, other: Tree, pairs, offer: Callable, worst: Callable, rows: int = 1024) -> None:
    """Scores leaf pairs, an anchor leaf after the other, and its rows by falling bounds until none can help."""
    a, c, _, high = pairs
    cuts = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)] if len(a) else [0]
    for s, e in zip(cuts, cuts[1:]):
        lo, hi = one.spans[a[s]]
        who, x = one.order[lo:hi], one.rows[lo:hi]
        at = s
        while at < e and high[at] >= worst(who):
            spans = []
            while at < e and sum(b - k for k, b in spans) < rows:
                spans.append(other.spans[c[at]].tolist())
                at += 1
            cand = np.concatenate([np.arange(k, b) for k, b in spans])
            offer(who, _scores(x, other.rows[cand]), other.order[cand])


def _told(best: Best, lists: np.ndarray, k: int, place: int | None) -> Iterator[pa.RecordBatch]:
    """What lists hold, as rows (anchor, score, id), with the place of the positive where there are several lists of an anchor."""
    for i in range(0, len(lists), 8192):
        part = lists[i : i + 8192]
        row, col = np.nonzero(best.score[part] > _NONE)
        of = part[row]
        columns, names = [pa.array(of if place is None else of // place), pa.array(best.score[of, col]), pa.array(best.id[of, col])], ["anchor", "score", "id"]
        if place is not None:
            columns, names = [*columns, pa.array((of % place).astype(np.int32))], [*names, "place"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _negative(batches: Iterator[pa.RecordBatch], sent, p: Params) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) -> (anchor, score, id, place): the task's best of other labels in each window."""
    groups, labels, total = sent.value["groups"], sent.value["labels"], sent.value["total"]
    low, high = sent.value["low"], sent.value["high"]  # a window for each anchor and place; empty ones have low > high
    k = p.positives
    best = Best(total * k, p.negatives)
    for ids, label, x in _slices(batches, labels, p):
        g = groups.get(x.shape[1])
        if g is None:
            continue
        mine = slice(g.first, g.first + len(g.ids))
        raised = np.maximum(low[mine], best.worst().reshape(-1, k)[mine])
        some = raised <= high[mine]
        least = g.all.fold(np.where(some, raised, np.iinfo(np.int64).max).min(axis=1), np.min)
        most = g.all.fold(np.where(some, high[mine], _NONE).max(axis=1), np.max)
        tree = Tree(x, p.leaf_rows)
        root = np.zeros(1, np.int64)
        pairs = _leaf_pairs(g.all, tree, root, root, lambda a, lo, hi: (hi >= least[a]) & (lo <= most[a]))  # noqa: B023

        def offer(who: np.ndarray, s: np.ndarray, cand: np.ndarray) -> None:
            other = (label[cand][None] != g.label[who][:, None]) & (ids[cand][None] != g.ids[who][:, None])  # noqa: B023
            for w in range(k):
                of = (g.first + who) * k + w  # noqa: B023
                floor = np.maximum(low[g.first + who, w], best.worst()[of])  # noqa: B023
                i, j = np.nonzero((s >= floor[:, None]) & (s <= high[g.first + who, w][:, None]) & other)  # noqa: B023
                best.add(of[i], s[i, j], ids[cand][j])  # noqa: B023

        def worst(who: np.ndarray) -> int:
            at = g.first + who  # noqa: B023
            floor = np.maximum(low[at], best.worst().reshape(-1, k)[at])
            return np.where(floor <= high[at], floor, np.iinfo(np.int64).max).min()

        _score(g.all, tree, pairs, offer, worst)
    yield from _told(best, np.arange(total * k), p.negatives, k)


def _chunk(rows: list, p: Params) -> tuple[dict, list]:
    """Anchors (vec_id, label, parts) -> what the tasks get, and the ids in the order of their numbers."""
    labels = {v: i for i, v in enumerate(sorted({r["label"] for r in rows}))}
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r["parts"]), []).append(r)
    groups, ids = {}, []
    for wide, part in by_size.items():
        x = np.array([r["parts"] for r in part], np.float64).reshape(len(part), wide)
        label = np.array([labels[r["label"]] for r in part], np.int64)
        of_label = [np.flatnonzero(label == v) for v in np.unique(label).tolist()]
        own = np.array([r["vec_id"] for r in part], np.int64)
        groups[wide] = Anchors(len(ids), own, label, Tree(x, p.leaf_anchors, of_label), Tree(x, p.leaf_anchors))
        ids += own.tolist()
    return {"groups": groups, "labels": labels, "total": len(ids)}, ids


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, anchors: str = "vec_id % 100 = 0", id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", params: Params = Params()) -> DataFrame:
    """vectors -> (anchor_id, positive_id, rank int, negative_id, positive_score, negative_score), ids and scores long.

    Ids are integers. Rows that fulfil `anchors` (SQL on vec_id and label) are anchors; all rows are candidates. A score
    is the whole inner product of the scaled vectors; only those of one length are compared. The positives of an anchor
    are the best other rows of its label, the negatives of a positive the best rows of other labels in its window; both
    by score, then by least id.

    Rows without an id, a label or a vector, and those with a null or non-finite component, take no part; neither do
    rows with a component so large (2^31 / sqrt(length) after scaling) that a score might pass 64 bits. Empty vectors
    have scores of 0 among each other. A row that repeats an id is a candidate of its own, but never for an anchor of
    its id; of several anchors with one id, the one of least label, then vector, counts. Other columns are ignored; an
    empty table gives an empty result.
    """
    p, spark = params, vectors.sparkSession
    own = rename_columns(vectors, vec_id=id_col, label=label_col, embedding=vector_col)
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    chosen = own.where(anchors).mapInArrow(partial(_cleaned, p=p), "vec_id long, label string, parts array<long>")
    chosen = written(chosen.groupBy("vec_id").agg(F.min(F.struct("label", "parts")).alias("r")).select("vec_id", "r.label", "r.parts"))
    n, wide = chosen.agg(F.count("*"), F.coalesce(F.max(F.size("parts")), F.lit(1))).first()
    chunks = max(1, -(-n * max(wide, 1) * 8 // p.chunk_bytes))
    # Trees of small partitions would be small, and each task reports for each anchor.
    own = own.coalesce(max(spark.sparkContext.defaultParallelism, -(-own.count() // p.task_rows)))
    parts = []
    for i in range(chunks if n else 0):
        rows = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == i).collect()  # of about chunk_bytes
        chunk, ids = _chunk(rows, p)
        sent = spark.sparkContext.broadcast(chunk)
        best = own.mapInArrow(partial(_positive, sent=sent, p=p), "anchor long, score long, id long")
        best = written(_ranked(best, ["anchor"], p.positives))
        k = p.positives
        low, high = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -1, np.int64)
        for anchor, score, place in best.select("anchor", "score", "rank").collect():  # k for each anchor of the chunk
            low[anchor, place - 1], high[anchor, place - 1] = -(-p.low * score // 100), p.high * score // 100
        windows = spark.sparkContext.broadcast(chunk | {"low": low, "high": high})
        found = own.mapInArrow(partial(_negative, sent=windows, p=p), "anchor long, score long, id long, place int")
        found = _ranked(found, ["anchor", "place"], p.negatives).select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        named = spark.createDataFrame(pa.table({"anchor": pa.array(range(len(ids)), pa.int64()), "anchor_id": pa.array(ids, pa.int64())}))
        positives = best.select("anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = found.join(positives, ["anchor", "place"]).join(named, "anchor")
        parts.append(written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")))
        discard(best)
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], _OUT)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
