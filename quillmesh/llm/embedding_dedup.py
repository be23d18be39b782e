"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine verification, connected components.

1. Equal vectors of a label form a class; its least id stands for it, with the class's size as its weight.
2. In each table, a class's signs against the table's hyperplanes (and its label) name a bucket. What goes to a bucket is
   a class's id and a sketch of it: signs against some more hyperplanes. No vector moves for it. Tables come in rounds,
   one after the other, so that the rows of one round are shuffled at once: about as many bytes as the vectors have.
3. Members of a bucket are compared by their sketches; only pairs whose sketches differ in few signs go on. A bucket lists
   them, and each pair is compared once in the end, whatever the number of tables it meets in. Where they are many for a
   bucket's members, those members are compared there, in blocks: block x with block y, a task's group holding two blocks
   at most, whatever the bucket's size. A pair counts in the first table only in which it meets. What leaves a group is a
   row for each member: how many vectors it links with there, and the least member it is connected with.
4. Sums give the links; components of the connections give the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collected, discard, mix64, packed, rename_columns, slices, unpacked, written
from .components import components

#: Bytes of a class in a table; bytes that a round may shuffle if the vectors are fewer; rows that a task takes of a round,
#: and that are packed at once; members up to which buckets are compared together; ids that are broadcast.
DEALT_BYTES, ROOM, TAKEN, PACKED, TOGETHER, SENT = 44, 1 << 28, 1 << 18, 1 << 18, 32, 1_000_000


@dataclass(frozen=True)
class Params:
    """bits, tables: of a signature, and how many there are; for None they follow from the rows of the most frequent
    label: so many bits that a bucket of unlike vectors holds about `bucket` (16 at least, 32 at most), and so many
    tables (at most 1000) that a pair of the least similarity shares no bucket with a probability of `miss` at most: 48
    tables for 16 bits. passes: so many times as many tables, one after the other, so that all of them miss such a pair
    with miss ** passes. few: members of a bucket whose pairs are listed in any case, so that other buckets list few / 2
    for each member at most. block: members of those that don't, compared in one piece; up to eight times as many, so
    that four pieces do for a bucket as long as that goes. sketch, lost: signs of a sketch,
    and the probability that those of a pair of the least similarity differ in too many for it to go on."""

    similarity: float = 0.93
    tables: int | None = None
    bits: int | None = None
    bucket: int = 64
    miss: float = 0.00135
    passes: int = 3
    few: int = 6
    block: int = 1024
    sketch: int = 256
    lost: float = 1e-12
    seed: int = 20240

    def sized(self, rows: int) -> Params:
        """These parameters with bits and tables (of a pass) for so many rows of one label."""
        bits = self.bits or min(32, max(16, math.ceil(math.log2(max(rows, 1) / self.bucket))))
        share = (1 - math.acos(self.similarity) / math.pi) ** bits
        return replace(self, bits=bits, tables=self.tables or min(1000, math.ceil(math.log(self.miss) / math.log1p(-share))))

    @property
    def all_tables(self) -> int:
        return self.tables * self.passes

    @property
    def far(self) -> int:
        """In how many signs two sketches may differ."""
        q, tail, k = math.acos(self.similarity) / math.pi, 0.0, self.sketch
        while k > 0 and (tail := tail + math.comb(self.sketch, k) * q**k * (1 - q) ** (self.sketch - k)) <= self.lost:
            k -= 1
        return k


def _code(p: Params) -> str:
    return "<u2" if p.bits <= 16 else "<u4"


def _tabs(p: Params, turn: int, rounds: int = 1) -> range:
    """The tables of a round, of which each pass has so many."""
    return range(turn * p.tables // rounds, (turn + 1) * p.tables // rounds)


def _planes(dim: int, p: Params) -> np.ndarray:
    return np.random.default_rng([p.seed, dim]).standard_normal((dim, p.all_tables * p.bits))


def _codes(x: np.ndarray, planes: np.ndarray, p: Params, tabs: range) -> np.ndarray:
    """Bucket numbers in these tables of vectors whose largest component is 1 or -1."""
    out, own = np.zeros((len(x), len(tabs)), _code(p)), planes[:, tabs.start * p.bits : tabs.stop * p.bits]
    for k in range(0, len(x) if tabs else 0, 1024):
        signs = (x[k : k + 1024] @ own > 0).reshape(-1, len(tabs), p.bits)
        signs = np.pad(signs, ((0, 0), (0, 0), (0, 8 * out.itemsize - p.bits)))
        out[k : k + 1024] = np.packbits(signs, axis=2, bitorder="little").view(_code(p))[:, :, 0]
    return out


def _scaled(column: pa.Array, dtype: str) -> np.ndarray:
    """Vectors of one length, each with a largest component of 1 or -1."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1).astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signed(batches: Iterator[pa.RecordBatch], p: Params, dtype: str, tabs: range | None = None) -> Iterator[pa.RecordBatch]:
    """Per vector: a key of its class (zeros if it links with nothing), a key of what it is compared with, itself as bytes,
    its sketch, its bucket numbers (in these tables, or all)."""
    tabs = range(p.all_tables) if tabs is None else tabs
    planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in slices(batches, 512):
        n = batch.num_rows
        k1, k2, peers, raw, sketches, codes = [0] * n, [0] * n, [0] * n, [None] * n, [None] * n, [None] * n
        labels, column = batch.column("label").to_pylist(), batch.column("embedding")
        values, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()  # nulls within are NaN
        length = np.where(column.is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False), np.diff(starts), 0)
        for dim in np.unique(length[length > 0]).tolist():
            rows = np.flatnonzero(length == dim)
            x = values[starts[rows, None] + np.arange(dim)].astype(np.float64)
            size = np.abs(x).max(axis=1)
            good = np.isfinite(size) & (size > 0)
            x, rows = x[good] + 0.0, rows[good].tolist()
            if dim not in planes:
                planes[dim] = _planes(dim, p), np.random.default_rng([p.seed, dim, 1]).standard_normal((dim, p.sketch))
            scaled = x / size[good, None]
            code = _codes(scaled, planes[dim][0], p, tabs)
            sketch = np.packbits(scaled @ planes[dim][1] > 0, axis=1)
            x = x.astype(dtype)
            for j, i in enumerate(rows):
                raw[i], sketches[i], codes[i] = x[j].tobytes(), sketch[j].tobytes(), code[j].tobytes()
                of = f"{dim}|{labels[i]}|".encode()
                peers[i] = int.from_bytes(xxhash.xxh64_digest(of), "little", signed=True)
                key = xxhash.xxh3_128_digest(of + raw[i])
                k1[i], k2[i] = (int.from_bytes(part, "little", signed=True) for part in (key[:8], key[8:]))
        columns = [batch.column("vec_id"), *(pa.array(c, pa.int64()) for c in (k1, k2, peers)), *(pa.array(c, pa.binary()) for c in (raw, sketches, codes))]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "k1", "k2", "peers", "vector", "sketch", "codes"])


def _bucketed(batches: Iterator[pa.RecordBatch], p: Params, turn: int, rounds: int = 1) -> Iterator[pa.RecordBatch]:
    """Classes (rep, peers, codes) -> (rep, tab, bucket) in the tables of a round, of which each pass has so many."""
    tabs = _tabs(p, turn, rounds)
    for batch in slices(batches, 2048):
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), _code(p)).reshape(-1, p.all_tables)[:, tabs.start : tabs.stop].astype(np.uint64)
        keys = batch.column("peers").to_numpy().view(np.uint64)
        tab = np.arange(tabs.start, tabs.stop, dtype=np.uint64)
        bucket = (keys[:, None] ^ (codes << np.uint64(16) | tab) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("rep").to_numpy(), len(tabs))), pa.array(np.tile(tab.astype(np.int32), len(keys))), pa.array(bucket.ravel())], names=["rep", "tab", "bucket"])


def _dealt(batches: Iterator[pa.RecordBatch], p: Params, dtype: str, turn: int, rounds: int, places: int) -> Iterator[pa.RecordBatch]:
    """Classes (rep, peers, vector, sketch) -> (place, data, sketches): what of their rows in a round's tables goes to a
    place, packed."""
    tabs, planes, held = _tabs(p, turn, rounds), {}, []

    def blocks() -> pa.RecordBatch:
        bucket, rep, tab, sketch = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.argsort(bucket)
        bucket, rep, tab, sketch = bucket[order], rep[order], tab[order], sketch[order]
        place = (mix64(bucket) >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)
        order = np.argsort(place, kind="stable")
        bucket, rep, tab, sketch, place = bucket[order], rep[order], tab[order], sketch[order], place[order]
        cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
        cuts = list(zip(cuts[:-1], cuts[1:], strict=True))
        data = [packed(bucket[a:b], rep[a:b], tab[a:b]) for a, b in cuts], [sketch[a:b].tobytes() for a, b in cuts]
        return pa.RecordBatch.from_arrays([pa.array(place[[a for a, _ in cuts]].astype(np.int32)), *(pa.array(d, pa.binary()) for d in data)], names=["place", "data", "sketches"])

    for batch in slices(batches, 2048):
        sizes = pc.binary_length(batch.column("vector"))
        for n in pc.unique(sizes).to_pylist():
            own = batch.filter(pc.equal(sizes, n))
            x = _scaled(own.column("vector"), dtype)
            if n not in planes:
                planes[n] = _planes(x.shape[1], p)
            codes = np.zeros((len(x), p.all_tables), _code(p))
            codes[:, tabs.start : tabs.stop] = _codes(x, planes[n], p, tabs)
            coded = pa.RecordBatch.from_arrays([own.column("rep"), own.column("peers"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["rep", "peers", "codes"])
            sketch = np.frombuffer(b"".join(own.column("sketch").to_pylist()), f"V{p.sketch // 8}")
            for rows in _bucketed(iter([coded]), p, turn, rounds):
                held.append((rows.column("bucket").to_numpy().view(np.uint64), rows.column("rep").to_numpy(), rows.column("tab").to_numpy().astype("<u2"), np.repeat(sketch, len(tabs))))
        if sum(len(rows[0]) for rows in held) >= PACKED:
            yield blocks()
    if held:
        yield blocks()


def _near(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """What came to some places -> (a, b, bucket, blocks, tab): pairs that buckets list (blocks is 0), and members a of the
    buckets whose pairs are too many, to be compared in so many blocks."""
    kind = f"V{p.sketch // 8}"
    blocks = [(*unpacked(data, "<i8", "<u2"), np.frombuffer(own, kind)) for batch in batches for data, own in zip(*(batch.column(c).to_pylist() for c in ("data", "sketches")), strict=True)]
    if not blocks:
        return
    bucket, rep, tab, sketch = (np.concatenate(c) for c in zip(*blocks, strict=True))
    del blocks
    order = np.argsort(bucket)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(bucket)]])
    order = order[np.repeat(np.diff(cuts) > 1, np.diff(cuts))]  # buckets of one member fall away
    if not len(order):
        return
    bucket, rep, tab = bucket[order], rep[order], tab[order]
    words = np.ascontiguousarray(sketch[order].view(np.uint64 if p.sketch % 64 == 0 else np.uint8).reshape(len(order), -1).T)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    size = np.diff(cuts)
    far = p.far

    def pairs(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        keep = (tab[i] == tab[j]) & (rep[i] != rep[j])  # they differ only where buckets clash
        i, j = i[keep], j[keep]
        none = np.zeros(len(i), np.int64)
        return named(np.minimum(rep[i], rep[j]), pa.array(np.maximum(rep[i], rep[j])), none, none, tab[i])

    def members(i: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return named(rep[i], pa.nulls(len(i), pa.int64()), bucket[i].view(np.int64), -(-n // np.clip(-(-n // 4), p.block, 8 * p.block)), tab[i])

    def named(a: np.ndarray, b: pa.Array, of: np.ndarray, n: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(of), pa.array(n.astype(np.int32)), pa.array(t.astype(np.int32))], names=["a", "b", "bucket", "blocks", "tab"])

    # Buckets of a few members together: each row with the one d places on.
    of, end = np.repeat(np.arange(len(size)), size), np.repeat(cuts[1:], size)
    i, d, first, second = np.flatnonzero(size[of] <= TOGETHER), 1, [], []
    while len(i := i[i + d < end[i]]):
        differ = sum(np.bitwise_count(w[i] ^ w[i + d]).astype(np.uint16) for w in words)
        good = i[differ <= far]
        first.append(good), second.append(good + d)
        d += 1
    if first:
        i, j = np.concatenate(first), np.concatenate(second)
        many = 2 * np.bincount(of[i], minlength=len(size)) > p.few * size
        yield pairs(i[~many[of[i]]], j[~many[of[i]]])
        moved = np.unique(np.concatenate([i[many[of[i]]], j[many[of[i]]]]))
        if len(moved):
            yield members(moved, np.bincount(of[moved], minlength=len(size))[of[moved]])

    for k in np.flatnonzero(size > TOGETHER).tolist():
        rows = np.arange(cuts[k], cuts[k + 1])
        if len(rows) > p.block:
            yield members(rows, np.full(len(rows), len(rows)))
            continue
        w, first, second = words[:, rows], [], []
        for lo in range(0, len(rows), 64):
            differ = sum(np.bitwise_count(v[lo : lo + 64, None] ^ v).astype(np.uint16) for v in w)
            i, j = np.nonzero(differ <= far)
            first.append(i[i + lo < j] + lo), second.append(j[i + lo < j])
        i, j = np.concatenate(first), np.concatenate(second)
        if 2 * len(i) <= p.few * len(rows):
            yield pairs(rows[i], rows[j])
        else:
            moved = rows[np.unique(np.concatenate([i, j]))]
            yield members(moved, np.full(len(moved), len(moved)))


def _met(codes: np.ndarray, i: np.ndarray, j: np.ndarray, tab: np.ndarray) -> np.ndarray:
    """Whether rows i and j share a bucket in a table before tab. codes: by tables, then rows."""
    before = np.arange(len(codes))[:, None]
    parts = [((codes[:, i[k : k + 65536]] == codes[:, j[k : k + 65536]]) & (before < tab[k : k + 65536])).any(axis=0) for k in range(0, len(i), 65536)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _pairs(cuts: list[int], v: np.ndarray, own: np.ndarray, x: np.ndarray, y: np.ndarray, tab: np.ndarray, codes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j (or of block x and block y) of one group whose cosine reaches least and that haven't met in a table before
    tab; v has unit rows. Groups of a few rows are compared all at once, one place with another; larger ones each by
    products of 256 rows."""
    lo, size = np.array(cuts[:-1]), np.diff(cuts)
    first, second = [], []

    def found(i: np.ndarray, j: np.ndarray) -> None:
        new = ~_met(codes, i, j, tab[i])
        first.append(i[new]), second.append(j[new])

    for s in range(2, 9):
        at = lo[size == s]
        at = at[x[at] == y[at]]
        for i in range(s - 1) if len(at) else ():
            for j in range(i + 1, s):
                good = at[np.einsum("ij,ij->i", v[at + i], v[at + j]) >= least]
                found(good + i, good + j)
    for a, n in zip(lo.tolist(), size.tolist(), strict=True):
        within = x[a] == y[a]
        if n < 2 or (within and n < 9):
            continue
        rows = np.arange(a, a + n)
        left, right = (rows, rows) if within else (rows[own[rows] == x[a]], rows[own[rows] == y[a]])
        there = np.ascontiguousarray(codes[: tab[a], right])
        for k in range(0, len(left), 256):
            part = left[k : k + 256]
            good = v[part] @ v[right].T >= least
            if within:
                good &= part[:, None] < right
            if 16 * np.count_nonzero(good) < good.size:
                i, j = np.nonzero(good)
                found(part[i], right[j])
                continue
            for here, c in zip(codes[: tab[a], part], there, strict=True):  # most of them link: table by table, all at once
                good &= here[:, None] != c
            i, j = np.nonzero(good)
            first.append(part[i]), second.append(right[j])
    return (np.concatenate(first), np.concatenate(second)) if first else (np.empty(0, np.int64),) * 2


def _compared(batches: Iterator[pa.RecordBatch], p: Params, dtype: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, x, y) -> (rep, links, root) of the members that link in a group."""
    held: pa.Table | None = None
    planes: dict[int, np.ndarray] = {}

    def groups(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = pc.binary_length(t.column("vector"))
        for n in pc.unique(sizes).to_pylist():  # lengths meet only where buckets clash
            yield group(t.filter(pc.equal(sizes, n)).combine_chunks())

    def group(t: pa.Table) -> pa.RecordBatch:
        rep, weight, own, x, y, tab = (t.column(c).to_numpy() for c in ("rep", "weight", "own", "x", "y", "tab"))
        key = np.stack([t.column(c).to_numpy() for c in ("bucket", "x", "y")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
        scaled = _scaled(t.column("vector"), dtype)
        dim = scaled.shape[1]
        if dim not in planes:
            planes[dim] = _planes(dim, p)
        codes = np.ascontiguousarray(_codes(scaled, planes[dim], p, range(int(tab.max()))).T)
        i, j = _pairs(cuts, _unit(scaled), own, x, y, tab, codes, p.similarity)
        links = np.bincount(i, weight[j], len(rep)).astype(np.int64) + np.bincount(j, weight[i], len(rep)).astype(np.int64)
        root, before = rep.copy(), None
        while before is None or (root != before).any():
            before = root.copy()
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (rep, links, root)], names=["rep", "links", "root"])

    for batch in slices(batches, 4096):
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        key = np.stack([t.column(c).to_numpy() for c in ("bucket", "x", "y")])
        last = np.flatnonzero((key != key[:, -1:]).any(axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from groups(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield from groups(held)


def _checked(batches: Iterator[pa.RecordBatch], p: Params, dtype: str, moved: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, tab, and of each weight, vector) -> (rep, links, root) of both members of those that link, if they
    haven't met in a table before tab (where members were compared, so that pairs that weren't listed may count there)."""
    planes: dict[int, np.ndarray] = {}
    for batch in slices(batches, 4096):
        t = pa.Table.from_batches([batch])
        sizes = [pc.binary_length(t.column(f"vector_{k}")) for k in "ab"]
        t, size = t.filter(pc.equal(*sizes)), sizes[0].filter(pc.equal(*sizes))  # lengths differ only where buckets clash
        for n in pc.unique(size).to_pylist():
            own = t.filter(pc.equal(size, n)).combine_chunks()
            a, b, tab, wa, wb = (own.column(c).to_numpy() for c in ("a", "b", "tab", "weight_a", "weight_b"))
            va, vb = (_scaled(own.column(f"vector_{k}"), dtype) for k in "ab")
            good = np.flatnonzero(np.einsum("ij,ij->i", _unit(va), _unit(vb)) >= p.similarity)
            if moved:
                dim = va.shape[1]
                if dim not in planes:
                    planes[dim] = _planes(dim, p)
                good, new = good[np.argsort(tab[good], kind="stable")], []
                for k in range(0, len(good), 256):  # most pairs meet in one of the first tables
                    some = good[k : k + 256]
                    tabs = range(int(tab[some].max()))
                    met = _codes(va[some], planes[dim], p, tabs) == _codes(vb[some], planes[dim], p, tabs)
                    new.append(some[~(met & (np.arange(len(tabs)) < tab[some, None])).any(axis=1)])
                good = np.concatenate(new) if new else good
            a, b, wa, wb = a[good], b[good], wa[good], wb[good]
            root = np.minimum(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((a, b), (wb, wa), (root, root))], names=["rep", "links", "root"])


LINKED = "rep long, links long, root long"


def _candidates(classes: DataFrame, p: Params, dtype: str, turn: int, rounds: int, rows: int) -> DataFrame:
    """(a, b, bucket, blocks, tab) of a round: pairs, and members to be compared in blocks."""
    tasks = -(-rows * len(_tabs(p, turn, rounds)) // TAKEN)
    dealt = classes.select("rep", "peers", "vector", "sketch").mapInArrow(partial(_dealt, p=p, dtype=dtype, turn=turn, rounds=rounds, places=max(256, 2 * tasks)), "place int, data binary, sketches binary")
    dealt = dealt.repartition(max(tasks, 2 * classes.sparkSession.sparkContext.defaultParallelism), "place")
    near = dealt.mapInArrow(partial(_near, p=p), "a long, b long, bucket long, blocks int, tab int")
    return written(near.groupBy("a", "b", "bucket", "blocks").agg(F.min("tab").alias("tab")))


def _within(members: DataFrame, classes: DataFrame, p: Params, dtype: str) -> DataFrame:
    """(rep, links, root) of the members that link in their buckets and have met in no table before."""
    if members.count() <= SENT:
        classes = classes.join(F.broadcast(members.select("rep").distinct()), "rep", "left_semi")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "tab", "rep").join(classes.select("rep", "weight", "vector"), "rep")
    return written(dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(partial(_compared, p=p, dtype=dtype), LINKED))


def _linked(classes: DataFrame, p: Params, dtype: str) -> DataFrame:
    """(rep, links, root) of the classes that link, a row or more of each."""
    spark = classes.sparkSession
    rows, size = classes.agg(F.count("*"), F.coalesce(F.sum(F.length("vector")), F.lit(0))).first()
    room = max(ROOM, size)
    rounds = min(p.tables, max(1, -(-rows * p.tables * DEALT_BYTES // room)))
    listed, found = [], []
    for turn in range(p.passes * rounds):
        near = _candidates(classes, p, dtype, turn, rounds, rows)
        members = near.where("blocks > 0").select(F.col("a").alias("rep"), "bucket", "blocks", "tab")
        if not members.isEmpty():
            found.append(_within(members, classes, p, dtype))
        listed.append(near)
        collected(spark)

    pairs = written(reduce(DataFrame.union, listed).where("blocks = 0").groupBy("a", "b").agg(F.min("tab").alias("tab")))
    discard(*listed)
    # A slice's vectors of both sides, and its pairs with those of one, are no more than the room.
    n, moved = pairs.count(), bool(found)
    cut = 1 if 2 * size + n * size // max(rows, 1) <= room else math.ceil(1 + math.sqrt(1 + n / rows))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(cut))
    of = lambda k: classes.select(F.col("rep").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("weight", "vector")))
    for x in range(cut):
        for y in range(cut):
            some, left, right = pairs.where((slot("a") == x) & (slot("b") == y)), of("a").where(slot("a") == x), of("b").where(slot("b") == y)
            found.append(written(some.join(left, "a").join(right, "b").mapInArrow(partial(_checked, p=p, dtype=dtype, moved=moved), LINKED)))
            if cut > 1:
                collected(spark)
    discard(pairs)
    return reduce(DataFrame.union, found)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", params: Params = Params()) -> DataFrame:
    """vectors -> (vec_id, n_links, component_id long, kept boolean), one row per row.

    Ids must be integers. Only vectors of one label and length are compared; those that are null, empty, zero or hold
    null or non-finite components, and those without a label, link with nothing. A null id counts as a vector for
    others' links only if its vector is a copy of one with an id; it has no links, a null component, and is kept. Rows
    that repeat an id are vectors each. Other columns are ignored; an empty table gives an empty result.
    """
    own = rename_columns(vectors, vec_id=id_col, embedding=vector_col, label=label_col)
    p = params.sized(own.where("label is not null").groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
    dtype = "<f4" if dict(own.dtypes)["embedding"] == "array<float>" else "<f8"
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    signed = own.mapInArrow(partial(_signed, p=p, dtype=dtype, tabs=range(0)), "vec_id long, k1 long, k2 long, peers long, vector binary, sketch binary, codes binary").drop("codes")
    made = written(signed.select("vec_id", F.col("vector").isNotNull().alias("linkable"), "k1", "k2"))
    named = written(made.where("linkable").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).where("rep is not null"))
    # Vectors are stored once, of each class one; only those of classes of several rows are looked for.
    several = written(named.where("weight > 1"))
    kept = ["rep", "weight", "peers", "vector", "sketch"]
    one = signed.where("vector is not null and vec_id is not null").join(several.select("k1", "k2"), ["k1", "k2"], "left_anti").withColumns({"rep": F.col("vec_id"), "weight": F.lit(1).cast("long")})
    more = signed.withColumn("rep", F.col("vec_id")).join(several, ["k1", "k2", "rep"]).groupBy("k1", "k2").agg(*(F.first(c).alias(c) for c in kept))
    classes = written(one.select(kept).union(more.select(kept)))
    discard(several)
    collected(classes.sparkSession)

    found = _linked(classes, p, dtype)
    discard(classes)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")

    # Rows that link with nothing have a key of their own each, so that they don't meet in one partition.
    named = named.join(links, "rep", "left").join(comp, "rep", "left")
    named = named.select("k1", "k2", F.lit(True).alias("linkable"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("c"))
    out = made.select("vec_id", "linkable", F.when(F.col("linkable"), F.col("k1")).otherwise(F.xxhash64("vec_id")).alias("k1"), "k2")
    out = out.join(named, ["k1", "k2", "linkable"], "left")
    has_id = F.col("vec_id").isNotNull()
    out = out.select("vec_id", F.when(has_id, F.coalesce("links", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("n_links"), F.when(has_id, F.coalesce("c", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS least FROM ok UNION SELECT links.b, reach.least FROM reach JOIN links ON links.a = reach.node)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, coalesce(c.least, e.vec_id) AS component_id, coalesce(c.least, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT node, min(least) AS least FROM reach GROUP BY node) c ON c.node = e.vec_id
"""
