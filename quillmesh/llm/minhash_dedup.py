"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

Stages, all linear in the number of documents unless different texts really are that many near copies:

1. Per document, the distinct word shingles are hashed to 64 bits and sketched (fast similarity sketching: rounds
   0..t-1 throw every shingle into a random coordinate, rounds t..2t-1 throw all shingles into coordinate i - t, and
   a coordinate keeps the least value of the first round that reaches it, so all t coordinates fill).
2. Rows with equal shingle sets form a class with a number of its own; one row's text stands for it. Ids play no part
   until the end, when a component is named after its least doc_id, so that an id may occur with several texts.
3. Bands of the sketch are buckets. In each bucket, the member with most company over all buckets is the pivot, and
   every member is a candidate with its pivot (a star, not all pairs).
4. Candidates whose sketches agree enough are verified on the full shingle sets of their texts; what verifies is
   linked. First each document with its likeliest pivot, then the candidates that are still in different components.
5. Buckets that still hold several components are compared in full by larger sketches, block by block, across
   components only, and verified there on the shingle sets until nothing is left to join. So no link between different
   texts is lost to the star, no bucket is gathered in one task, and a block gives fewer links than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hub_bound, hub_join, mix64, rename_columns, slices, texts, written
from .components import components


@dataclass(frozen=True)
class Params:
    """width: words in a shingle. similarity: in hundredths. bands * rows: sketch coordinates. block, block_bytes:
    members of a bucket, and bytes of their shingle sets, that are compared in one piece. margin: how far (in standard deviations of the estimate) below the
    similarity a sketch may fall and still be verified. fine, fine_margin: the same for the larger sketch that the
    members of buckets with several components get."""

    width: int = 5
    similarity: int = 75
    bands: int = 25
    rows: int = 4
    block: int = 256
    margin: float = 5.0
    fine: int = 512
    fine_margin: float = 4.0
    block_bytes: int = 32 << 20

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Coordinates that must agree for a pair to be verified."""
        return _least(self.similarity / 100, self.size, self.margin)

    @property
    def least_fine(self) -> int:
        return _least(self.similarity / 100, self.fine, self.fine_margin)


def _least(similarity: float, size: int, margin: float) -> int:
    return int(size * (similarity - margin * (similarity * (1 - similarity) / size) ** 0.5))


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, without words none.

    Words are runs of characters other than ASCII white space, A-Z lowered."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = mix64(h ^ w[j : len(w) - k + 1 + j])
    return np.unique(h)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """The fast similarity sketch of a set of 64-bit hashes: t values, all filled unless the set is empty."""
    out = np.zeros(t, np.uint64)
    if not len(elements):
        return out
    empty = np.ones(t, bool)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in range(t):
        v = mix64(elements + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        where = ((v >> np.uint64(32)) % np.uint64(t)).astype(np.int64)
        least = np.full(t, top)
        np.minimum.at(least, where, v)
        new = empty & (least != top)
        out[new] = mix64(least[new] + np.uint64(i))
        empty &= ~new
        if not empty.any():
            return out
    for j in np.flatnonzero(empty):
        i = t + int(j)
        out[j : j + 1] = mix64(mix64(elements + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).min(keepdims=True) + np.uint64(i))
    return out


def _sketched(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n, k1, k2, marks, bands = [], [], [], [], []
        for text in texts(batch.column("text")):
            s = shingles(text, p.width)
            n.append(len(s))
            if not len(s):
                k1.append(0), k2.append(0), marks.append(b""), bands.append([])
                continue
            key = xxhash.xxh3_128_digest(s.tobytes())
            k1.append(int.from_bytes(key[:8], "little", signed=True))
            k2.append(int.from_bytes(key[8:], "little", signed=True))
            v = sketch(s, p.size)
            marks.append((v & np.uint64(255)).astype(np.uint8).tobytes())
            b = v.reshape(p.bands, p.rows)
            h = np.arange(1, p.bands + 1, dtype=np.uint64)
            for j in range(p.rows):
                h = mix64(h ^ b[:, j])
            bands.append(h.view(np.int64))
        keep = [c for c in batch.schema.names if c != "text"]
        made = [*(pa.array(x, pa.int64()) for x in (n, k1, k2)), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*map(batch.column, keep), *made], names=[*keep, "n_shingles", "k1", "k2", "marks", "bands"])


def _finely(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """(rep, text) -> (rep, marks) of the larger sketch, with the shingle set itself."""
    for batch in slices(batches):
        sets = [shingles(t, p.width) for t in texts(batch.column("text"))]
        marks = [(sketch(s, p.fine) & np.uint64(255)).astype(np.uint8).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(marks, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "marks", "shingles"])


def _marks(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def _alike(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, ma, mb), those whose sketches agree enough, with the number of equal coordinates."""
    for batch in slices(batches, 4096):
        equal = (_marks(batch.column("ma"), p.size) == _marks(batch.column("mb"), p.size)).sum(axis=1)
        keep = np.flatnonzero(equal >= p.least_equal)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(equal[keep], pa.int64())], names=["a", "b", "equal"])


def _verified(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, ta, tb) with the whole texts of their ends, those with 100 * intersection >= similarity * union."""
    last: tuple[str, np.ndarray] = ("", np.empty(0, np.uint64))
    for batch in slices(batches):
        keep = []
        for ta, tb in zip(texts(batch.column("ta")), texts(batch.column("tb")), strict=True):
            if tb != last[0]:  # pairs often come sorted by one side
                last = (tb, shingles(tb, p.width))
            keep.append(_similar(shingles(ta, p.width), last[1], p))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])


def _similar(sa: np.ndarray, sb: np.ndarray, p: Params) -> bool:
    common = len(np.intersect1d(sa, sb, assume_unique=True))
    return common > 0 and 100 * common >= p.similarity * (len(sa) + len(sb) - common)


def _across(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, x, y): pairs of components that one group joins, verified on the full shingle sets.

    A group holds block x and block y of a bucket, and its pairs are those between them (within, if x = y). Pairs whose
    sketches agree enough are taken from the likeliest on; what earlier links of the group have joined isn't compared
    again, so a group gives fewer links than it has members. A pair that shares several buckets is taken in the first."""
    held: list[pa.Table] = []

    def links(t: pa.Table) -> pa.RecordBatch:
        comp, own = (t.column(c).to_numpy() for c in ("comp", "own"))
        m, bands = _marks(t.column("marks"), p.fine), t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, p.bands)
        band = int(np.flatnonzero((bands == t.column("bucket")[0].as_py()).all(axis=0))[0])
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in t.column("shingles")]
        within = t.column("x")[0].as_py() == t.column("y")[0].as_py()
        parent = {c: c for c in comp.tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        found = []
        for i in range(len(comp) - 1):
            j = np.arange(i + 1, len(comp))
            j = j[(comp[j] != comp[i]) & (within | (own[j] != own[i]))]
            if not len(j):
                continue
            equal = (m[j] == m[i]).sum(axis=1)
            near = equal >= p.least_fine
            j, equal = j[near], equal[near]
            first = ~(bands[j, :band] == bands[i, :band]).any(axis=1)
            found.append(np.stack([np.full(int(first.sum()), i), j[first], equal[first]]))
        i, j, equal = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
        a, b = [], []
        for k in np.argsort(-equal, kind="stable").tolist():
            u, v = int(i[k]), int(j[k])
            ru, rv = root(int(comp[u])), root(int(comp[v]))
            if ru != rv and _similar(sets[u], sets[v], p):
                parent[ru] = rv
                a.append(int(comp[u]))
                b.append(int(comp[v]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("bucket", "x", "y")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and any(held[0].column(c)[0].as_py() != int(key[n, lo]) for n, c in enumerate(("bucket", "x", "y"))):
                yield links(pa.concat_tables(held).combine_chunks())
                held = []
            held.append(pa.Table.from_batches([batch.slice(lo, hi - lo)]))
    if held:
        yield links(pa.concat_tables(held).combine_chunks())


def _both_ends(pairs: DataFrame, of_a: DataFrame, of_b: DataFrame) -> DataFrame:
    """pairs (a, b and others; a table written) with what there is of either end. A pivot's pairs are dealt into blocks."""
    bound = hub_bound(pairs.count())
    ends = lambda c: pairs.groupBy(c).count()
    return hub_join(hub_join(pairs, of_a, "a", "b", ends("a"), bound), of_b, "b", "a", ends("b"), bound)


def _verify(pairs: DataFrame, bodies: DataFrame, p: Params) -> DataFrame:
    """Of pairs (a, b, ca, cb; a table written) those whose whole texts verify, as links (a, b) of their components ca
    and cb."""
    ta, tb = bodies.select(F.col("rep").alias("a"), F.col("text").alias("ta")), bodies.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    both = _both_ends(pairs, ta, tb).select(F.col("ca").alias("a"), F.col("cb").alias("b"), "ta", "tb")
    return both.mapInArrow(partial(_verified, p=p), "a long, b long")


def _placed(df: DataFrame, node: str, found: list[DataFrame], name: str = "c") -> DataFrame:
    """df with the component of its node: each round of components is one of the rounds before it."""
    df = df.withColumn(name, F.col(node))
    for comp in found:
        df = df.join(comp.select(F.col("node").alias(name), "component"), name, "left").withColumn(name, F.coalesce("component", name)).drop("component")
    return df


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), params: Params = Params()) -> DataFrame:
    """docs -> (doc_id long, n_shingles long, component_id long, kept boolean, and the columns of carry), one row per
    row of docs.

    Ids must be integers. Null and empty texts, and texts of white space only, have no shingles: they link with
    nothing. A null id links with nothing, has a null component and is kept. Rows that repeat an id are linked each by
    its own text; each is kept if the id is its component's least. Other columns are ignored. An empty table gives an
    empty result.
    """
    p = params
    own = rename_columns(docs, doc_id=id_col, text=text_col, **{f"_{i}": c for i, c in enumerate(carry)}).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("t", F.xxhash64("text"))
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "text")
    made = written(own.mapInArrow(partial(_sketched, p=p), f"{others}, n_shingles long, k1 long, k2 long, marks binary, bands array<long>"))
    real = made.where("n_shingles > 0 and doc_id is not null")
    # Classes are numbered as they are written; the text of the row of least doc_id (and hash) stands for a class.
    reps = real.groupBy("k1", "k2").agg(F.min_by(F.struct("doc_id", "t", "n_shingles", "marks", "bands"), F.struct("doc_id", "t")).alias("r"))
    reps = written(reps.select("k1", "k2", "r.*").withColumn("rep", F.monotonically_increasing_id()))

    # Each bucket is dealt into as many blocks as keep a block's number of members and bytes near the bounds.
    buckets = reps.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("sum")).where("size > 1")
    n = F.greatest(F.ceil(F.col("size") / p.block), F.ceil(F.col("sum") * 8 / p.block_bytes)).cast("int")
    shared = buckets.select("rep", "bucket").join(sizes.select("bucket", "size", n.alias("n")), "bucket")
    shared = written(shared.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int")))
    company = shared.groupBy("rep").agg(F.sum("size").alias("company"))
    pivots = shared.join(company, "rep").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("rep")).alias("neg"))).alias("p"), F.first("n").alias("n"))
    # A bucket's members are spread over its blocks, and what is joined to them goes to each block.
    pivots = pivots.select("bucket", (-F.col("p.neg")).alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("own"))
    stars = shared.join(pivots, ["bucket", "own"]).where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    ma, mb = (reps.select(F.col("rep").alias(k), F.col("marks").alias(f"m{k}")) for k in "ab")
    spokes = written(stars)
    stars = written(_both_ends(spokes, ma, mb).select("a", "b", "ma", "mb").mapInArrow(partial(_alike, p=p), "a long, b long, equal long"))
    discard(spokes)

    members = shared.select("rep").distinct().join(reps.select("rep", "doc_id", "t"), "rep")
    bodies = own.select("doc_id", "t", "text").join(members, ["doc_id", "t"]).groupBy("doc_id", "t").agg(F.first("rep").alias("rep"), F.first("text").alias("text"))
    bodies = written(bodies.select("rep", "text"))

    # The likeliest partner of each document first: from the side that is not the better known one.
    ends = stars.select(F.col("a").alias("x"), F.col("b").alias("y"), "equal").union(stars.select("b", "a", "equal"))
    best = ends.groupBy("x").agg(F.max_by(F.struct("y"), F.struct("equal", (-F.col("y")).alias("t"))).alias("m")).select("x", "m.y")
    first = written(best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    found = [components(_verify(first.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), bodies, p))]

    # What is joined is joined: from here on, links are between the components so far.
    second = _placed(_placed(stars.select("a", "b").join(first, ["a", "b"], "left_anti"), "a", found, "ca"), "b", found, "cb").where("ca <> cb")
    second = written(second.select("a", "b", "ca", "cb"))
    found.append(components(_verify(second, bodies, p)))
    discard(second)

    named = _placed(shared.select("bucket", "rep", "n", "own"), "rep", found, "comp")
    mixed = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("n").alias("n")).where("lo <> hi")
    mixed = mixed.select("bucket", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("own"))
    named = written(named.join(mixed, ["bucket", "own"]))
    fine = bodies.join(named.select("rep").distinct(), "rep", "left_semi").mapInArrow(partial(_finely, p=p), "rep long, marks binary, shingles binary")
    fine = written(fine.join(reps.select("rep", "bands"), "rep"))
    dealt = named.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "comp")
    # Groups of one component have nothing to compare; their members' sets aren't sent.
    several = dealt.groupBy("bucket", "x", "y").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket", "x", "y")
    dealt = dealt.join(several, ["bucket", "x", "y"], "left_semi").join(fine, "rep")
    found.append(components(dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(partial(_across, p=p), "a long, b long")))
    discard(stars, bodies, first, named, fine)

    # Rows without shingles or id have a key of their own each, so that they don't meet in one partition.
    linkable = F.expr("n_shingles > 0 and doc_id is not null")
    classes = _placed(reps.select("k1", "k2", "doc_id", "rep"), "rep", found)
    least = _placed(shared.select("rep").distinct().join(reps.select("rep", "doc_id"), "rep"), "rep", found).groupBy("c").agg(F.min("doc_id").alias("least"))
    by_key = classes.join(least, "c", "left").select("k1", "k2", F.lit(True).alias("linkable"), F.coalesce("least", "doc_id").alias("c"))
    columns = ["doc_id", "n_shingles", *(f"_{i}" for i in range(len(carry)))]
    out = made.select(*columns, linkable.alias("linkable"), F.when(linkable, F.col("k1")).otherwise(F.xxhash64("doc_id", "t")).alias("k1"), F.when(linkable, F.col("k2")).otherwise(F.lit(0)).alias("k2"))
    out = out.join(by_key, ["k1", "k2", "linkable"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)))
