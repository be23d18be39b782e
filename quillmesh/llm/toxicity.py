"""Toxicity by class-conditional Kneser-Ney models over words and pairs of words.

Two models of each, one of the toxic and one of the ordinary labelled texts, give the log-likelihoods of words and of
pairs of words that follow each other. What a class's counts are discounted by goes to a backoff that both classes share:
continuation counts, in how many different learned documents a word (or a pair) stands. So a rare expression is judged
by what both classes know of it, and one that neither has seen has the same ratio in all texts (the shared part cancels
out). The difference of the two log-likelihoods (per letter over the whole text; of each different word and of each
different pair the greatest ones, and how many lie above several cuts) is turned into a probability by a logistic curve,
fitted on labelled rows of a fold that the models haven't seen.

Counts are exact, keyed by 64-bit hashes of words and pairs, and stay in tables that grow with what is learned. Pairs
of less than `pair_documents` documents are judged by their words alone. Of the log-ratios only those of the most
frequent words and pairs, at most `sent_words` and `sent_pairs`, go to the tasks; the other ones of a block of texts are
sent to the model's places (ranges of the keys), sorted and packed, and those that the model has come back to the block.
That exchange is done in passes, each for a part of the texts, whose number keeps what lies on disk at once in proportion
to the texts, however many of their pairs the model has.
Nothing else passes through the driver but totals, histograms of frequencies, sketches and the bounded sample for the
curve.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import divergence
from .common import alnum_words, collected, discard, mix64, packed, rename_columns, slices, texts, unpacked, written
from .labels import bounded, fit_logistic, fold, known_labels, labelled


@dataclass(frozen=True)
class Params:
    """discount: taken from each count. top: most suspicious words that count. cuts: log-ratios of a word above which
    words are counted. calibration_rows: bound of the sample for the logistic curve. longest: bytes of a word; longer
    ones are scored in pieces of so many. pair_documents: in how many learned documents a pair of the model stands.
    sketch_bits: binary logarithm of the sketch's cells in a row. sent_words, sent_pairs: most words and pairs whose
    log-ratios are sent to the tasks (12 bytes each); cache: words that a task keeps. window: pairs of a task that are
    summed up or asked for together. bucket_bytes: learned text whose pairs are counted in one bucket; bucket_keys: words
    or pairs of the model at one place. block_rows: texts that ask together. turns: parts of the pairs, by their hashes,
    that are counted one after the other. exchange: bytes that are asked for and
    answered in one pass, of a byte of all texts."""

    discount: float = 0.75
    top: int = 3
    cuts: tuple[float, ...] = (1, 2, 3, 4, 5, 6, 7)
    calibration_rows: int = 40_000
    longest: int = 32
    pair_documents: int = 2
    sketch_bits: int = 24
    sent_words: int = 500_000
    sent_pairs: int = 100_000
    cache: int = 500_000
    window: int = 1 << 21
    bucket_bytes: int = 1 << 22
    bucket_keys: int = 1 << 15
    block_rows: int = 1 << 14
    turns: int = 2
    exchange: float = 0.2


@dataclass(frozen=True)
class Model:
    """words, pairs: (key, documents, ratio). unseen: the ratio of words that aren't there. frequent, frequent_pairs: least
    number of documents of the words and pairs that are sent, in steps of an eighth of a binary order; 0 if all are.
    rare, running: of a byte of learned text, its words and pairs that aren't sent, and all its words."""

    words: DataFrame
    pairs: DataFrame
    unseen: float
    frequent: int
    frequent_pairs: int
    rare: float
    running: float


def _key(word: bytes) -> int:
    k = xxhash.xxh64_intdigest(word)
    return k - (1 << 64) if k >> 63 else k


def _pieces(text: str, longest: int) -> list[bytes]:
    words = alnum_words(text)
    if words and max(map(len, words)) > longest:
        words = [w[i : i + longest] for w in words for i in range(0, len(w), longest)]
    return words


def _pairs(keys: np.ndarray) -> np.ndarray:
    """Keys of a text's words in order -> of each a key of it and the word before it (0 at the beginning)."""
    before = np.concatenate([np.zeros(1, np.uint64), keys[:-1]]) if len(keys) else keys
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + keys)


def _word_counts(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """(text, y) -> pre-aggregated (key, documents, toxic, plain)."""
    held = Counter(), Counter(), Counter()  # occurrences in ordinary and in toxic texts, documents

    def out() -> pa.RecordBatch:
        words = list(held[2])
        columns = [pa.array(list(map(_key, words)), pa.int64())] + [pa.array([held[i][w] for w in words], pa.int64()) for i in (2, 1, 0)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "documents", "toxic", "plain"])

    for batch in slices(batches):
        for text, y in zip(texts(batch.column("text")), batch.column("y").to_pylist(), strict=True):
            words = _pieces(text, p.longest)
            held[y].update(words)
            held[2].update(set(words))
        if len(held[2]) > 200_000:
            yield out()
            for c in held:
                c.clear()
    yield out()


def _cells(pairs: np.ndarray, depth: int, bits: int) -> list[np.ndarray]:
    return [(mix64(pairs ^ np.uint64((r + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64) for r in range(depth)]


def _keyed(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    if len(known) > 500_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _keys_sketched(batches: Iterator[pa.RecordBatch], p) -> Iterator[pa.RecordBatch]:
    """(key) -> a sketch of which keys there are; p: divergence.Params."""
    sketch = np.zeros((p.depth, 1 << p.bits), np.uint8)
    for batch in batches:
        for row, at in zip(sketch, _cells(batch.column("key").to_numpy().view(np.uint64), p.depth, p.bits), strict=True):
            row[at] = 1
    yield from divergence.sketch_rows(sketch)


def _passing(keys: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    """Which keys a sketch of 2^width cells a row lets through."""
    good = np.ones(len(keys), bool)
    for row, at in zip(bits, _cells(keys, len(bits), width), strict=True):
        good &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return good


def _summed(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in order, and the columns' sums for each."""
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate([np.ones(1, bool), key[1:] != key[:-1]])) if len(key) else order
    return key[start], *(np.add.reduceat(c[order], start, dtype=c.dtype) if len(start) else c for c in columns)


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Of sorted keys, (bucket, from, to) of each range of the hashes that holds some."""
    own = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)] if len(own) else [0]
    return zip(own[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True)


def _pair_counts(batches: Iterator[pa.RecordBatch], p: Params, buckets: int, turn: int) -> Iterator[pa.RecordBatch]:
    """(text, y) -> (bucket, data): counts of one part of the pairs, summed up within windows of the task and packed by
    bucket."""
    held, known, n = [], {}, 0

    def out() -> Iterator[pa.RecordBatch]:
        key, times, y = (np.concatenate(c) for c in zip(*held, strict=True))
        key, *sums = _summed(key, np.ones(len(key), np.uint32), np.where(y, times, 0).astype(np.uint32), np.where(y, 0, times).astype(np.uint32))
        for bucket, i, j in _dealt(key, buckets):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([packed(key[i:j], *(c[i:j] for c in sums))], pa.binary())], names=["bucket", "data"])

    for batch in slices(batches):
        for text, y in zip(texts(batch.column("text")), batch.column("y").to_pylist(), strict=True):
            key = _pairs(_keyed(_pieces(text, p.longest), known))
            key, times = np.unique(key[key % np.uint64(p.turns) == turn], return_counts=True)
            held.append((key, times.astype(np.uint32), np.full(len(key), y > 0)))
            n += len(key)
            if n > p.window:
                yield from out()
                held, n = [], 0
    if held:
        yield from out()


def _pairs_merged(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> (key, documents, toxic, plain) of the pairs that stand in enough documents."""
    own, held, n, merged = None, [], 0, 0

    def summed() -> tuple[np.ndarray, ...]:
        return _summed(*(np.concatenate(c) for c in zip(*held, strict=True)))

    def out() -> Iterator[pa.RecordBatch]:
        key, *sums = summed()
        good = sums[0] >= p.pair_documents
        yield pa.RecordBatch.from_arrays([pa.array(c[good]) for c in (key.view(np.int64), *sums)], names=["key", "documents", "toxic", "plain"])

    for batch in batches:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
            if bucket != own and held:
                yield from out()
                held, n, merged = [], 0, 0
            own = bucket
            key, *sums = unpacked(data.as_py(), "<u4", "<u4", "<u4")
            held.append((key, *(c.astype(np.int64) for c in sums)))
            n += len(key)
            if n > 2 * merged + 200_000:  # what is held stays in proportion to the bucket's different pairs
                held = [summed()]
                n = merged = len(held[0][0])
    if held:
        yield from out()


def _step(documents: Column) -> Column:
    """A number of documents in steps of an eighth of a binary order."""
    return F.floor(F.log2(documents) * 8).cast("int")


def _frequent(counts: DataFrame, most: int) -> tuple[int, int, int]:
    """The least step of numbers of documents that `most` rows at most reach, 0 if all may count; in how many documents
    the other rows stand, summed up; and how often all rows occur."""
    sums = F.count("*").alias("n"), F.sum("documents").alias("documents"), F.sum(F.col("toxic") + F.col("plain")).alias("times")
    steps = sorted(counts.groupBy(_step(F.col("documents")).alias("step")).agg(*sums).collect(), reverse=True)  # some hundreds at most
    n, times = 0, sum(r["times"] for r in steps)
    for i, r in enumerate(steps):
        n += r["n"]
        if n > most:
            return r["step"] + 1, sum(x["documents"] for x in steps[i:]), times
    return 0, 0, times


def _ratios(counts: DataFrame, d: float) -> tuple[DataFrame, float]:
    """(key, documents, toxic, plain) -> (key, documents, ratio), and the ratio of what isn't there."""
    total = counts.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "toxic", "plain")), *(F.count_if(F.col(c) > 0).alias(f"kinds_{c}") for c in ("toxic", "plain"))
    ).first()
    # what is left for the backoff; a class without any leaves everything
    left = {c: min(d * total[f"kinds_{c}"] / total[c], 1.0) if total[c] else 1.0 for c in ("toxic", "plain")}
    shared = F.col("documents") / F.lit(float(max(total["documents"], 1)))
    likely = [F.greatest(F.col(c) - d, F.lit(0.0)) / F.lit(float(max(total[c], 1))) + F.lit(left[c]) * shared for c in ("toxic", "plain")]
    return counts.select("key", "documents", F.log(likely[0] / likely[1]).alias("ratio")), math.log(left["toxic"] / left["plain"])


def fit(train: DataFrame, params: Params = Params()) -> Model:
    """train: (text, y 0 or 1)."""
    p, sums = params, [F.sum(c).alias(c) for c in ("documents", "toxic", "plain")]
    train, schema = written(train.select("text", "y")), "key long, documents long, toxic long, plain long"
    counts = written(train.mapInArrow(partial(_word_counts, p=p), schema).groupBy("key").agg(*sums))
    collected(train.sparkSession)
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, parts = 16 + size // (p.bucket_bytes * p.turns), []
    for turn in range(p.turns):
        pairs = train.mapInArrow(partial(_pair_counts, p=p, buckets=buckets, turn=turn), "bucket int, data binary").repartition("bucket").sortWithinPartitions("bucket")
        parts.append(written(pairs.mapInArrow(partial(_pairs_merged, p=p), schema)))
        del pairs
        collected(train.sparkSession)
    pairs = reduce(DataFrame.union, parts)
    discard(train)
    (words, unseen), (of_pairs, _) = _ratios(counts, p.discount), _ratios(pairs, p.discount)
    (frequent, rare, running), (frequent_pairs, rare_pairs, _) = _frequent(counts, p.sent_words), _frequent(pairs, p.sent_pairs)
    return Model(words, of_pairs, unseen, frequent, frequent_pairs, (rare + rare_pairs) / max(size, 1), running / max(size, 1))


@dataclass
class _Evidence:
    """Of each text, of its words or of its pairs: sum of the log-ratios, the greatest ones (-inf where there are fewer),
    numbers of different ones above each cut; of those that weren't sent how many different ones there are, how often
    they occur, and (key, text, occurrences) of those that the model may have."""

    total: np.ndarray
    high: np.ndarray
    above: np.ndarray
    unseen: np.ndarray
    all_unseen: np.ndarray
    left: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def none(n: int, p: Params) -> _Evidence:
        return _Evidence(np.zeros(n), np.full((n, p.top), -np.inf), np.zeros((n, len(p.cuts)), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [])

    def arrays(self) -> list[np.ndarray]:
        return [self.total, self.high, self.above, self.unseen, self.all_unseen]

    def add(self, text: np.ndarray, ratio: np.ndarray, times: np.ndarray, p: Params) -> None:
        """Ratios that weren't sent: of each, its text and its occurrences there."""
        n, ratio = len(self.total), ratio.astype(np.float64)
        self.total += np.bincount(text, ratio * times, n)
        self.unseen -= np.bincount(text, minlength=n)
        self.all_unseen -= np.bincount(text, times, n).astype(np.int64)
        for i, c in enumerate(p.cuts):
            self.above[:, i] += np.bincount(text[ratio > c], minlength=n)
        order = np.lexsort((-ratio, text))
        text, ratio = text[order], ratio[order]
        rank = np.arange(len(text)) - np.searchsorted(text, text)
        best = np.full((n, p.top), -np.inf)
        best[text[rank < p.top], rank[rank < p.top]] = ratio[rank < p.top]
        self.high = -np.sort(-np.concatenate([self.high, best], axis=1), axis=1)[:, : p.top]

    def numbers(self, letters: np.ndarray, unseen: float | None, p: Params) -> list[np.ndarray]:
        """The texts' numbers for the curve; unseen: the ratio of what the model hasn't, None if that doesn't count."""
        total, high, above = self.total, self.high, self.above
        if unseen is not None:
            total = total + self.all_unseen * unseen
            more = np.where(np.arange(p.top) < self.unseen[:, None], unseen, -np.inf)
            high = -np.sort(-np.concatenate([high, more], axis=1), axis=1)[:, : p.top]
            above = above + self.unseen[:, None] * (unseen > np.array(p.cuts))
        high = np.where(np.isinf(high), 0.0, high)
        return [np.where(letters > 0, total / np.maximum(letters, 1), 0.0), high[:, 0], high.sum(axis=1) / p.top, *np.log1p(above).T]


class _Scorer:
    """words, pairs: sorted keys and their ratios. others: sketches of the other words and pairs of the model, if there
    are any."""

    def __init__(self, words: tuple, pairs: tuple, others: tuple[np.ndarray | None, np.ndarray | None], p: Params):
        self.words, self.pairs, self.others, self.p = words, pairs, others, p
        self._forget()

    def _forget(self) -> None:
        self.known, self.keys, self.ratios, self.may = {}, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool)

    def _learn(self, new: list[bytes]) -> None:
        """Keys and ratios of new words; NaN for those that weren't sent, and whether the model may have them."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
        self.known.update(zip(new, range(len(self.keys), len(self.keys) + len(new)), strict=True))
        self.keys = np.concatenate([self.keys, keys])
        self.ratios = np.concatenate([self.ratios, _looked_up(*self.words, keys)])
        self.may = np.concatenate([self.may, np.zeros(len(keys), bool) if self.others[0] is None else _passing(keys, self.others[0], self.p.sketch_bits)])

    def measure(self, batch: list[str]) -> tuple[np.ndarray, list[_Evidence]]:
        """Letters (and ends of words) of each text, and what is known of its words and of its pairs."""
        if len(self.known) > self.p.cache:
            self._forget()
        split = [_pieces(t, self.p.longest) for t in batch]
        self._learn(list(set().union(*split).difference(self.known)))
        letters = np.zeros(len(batch), np.int64)
        found = [_Evidence.none(len(batch), self.p) for _ in "wp"]
        for i, words in enumerate(split):
            letters[i] = sum(map(len, words)) + len(words)
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            different, times = np.unique(at, return_counts=True)
            self._measured(found[0], i, self.ratios[different], times, self.keys[different], self.may[different])
            pairs, times = np.unique(_pairs(self.keys[at]), return_counts=True)
            ratio = _looked_up(*self.pairs, pairs)
            may = ~np.isnan(ratio)  # of the pairs that weren't sent, those that the model may have
            if self.others[1] is not None:
                may[~may] = _passing(pairs[~may], self.others[1], self.p.sketch_bits)
            self._measured(found[1], i, ratio[may], times[may], pairs[may], may[may])
        return letters, found

    def _measured(self, to: _Evidence, i: int, ratio: np.ndarray, times: np.ndarray, keys: np.ndarray, may: np.ndarray) -> None:
        there = ~np.isnan(ratio)
        high = np.sort(ratio[there])
        best = high[::-1][: self.p.top]
        to.total[i], to.high[i, : len(best)] = ratio[there] @ times[there], best
        to.above[i] = len(high) - np.searchsorted(high, self.p.cuts, "right")
        if not there.all():
            n, asked = times[~there].astype(np.uint32), ~there & may
            to.unseen[i], to.all_unseen[i] = len(n), n.sum()
            to.left.append((keys[asked], np.full(asked.sum(), i, np.uint32), times[asked].astype(np.uint32)))


def _looked_up(known: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of keys; NaN for those that aren't known."""
    if not len(known):
        return np.full(len(wanted), np.nan)
    place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[place] == wanted, values[place], np.nan)


def _ready(columns: pa.RecordBatch, letters: np.ndarray, found: list[_Evidence], unseen: float, p: Params) -> pa.RecordBatch:
    """The texts' other columns and x."""
    x = np.stack(found[0].numbers(letters, unseen, p) + found[1].numbers(letters, None, p), axis=1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([*columns.columns, lists], names=[*columns.schema.names, "x"])


def _scored(batches: Iterator[pa.RecordBatch], sent, unseen: float, p: Params) -> Iterator[pa.RecordBatch]:
    """(text and others) -> (the others, x), where the whole model was sent."""
    scorer = _Scorer(*sent.value, p)
    for batch in slices(batches):
        yield _ready(batch.drop_columns("text"), *scorer.measure(texts(batch.column("text"))), unseen, p)


def _row(place: int, kind: int, block: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["place", "kind", "block", "data"])


def _asked(batches: Iterator[pa.RecordBatch], sent, buckets: tuple[int, int], p: Params) -> Iterator[pa.RecordBatch]:
    """(text and others) -> for each block of texts, a row of what is known of them (kind 2, at a place of its own), and
    at each place of the model a row of the block's words or pairs that weren't sent (kind 1): keys, texts, occurrences."""
    scorer, task = _Scorer(*sent.value, p), TaskContext.get().partitionId()
    held, n, rows, blocks = [], 0, 0, 0

    def out() -> Iterator[pa.RecordBatch]:
        block = task << 32 | blocks
        columns = pa.Table.from_batches([c for c, _, _ in held]).combine_chunks().to_batches()[0]
        letters, arrays = np.concatenate([n for _, n, _ in held]), []
        for k in range(2):
            arrays += [np.concatenate(c) for c in zip(*(found[k].arrays() for _, _, found in held), strict=True)]
            first = np.cumsum([0, *(len(c) for _, c, _ in held)])[:-1].tolist()
            left = [(key, text + np.uint32(i), times) for i, (_, _, found) in zip(first, held, strict=True) for key, text, times in found[k].left] if buckets[k] else []
            if left:
                key, text, times = (np.concatenate(c) for c in zip(*left, strict=True))
                order = np.argsort(key, kind="stable")
                key, text, times = key[order], text[order], times[order]
                for bucket, i, j in _dealt(key, buckets[k]):
                    yield _row(bucket + k * buckets[0], 1, block, packed(key[i:j], text[i:j], times[i:j]))
        yield _row(sum(buckets) + task, 2, block, _stored(columns, [letters, *arrays]))

    for batch in slices(batches):
        letters, found = scorer.measure(texts(batch.column("text")))
        held.append((batch.drop_columns("text"), letters, found))
        rows, n = rows + len(letters), n + sum(len(key) for f in found for key, _, _ in f.left)
        if rows >= p.block_rows or n >= p.window:
            yield from out()
            held, n, rows, blocks = [], 0, 0, blocks + 1
    if held:
        yield from out()


def _stored(columns: pa.RecordBatch, arrays: list[np.ndarray]) -> bytes:
    """A block's columns and numbers as an Arrow stream."""
    lists = [pa.array(a) if a.ndim == 1 else pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]) for a in arrays]
    batch = pa.RecordBatch.from_arrays([*columns.columns, *lists], names=[*columns.schema.names, *(f"#{i}" for i in range(len(lists)))])
    to = pa.BufferOutputStream()
    with pa.ipc.new_stream(to, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return to.getvalue().to_pybytes()


def _restored(data: bytes) -> tuple[pa.RecordBatch, np.ndarray, list[_Evidence]]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    k = batch.num_columns - 11
    letters, *arrays = (c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).copy() if pa.types.is_fixed_size_list(c.type) else c.to_numpy(zero_copy_only=False).copy() for c in batch.columns[k:])
    return batch.select(list(range(k))), letters, [_Evidence(*arrays[:5], []), _Evidence(*arrays[5:], [])]


def _placed(batches: Iterator[pa.RecordBatch], first: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(key, ratio) -> rows of the model's places (kind 0): keys and ratios."""
    held, n = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        key, ratio = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(key)
        key, ratio = key[order], ratio[order]
        for bucket, i, j in _dealt(key, buckets):
            yield _row(first + bucket, 0, 0, packed(key[i:j], ratio[i:j]))

    for batch in batches:
        held.append((batch.column("key").to_numpy().view(np.uint64), batch.column("ratio").to_numpy()))
        n += batch.num_rows
        if n > 1 << 20:
            yield from out()
            held, n = [], 0
    if held:
        yield from out()


def _answer(text: np.ndarray, ratio: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted texts, and of each a ratio (of which there are few different ones) and a number."""
    values, code = np.unique(ratio.astype(np.float32).view(np.uint32), return_inverse=True)
    values = packed(values.astype(np.uint64))
    return len(values).to_bytes(8, "little") + values + packed(text.astype(np.uint64), code.astype(np.uint32), times)


def _answer_read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = 8 + int.from_bytes(data[:8], "little")
    values, (text, code, times) = unpacked(data[8:cut])[0], unpacked(data[cut:], "<u4", "<u4")
    return text, values.astype(np.uint32).view(np.float32)[code], times


def _answered(batches: Iterator[pa.RecordBatch], pairs_from: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by place and kind -> (place 0, kind, block, data): 0 what is known of a block's texts, 1 its words and
    2 its pairs that the model has: texts, ratios, occurrences."""
    own, parts, model = None, [], None
    for batch in batches:
        for place, kind, block, data in zip(*(batch.column(c).to_pylist() for c in ("place", "kind", "block")), batch.column("data"), strict=True):
            if place != own:
                own, parts, model = place, [], None
            if kind == 0:
                parts.append(unpacked(data.as_py(), "<f4"))
            elif kind == 2:
                yield _row(0, 0, block, data.as_py())
            elif parts:
                if model is None:
                    key, ratio = (np.concatenate(c) for c in zip(*parts, strict=True))
                    order = np.argsort(key)
                    model = key[order], ratio[order]
                key, text, times = unpacked(data.as_py(), "<u4", "<u4")
                ratio = _looked_up(*model, key)
                there = np.flatnonzero(~np.isnan(ratio))
                there = there[np.argsort(text[there], kind="stable")]
                if len(there):
                    yield _row(0, 1 + (place >= pairs_from), block, _answer(text[there], ratio[there], times[there]))


def _gathered(batches: Iterator[pa.RecordBatch], unseen: float, p: Params) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and kind -> (the texts' other columns, x)."""
    known, answers = None, [[], []]

    def out() -> pa.RecordBatch:
        columns, letters, found = known
        for of, got in zip(found, answers, strict=True):
            if got:
                text, ratio, times = (np.concatenate(c) for c in zip(*got, strict=True))
                of.add(text.astype(np.int64), ratio, times, p)
        return _ready(columns, letters, found, unseen, p)

    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
            if kind == 0:  # a block begins
                if known:
                    yield out()
                known, answers = _restored(data.as_py()), [[], []]
            else:
                answers[kind - 1].append(_answer_read(data.as_py()))
    if known:
        yield out()


#: Bytes that a word or pair takes that is asked for and answered, packed.
ASKED_BYTES = 12


def _passes(model: Model, through: float, p: Params) -> int:
    """How many passes the exchange takes. through: share of the pairs that the model hasn't which are asked all the same.
    No text has more pairs than words, which bounds what is asked of a byte of text, and so the passes."""
    return max(1, math.ceil((model.rare + through * max(model.running - model.rare, 0)) * ASKED_BYTES / p.exchange))


def _exchanged(own: DataFrame, placed: DataFrame, sent, buckets: tuple[int, int], schema: str, unseen: float, p: Params) -> DataFrame:
    """Some texts' other columns and x: what wasn't sent is asked at the model's places, and comes back."""
    asked = own.mapInArrow(partial(_asked, sent=sent, buckets=buckets, p=p), placed.schema).union(placed)
    answered = asked.repartition("place").sortWithinPartitions("place", "kind").mapInArrow(partial(_answered, pairs_from=buckets[0]), placed.schema)
    return written(answered.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(partial(_gathered, unseen=unseen, p=p), schema))


def measure(own: DataFrame, model: Model, params: Params = Params()) -> DataFrame:
    """own (text and others) -> the other columns and x, the text's numbers for the curve, as tables in the shared
    folder."""
    p, spark = params, own.sparkSession
    ratio = F.col("ratio").cast("float").alias("ratio")

    def split(table: DataFrame, step: int) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
        often = F.expr("true") if not step else _step(F.col("documents")) >= step
        rows = table.where(often).select("key", ratio).toArrow()  # sent_words, sent_pairs at most
        keys = rows.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return (keys[order], rows.column("ratio").to_numpy()[order]), table.where(~often).select("key", ratio)

    words, rare_words = split(model.words, model.frequent)
    pairs, rare_pairs = split(model.pairs, model.frequent_pairs)
    # Sketches of the words and pairs that aren't sent tell which of a text's may be among them; only those are asked for.
    size = divergence.Params(min_docs=1, bits=p.sketch_bits)
    rest = tuple(divergence.frequent(rare.select("key"), size, _keys_sketched) if step else None for step, rare in ((model.frequent, rare_words), (model.frequent_pairs, rare_pairs)))
    sent = spark.sparkContext.broadcast((words, pairs, rest))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "text"), "x array<double>"])
    buckets = tuple(16 + table.count() // p.bucket_keys if step else 0 for step, table in ((model.frequent, rare_words), (model.frequent_pairs, rare_pairs)))
    if not sum(buckets):
        return written(own.mapInArrow(partial(_scored, sent=sent, unseen=model.unseen, p=p), schema))
    placed = [table.mapInArrow(partial(_placed, first=first, buckets=n), "place int, kind int, block long, data binary") for table, first, n in ((rare_words, 0, buckets[0]), (rare_pairs, *buckets)) if n]
    placed = written(reduce(DataFrame.union, placed))
    through = math.prod(float(np.bitwise_count(row).mean()) / 8 for row in rest[1]) if buckets[1] else 0.0
    passes, out = _passes(model, through, p), []
    turn = F.pmod(F.xxhash64(*(c for c in ("doc_id", "text") if c in own.columns)), F.lit(passes))
    for i in range(passes):
        out.append(_exchanged(own.where(turn == i), placed, sent, buckets, schema, model.unseen, p))
        collected(spark)
    discard(placed)
    return reduce(DataFrame.union, out)


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), params: Params = Params()) -> DataFrame:
    """docs -> (doc_id, held_out boolean, score double, predicted int, and the columns of carry), a row per row of docs.

    Labels are learned from documents whose crc32(id as text) mod 5 is 1, 2 or 3 (the models) and 4 (the curve); those
    where it is 0 are held out. Null and empty texts get a score from the curve at no evidence. Null ids are held out
    and keep a null id; rows that repeat an id are scored each. Without rows of both classes for the curve, it is flat
    at the share of toxic rows (one half without any). Other columns are ignored; an empty table gives an empty result.
    """
    p = params
    train = labelled(docs, labels, label_col, id_col, text_col).where(fold("doc_id", 5).isin(1, 2, 3))
    own = rename_columns(docs, doc_id=id_col, text=text_col, **{f"_{i}": c for i, c in enumerate(carry)})
    measured = measure(own, fit(train, p), p)
    rows = measured.where(fold("doc_id", 5) == 4).select("doc_id", "x").join(known_labels(labels, label_col, id_col), "doc_id")
    got = bounded(rows, p.calibration_rows, rows.count()).select("y", "x").toPandas()
    x, y = np.array(got["x"].tolist(), float).reshape(-1, 2 * (3 + len(p.cuts))), got["y"].to_numpy(float)
    if len(set(y)) == 2:
        w = fit_logistic(x, y).tolist()
    else:
        share = (y.sum() + 0.5) / (len(y) + 1)
        w = [0.0] * x.shape[1] + [math.log(share / (1 - share))]
    z = sum((F.col("x")[i] * F.lit(v) for i, v in enumerate(w[:-1])), F.lit(w[-1]))
    out = measured.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"), *(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *carry)
