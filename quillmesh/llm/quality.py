"""Quality by a generalised additive model with pairwise interactions, learned by cyclic boosting.

Features of the whole text are cut into bins. Rounds of boosting go through the features one at a time, each round
adding a shallow tree on one feature's bins (a step function of at most `leaves` steps), so that the sum of a
feature's trees is a lookup table. Then the pairs of features that explain most of what is left (of those between the
features with the largest main effects) get tables of their own in the same way, a two-level tree a round. A score is
the sum of table entries: vectorised additions of looked-up bins.

The model is fitted on a bounded sample of labelled rows' features; everything else covers all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rename_columns, slices, texts
from .labels import bounded, fold, labelled, sigmoid

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "long_words", "upper_share", "digit_share", "comma_stop_share", "other_mark_share",
    "mark_kinds", "wide_share", "words_per_line", "repeated_lines", "line_end_stop", "capital_words", "bare_words", "longest_word", "space_share", "repeated_pairs",
)


@dataclass(frozen=True)
class Params:
    """sample: labelled rows that the fit sees at most. bins: of a feature; pair_bins: of each in a pair. rounds: of
    boosting over all features; pair_rounds over all pairs. rate: of learning. leaves: of a tree. pairs: interactions.
    leaf_rows: rows on either side of a cut, at least."""

    sample: int = 50_000
    bins: int = 64
    pair_bins: int = 12
    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.15
    leaves: int = 4
    pairs: int = 10
    leaf_rows: int = 4
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    """edges, tables: of each feature. pairs: (feature, feature, edges, edges, table). base: log-odds at the start."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (edges, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, ea, eb, t in self.pairs:
            out += t[np.searchsorted(ea, x[:, a], side="right"), np.searchsorted(eb, x[:, b], side="right")]
        return out


_KIND = np.full(256, 4, np.uint8)  # 0 lower or upper letter, 1 digit, 2 white space, 3 , and ., 4 other mark, 5 beyond ASCII
_KIND[[*range(65, 91), *range(97, 123)]] = 0
_KIND[48:58] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 2
_KIND[[44, 46]] = 3
_KIND[128:] = 5
_MARKED = re.compile(rb"[^A-Za-z0-9\x80-\xff]$")


def features(text: str) -> list[float]:
    """The features of a text; an empty one has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, m = len(raw), len(words)
    at = np.frombuffer(raw, np.uint8)
    count = np.bincount(at, minlength=256)
    kinds = np.bincount(_KIND, count, 6)
    sizes = np.fromiter(map(len, words), np.int64, m)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in b".!?:;" for x in lines)
    first = np.fromiter((w[0] for w in words), np.uint8, m)
    last = np.fromiter((w[-1] for w in words), np.uint8, m)
    plain = n - kinds[2] or 1
    marks = count[_KIND == 4]
    bare = (_KIND[last] == 0) | (_KIND[last] == 5)
    return [
        np.log1p(n), np.log1p(m), sizes.mean(), len(seen) / m, max(seen.values()) / m, (sizes > 12).mean(), count[65:91].sum() / plain, kinds[1] / plain, kinds[3] / plain, kinds[4] / plain,
        float((marks > 0).sum()), kinds[5] / plain, m / len(lines), 1 - len(set(lines)) / len(lines), ends / len(lines), ((first >= 65) & (first <= 90)).mean(), bare.mean(), np.log1p(sizes.max()), kinds[2] / n, 1 - len(set(zip(words, words[1:]))) / max(m - 1, 1),
    ]


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins of about equal weight."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.empty(0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, least: int) -> np.ndarray:
    """The best step function over ordered bins, grown leaf by leaf, with Newton steps: its value at each bin."""
    cg, ch, cn = (np.concatenate([[0], np.cumsum(v)]) for v in (g, h, n))

    def cut(a: int, b: int) -> tuple[float, int]:
        k = np.arange(a + 1, b)
        k = k[(cn[k] - cn[a] >= least) & (cn[b] - cn[k] >= least)]
        if not len(k):
            return 0.0, 0
        part = lambda lo, hi: (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + 1)
        gain = part(a, k) + part(k, b) - part(a, b)
        i = int(gain.argmax())
        return float(gain[i]), int(k[i])

    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, k, i = max((*cut(a, b), i) for i, (a, b) in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, k), (k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Two levels over a grid: the best cut of one axis, then on either side the best of the other."""
    best: tuple[float, np.ndarray] = (-1.0, np.zeros(g.shape))
    for flip in (False, True):
        gg, hh, nn = (v.T if flip else v for v in (g, h, n))
        for k in range(1, len(gg)):
            out, gain = np.zeros(gg.shape), 0.0
            for part in (slice(0, k), slice(k, None)):
                sg, sh, sn = (v[part].sum(axis=0) for v in (gg, hh, nn))
                step = _tree(sg, sh, sn, 2, least)
                out[part] = step
                gain += float((step * sg).sum())
            if gain > best[0]:
                best = gain, out.T if flip else out
    return best[1]


def fit(x: np.ndarray, y: np.ndarray, p: Params = Params()) -> Model:
    """Without rows of both classes the tables are zeros and the base is the share of ones (one half without rows)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, j], p.bins) for j in range(x.shape[1])]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(base, edges, tables, [])
    if len(set(y)) < 2:
        return model
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    f = np.full(len(y), base)
    for _ in range(p.rounds):
        for b, t in zip(binned, tables, strict=True):
            q = sigmoid(f)
            step = p.rate * _tree(np.bincount(b, y - q, len(t)), np.bincount(b, q * (1 - q), len(t)), np.bincount(b, minlength=len(t)), p.leaves, p.leaf_rows)
            t += step
            f += step[b]
    strength = [np.abs(t[b]).mean() for b, t in zip(binned, tables, strict=True)]
    strong = sorted(np.argsort(strength)[::-1][:8].tolist())
    coarse = {j: _edges(x[:, j], p.pair_bins) for j in strong}
    cell = {j: np.searchsorted(coarse[j], x[:, j], side="right") for j in strong}

    def grids(a: int, b: int) -> tuple[np.ndarray, ...]:
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        at, q = cell[a] * shape[1] + cell[b], sigmoid(f)
        return tuple(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (y - q, q * (1 - q), np.ones(len(y))))

    def gain(a: int, b: int) -> float:
        g, h, n = grids(a, b)
        return float((_pair_tree(g, h, n, p.leaf_rows) * g).sum())

    for a, b in sorted(combinations(strong, 2), key=lambda ab: -gain(*ab))[: p.pairs]:
        model.pairs.append((a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))))
    for _ in range(p.pair_rounds):
        for a, b, _, _, t in model.pairs:
            step = p.rate * _pair_tree(*grids(a, b), p.leaf_rows)
            t += step
            f += step[cell[a], cell[b]]
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = [features(t) for t in texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = np.array([features(t) for t in texts(batch.column("text"))]).reshape(batch.num_rows, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(model.value.log_odds(x)))], names=["doc_id", "score"])


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """docs -> (doc_id, held_out boolean, score double, predicted int), one row per row of docs.

    Labels are learned from documents whose crc32(id as text) mod 4 is not 2; the others are held out. Null and empty
    texts have features of zero and are scored like others. Null ids aren't learned from; rows that repeat an id are
    scored each. Other columns are ignored; an empty table gives an empty result.
    """
    p = params
    learned = rename_columns(labels, doc_id=id_col, y=label_col).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold("doc_id", 4) != 2))
    there = learned.select("doc_id").distinct().join(rename_columns(docs, doc_id=id_col), "doc_id", "left_semi").count()
    known = bounded(labelled(docs, labels, label_col, id_col, text_col).where(fold("doc_id", 4) != 2), p.sample, there)
    got = known.select("text", "y").mapInArrow(_measured, "y int, x array<double>").toPandas()
    model = fit(np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES)), got["y"].to_numpy(float), p)
    own = rename_columns(docs, doc_id=id_col, text=text_col)
    out = own.mapInArrow(partial(_scored, model=docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {dict(own.dtypes)['doc_id']}, score double")
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))
