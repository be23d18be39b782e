"""Labelled rows and folds, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rename_columns


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


#: Labels that are sent whole to the tasks (some 16 bytes each); beyond that, they are joined by a shuffle.
SENT_LABELS = 2_000_000


def known_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y 0 or 1); a null label or id is none, several labels count as their maximum."""
    known = rename_columns(labels, doc_id=id_col, y=label_col).where("doc_id is not null and y is not null").groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    return F.broadcast(known) if labels.count() <= SENT_LABELS else known


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of the documents with a label."""
    return rename_columns(docs, doc_id=id_col, text=text_col).join(known_labels(labels, label_col, id_col), "doc_id")


def bounded(df: DataFrame, rows: int, of: int) -> DataFrame:
    """About so many rows of a table of `of` rows (all, if it has no more), chosen by the ids' hashes: the same ones at
    every run. An explicit bound, for fitting only."""
    return df if of <= rows else df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rows / of * (1 << 30)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method with a ridge on all but the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
