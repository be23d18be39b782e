"""Helpers shared by the operators: shared-folder tables, batch slicing, words, hashing."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.clientserver import DEFAULT_WORKER_SLEEP_TIME
from pyspark.sql import DataFrame, SparkSession

from ..operators.skew import hub_bound, hub_join  # noqa: F401 - for the operators
from ..sources.scratch import shared_dir

_WRITTEN: list[str] = []

#: ASCII letters lowered, every other ASCII character outside 0-9 and a-z turned into a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmesh-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() has made and that nothing reads any more."""
    for t in tables:
        _WRITTEN.remove(t.scratch_path)
        _delete(t.sparkSession, t.scratch_path)


def tables_written() -> list[str]:
    """The tables that written() has made in this process and that are still there."""
    return list(_WRITTEN)


def drop_written(spark: SparkSession, paths: list[str] | None = None, keep: DataFrame | None = None) -> int:
    """Delete tables that written() has made (all, or those of paths) and that keep doesn't read; returns how many.
    Call it once the results that were made of them are stored."""
    read = {f.split("/quillmesh-")[1][:32] for f in keep.inputFiles() if "/quillmesh-" in f} if keep is not None else set()
    gone = [p for p in (_WRITTEN if paths is None else paths) if p in _WRITTEN and p.split("/quillmesh-")[1] not in read]
    for path in gone:
        _WRITTEN.remove(path)
        _delete(spark, path)
    if gone:
        collected(spark)
    return len(gone)


def collected(spark: SparkSession) -> None:
    """Let the shuffle files of finished plans go: they do when the plans are collected. Py4J tells the JVM from a thread
    of its own, which sleeps in between, what Python has let go of; collected before that, the last plan would stay."""
    gc.collect()
    time.sleep(DEFAULT_WORKER_SLEEP_TIME + 0.2)
    for _ in range(2):  # what the first collection has let Spark's cleaner release may hold others
        spark._jvm.System.gc()
        time.sleep(0.2)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that what Python holds at once stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def texts(column: pa.Array) -> list[str]:
    """A text column as a list; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def alnum_words(text: str) -> list[bytes]:
    """Words: runs of ASCII letters (lowered), ASCII digits and all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public-domain splitmix64 one), vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of flat[starts[i] : starts[i] + lengths[i]]."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return flat[np.arange(total, dtype=np.int64) + shift]


def packed(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys and numbers of each as bytes: the keys' differences and the numbers by planes of their
    bytes, compressed."""
    gaps = np.diff(keys, prepend=np.zeros(1, np.uint64))
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(keys), c.itemsize).T.tobytes() for c in (gaps, *columns))
    return len(keys).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    """What packed has made of keys and columns of these kinds."""
    n, kinds = int.from_bytes(data[:8], "little"), [np.dtype(k) for k in ("<u8", *kinds)]
    planes = np.frombuffer(pa.decompress(data[8:], n * sum(k.itemsize for k in kinds), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for k in kinds:
        out.append(np.ascontiguousarray(planes[at : at + n * k.itemsize].reshape(k.itemsize, n).T).view(k).ravel())
        at += n * k.itemsize
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def rename_columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the columns asked for, under the names given: rename_columns(df, doc_id="id"). Others can't clash."""
    return df.select(*[df[column].alias(name) for name, column in wanted.items()])
