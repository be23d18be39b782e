"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Layout of a folder: `ranks/` (rank, id: the most frequent id has rank 0) and `blocks/`, Parquet tables both. A block
holds whole documents: their ids, their lengths, the control bytes (two bits a value: its number of bytes less one,
four values a byte, the first in the lowest bits) and the data bytes (each value's low bytes first). Blocks in the
order of (shard, block) hold the documents in ascending order.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rename_columns, shared_dir, slices, texts, written
from .tokens import encoder

#: Number of bytes of each of the four values of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Unsigned 32-bit values -> control bytes, data bytes."""
    v = np.ascontiguousarray(values, "<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def _tokens(batches: Iterator[pa.RecordBatch], vocabulary, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary.value)
    for batch in slices(batches, 256):
        ids = [np.append(x, enc.dtype.type(end_id)).tobytes() for x in enc.encode(texts(batch.column("text")))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])


def _counts(batches: Iterator[pa.RecordBatch], dtype: np.dtype, n: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(n, np.int64)
    for batch in slices(batches):
        total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype), minlength=n)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])


def _blocks(batches: Iterator[pa.RecordBatch], dtype: np.dtype, ranks, block_ids: int) -> Iterator[pa.RecordBatch]:
    shard, block, before = TaskContext.get().partitionId(), 0, 0
    docs: list[int | None] = []
    held: list[np.ndarray] = []
    n = 0

    def flush() -> pa.RecordBatch:
        control, data = encode_values(ranks.value[np.concatenate(held)])
        row = ([shard], pa.int32()), ([block], pa.int32()), ([before], pa.int64()), ([n], pa.int64()), ([docs], pa.list_(pa.int64())), ([[len(x) for x in held]], pa.list_(pa.int64())), ([control], pa.binary()), ([data], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in row], names=["shard", "block", "before", "n", "doc_ids", "lengths", "control", "data"])

    for batch in slices(batches):
        for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            docs.append(doc)
            held.append(np.frombuffer(raw, dtype))
            n += len(held[-1])
            if n >= block_ids:
                yield flush()
                block, before, docs, held, n = block + 1, before + n, [], [], 0
    if held:
        yield flush()


def write_ids(docs: DataFrame, path: str, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block_ids: int = 1 << 18) -> None:
    """Encodes docs and writes the folder at path.

    Null and empty texts are the end id alone. Rows with a null id come first; rows that repeat an id follow each
    other, in an order of their ids' hash. Other columns are ignored. An empty table gives a folder without blocks.
    A block ends with the document that brings it to block_ids ids.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:  # the driver's; executors get the content
        content = f.read()
    vocabulary = spark.sparkContext.broadcast(content)
    enc = encoder(content)
    size = max(enc.tokenizer.get_vocab_size(), end_id + 1)
    own = rename_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    made = written(own.mapInArrow(partial(_tokens, vocabulary=vocabulary, end_id=end_id), "doc_id long, ids binary"))
    counts = made.select("ids").mapInArrow(partial(_counts, dtype=enc.dtype, n=size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]  # the vocabulary's size at most
    order += sorted(set(range(size)).difference(order))
    rank = np.empty(size, np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)
    spark.createDataFrame(list(enumerate(order)), "rank long, id long").write.parquet(f"{path}/ranks")
    keyed = made.withColumn("tie", F.xxhash64("ids"))
    dealt = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    schema = "shard int, block int, before long, n long, doc_ids array<long>, lengths array<long>, control binary, data binary"
    dealt.mapInArrow(partial(_blocks, dtype=enc.dtype, ranks=spark.sparkContext.broadcast(rank), block_ids=block_ids), schema).write.option("compression", "zstd").parquet(f"{path}/blocks")


def _read(batches: Iterator[pa.RecordBatch], bases, ids, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        r = batch.to_pylist()[0]
        values = ids.value[decode_values(r["control"], r["data"], r["n"])]
        lengths = np.array(r["lengths"], np.int64)
        ends = np.cumsum(lengths)
        body = [values[a:b].tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
        start = bases.value[r["shard"]] + r["before"] + ends - lengths
        out = [pa.array(r["doc_ids"], pa.int64()), pa.array(start), pa.array(lengths), pa.array([zlib.crc32(b) for b in body], pa.int64())]
        yield pa.RecordBatch.from_arrays(out + [pa.array(body, pa.binary())] * with_ids, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A folder written by write_ids -> doc_id, start (ids of all documents before), n_tokens, ids_crc32 (long), and
    with with_ids the ids as little-endian unsigned 32-bit integers (binary)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    table = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy("<u4")  # the vocabulary's size
    bases, total = {}, 0
    for shard, n in sorted(tuple(r) for r in blocks.groupBy("shard").agg(F.sum("n")).collect()):  # a row for each shard
        bases[shard] = total
        total += n
    send = spark.sparkContext.broadcast
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return blocks.select("shard", "before", "n", "doc_ids", "lengths", "control", "data").mapInArrow(partial(_read, bases=send(bases), ids=send(table), with_ids=with_ids), schema)


def round_trip(docs: DataFrame, vocabulary_path: str, **options) -> DataFrame:
    """write_ids to a new folder in the shared folder, then read_ids from it."""
    path = f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, vocabulary_path, **options)
    return read_ids(docs.sparkSession, path)
