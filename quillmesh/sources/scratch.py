"""Intermediate tables in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, where they are one
    process, may do without: it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: worked out once, and the loss of executors doesn't undo it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that cut() has made (from the since-th on), when nothing reads them any more; how many."""
    gone, _MADE[since:] = _MADE[since:], []
    for path in gone:
        fs, at = filesystem(spark, path)
        fs.delete(at, True)
    return len(gone)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Within it, tables of cut() are for its own use; they are deleted at its end."""
    since = len(_MADE)
    try:
        yield
    finally:
        clear(spark, since)
