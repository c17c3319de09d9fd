"""Shared helpers of the training-data operators: table access, shared storage, text views of Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table below ``sf_dir``, through Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, deleted when the session's Python process ends.

    The cluster names that folder. Only on one machine (tests) a temporary one is made where it is unset: executors
    elsewhere would not see it.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="statloom-"))
        base = jsc.getCheckpointDir().get()
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(clean)
    _MADE.append((spark, path))
    return path


_MADE: list[tuple[SparkSession, str]] = []


def clean() -> None:
    """Deletes the folders that shared_dir() named; results that still read from them are lost. A session that has ended keeps its own."""
    while _MADE:
        spark, path = _MADE.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone first
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is cut, lost executors cost nothing.

    The codec is Spark's default: the zstd writer holds native memory for every page until the JVM collects garbage.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(df: DataFrame) -> DataFrame:
    """``df``; Arrow batches for Python get 1,000 rows at most, as rows hold whole texts, unless the session says otherwise."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(key) == "10000":
        conf.set(key, "1000")
    return df


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the system: workers wait for tasks beside others that run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def documents_of(df: DataFrame) -> DataFrame:
    """Exactly ``doc_id`` (long) and ``text`` (string); whatever else the table has does not get into the way."""
    short_batches(df)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def free(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``df`` has it; Spark does not tell cases apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession, size: int = 0, per: int = 128 << 20) -> int:
    """The session's number of shuffle partitions, or more if ``size`` bytes make partitions of over ``per``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // per))


def grouped(df: DataFrame, key: str, n: int) -> GroupedData:
    """``df`` by ``key``, in ``n`` partitions if the session would make fewer."""
    return (df.repartition(n, key) if n > partitions(df.sparkSession) else df).groupBy(key)


def raw_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes | None]]:
    """(doc_id, UTF-8 bytes or None) of each row of two-column batches, a few rows in memory at a time."""
    for batch in batches:
        for part in _slices(batch):
            yield from zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True)


def text_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None]]:
    """(doc_id, text or None) of each row of two-column batches."""
    for batch in batches:
        for part in _slices(batch):
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
