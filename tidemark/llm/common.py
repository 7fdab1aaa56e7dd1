"""Shared helpers: durable intermediate tables, column hygiene, Arrow access to text bytes."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Split pattern of words: runs of anything but ASCII white space.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, partition: str | None = None) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it again. Removed when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_ROWS, _BYTES = (f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes"))
BATCH_BYTES = 1 << 24


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Bounds the rows and bytes of an Arrow batch; texts may be long. Never raises the session's own bounds."""
    for name, most in ((_ROWS, rows), (_BYTES, BATCH_BYTES)):
        held = spark.conf.get(name)
        # a size may have a unit; one of bytes is as it is read back
        now = int(held.removesuffix("b")) if held.removesuffix("b").lstrip("-").isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within it, Arrow batches of what is run have up to so many rows, of BATCH_BYTES; the session's own setting returns."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values, and where each begins; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def in_chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 21):
    """Slices of a batch whose texts hold about `limit` bytes, or one row where its text is longer."""
    _, bounds = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def with_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; other columns, whatever their names, can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
