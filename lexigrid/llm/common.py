"""Helpers that the training-data operators share: shared folders, bounded Arrow batches, column access."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches that reach Python hold at most so many rows and bytes, so a worker's memory doesn't grow with the table.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary folder only where that is unset."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    made = tempfile.mkdtemp(prefix="lexigrid-")
    sc.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def new_table(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/lexigrid-{kind}-{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of new_table() that nothing reads any more: what was made from it must have been cut."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns named by their places, and the new name of each old one: no name of df can then clash with one of ours."""
    names = [f"column_{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


#: Tables of so many narrow rows (some 100 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle and checkpoint files of what is no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the texts of a slice hold about `most_bytes`; a longer text makes a slice of its own."""
    for batch in batches:
        start, held = 0, 0
        column_at = batch.column(column)
        for row in range(batch.num_rows):
            size = column_at[row].as_buffer().size if column_at[row].is_valid else 0
            if row > start and held + size > most_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
    trim()


def trim() -> None:
    """Give what a worker has freed back to the system, so workers that wait for their next task hold little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle that carries texts: the session's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
