"""Shared helpers: written intermediate tables, bounded slices of Arrow batches, table access."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from pitscore.session import scratch_dir

#: Bytes of text that a worker handles at once; a longer text is handled alone.
SLICE_BYTES = 2 << 20
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, *parts: str) -> str:
    """Write ``df`` to the shared folder, in folders by the values of ``parts``; its path."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    _WRITTEN.append(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: durable, prunable, of known size."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of plans that nothing holds any more: it learns of them by garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def drop_staged(spark: SparkSession) -> None:
    """Delete all tables that ``staged`` wrote; only for an owner whose results are written already."""
    while _WRITTEN:
        delete(spark, _WRITTEN.pop())


def filled(texts: pa.Array) -> pa.StringArray:
    """Texts with null as empty."""
    return pc.fill_null(texts.cast(pa.string()), "")


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task shares the executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can trim
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], fill: bool = True, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``limit`` bytes of ``text``; null texts become empty unless ``fill`` is off.

    Memory that the task has freed by its last slice goes back to the system.
    """
    for batch in batches:
        k = batch.schema.get_field_index("text")
        texts = filled(batch.column(k))
        if fill:
            batch = batch.set_column(k, pa.field("text", pa.string()), texts)
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("int64").cumsum()
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(size.searchsorted(done + limit, "right")))
            yield batch.slice(at, end - at)
            at = end
    release()
