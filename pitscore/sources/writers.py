"""Sinks for stage tables and result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: str | None = None, overwrite: bool = True) -> None:
    """Parquet sink. A partitioned table is clustered by its partition first, so that a partition
    is written by few tasks; within a hot partition AQE splits the rebalanced rows."""
    if partition_by:
        df = df.hint("rebalance", partition_by)
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_snapshot(universe: DataFrame, path: str) -> None:
    """Universe snapshot with the UTC time of writing."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    write_table(universe.withColumn("snapshot_date", stamp), path)


def write_result(df: DataFrame, path: str) -> None:
    """Result documents as JSON lines, one per row."""
    df.write.mode("overwrite").json(path)
