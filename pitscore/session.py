"""Session helpers: shared scratch folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_STAGES: dict[tuple[str, ...], DataFrame] = {}


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pitscore")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.files.maxPartitionBytes", "1m")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables, as the cluster names it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage durably (a lost executor costs no recomputation), keeps column pruning and
    pushdown for the readers, and gives the planner the true size, so that the ordinary
    broadcast threshold decides how the table is joined.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _state(spark: SparkSession, folder: str) -> str:
    """Names, times and sizes of a folder's tables: one listing, whatever their size."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return "|".join(sorted(f"{f.getPath().getName()}:{f.getModificationTime()}:{f.getLen()}" for f in found))


def stage(spark: SparkSession, key: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """Table of a pipeline stage of the folder ``key[0]``, written on first use in this application and read by later ones.

    A folder whose tables were replaced since then has other stages.
    """
    full = (spark.sparkContext.applicationId, *key, _state(spark, key[0]))
    if full not in _STAGES:
        _STAGES[full] = materialize(build())
    return _STAGES[full]
