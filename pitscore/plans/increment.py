"""Incremental store: data sets are normalised once, panel quarters are built once.

Filings lie in partitions (load, data set); a log of loads says which load of a data set counts. The log is
written last, so a job that is lost in between leaves the store as it was and is simply run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitscore.operators import ingest
from pitscore.operators.bargain import enrich_panel
from pitscore.plans.panel import historical_raw, signals_of
from pitscore.sources import readers

FILINGS = (
    "ticker string, cik bigint, field string, amount double, period date, filed date, form string, tag string, "
    "qtrs bigint, load int, dataset_quarter string"
)
LOADS = "dataset_quarter string, state string, load int, first_filed date"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the store, empty where it was not written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that occur in ``df`` and leave all others."""
    writer = df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by).parquet(path)


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Names, sizes and times of the files below ``path`` with their data set; no content is read."""
    label = F.regexp_extract("path", r"(\d{4}q[1-4])", 1).alias("dataset_quarter")
    listed = spark.read.format("binaryFile").load(path)
    return listed.select(label, "path", "length", "modificationTime", F.lit(kind).alias("kind")).filter("dataset_quarter <> ''")


def _current(loads: DataFrame) -> DataFrame:
    """The load that counts, per data set."""
    latest = loads.groupBy("dataset_quarter").agg(F.max(F.struct("load", "state")).alias("l"))
    return latest.select("dataset_quarter", "l.load", F.col("l.state").alias("_state"))


def append_filings(
    spark: SparkSession, sub_path: str, num_path: str, cik_map: DataFrame, root: str, force: bool = False
) -> tuple[list[str], date | None]:
    """Normalise the data sets whose files are new or changed; returns them and their first filing date.

    ``sub_path`` and ``num_path`` may hold wildcards. A data set is read once both of its files exist; one whose
    files are gone stays. Tickers are those of ``cik_map`` at the time of loading; ``force`` loads all again.
    The first filing date counts the rows that a changed data set had before.
    """
    loads = _stored(spark, f"{root}/filing_loads", LOADS)
    one = F.concat_ws(":", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    found = (
        _files(spark, sub_path, "sub").unionByName(_files(spark, num_path, "num"))
        .groupBy("dataset_quarter")
        .agg(
            F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(one))), 256).alias("state"),
            F.collect_list(F.when(F.col("kind") == "sub", F.col("path"))).alias("sub"),
            F.collect_list(F.when(F.col("kind") == "num", F.col("path"))).alias("num"),
        )
        .filter((F.size("sub") > 0) & (F.size("num") > 0))
        .join(_current(loads), "dataset_quarter", "left")
    )
    # One row per data set: four a year.
    rows = found.filter(F.lit(force) | ~F.col("state").eqNullSafe(F.col("_state"))).orderBy("dataset_quarter").collect()
    if not rows:
        return [], None
    labels = [r.dataset_quarter for r in rows]
    load = (loads.agg(F.max("load")).first()[0] or 0) + 1
    sub = readers.read_filing_headers(spark, [f for r in rows for f in r["sub"]])
    num = readers.read_filing_numbers(spark, [f for r in rows for f in r["num"]])
    filings = f"{root}/filings"
    _overwrite_partitions(ingest.filings_by_set(sub, num, cik_map).withColumn("load", F.lit(load)), filings, "load", "dataset_quarter")
    first = spark.read.schema(FILINGS).parquet(filings).filter(F.col("load") == load).groupBy("dataset_quarter").agg(F.min("filed").alias("first_filed"))
    entries = spark.createDataFrame([(r.dataset_quarter, r.state, load) for r in rows], "dataset_quarter string, state string, load int")
    before = loads.filter(F.col("dataset_quarter").isin(labels)).agg(F.min("first_filed")).first()[0]
    entries.join(first, "dataset_quarter", "left").select("dataset_quarter", "state", "load", "first_filed").write.mode("append").parquet(f"{root}/filing_loads")
    now = first.agg(F.min("first_filed")).first()[0]
    return labels, min((d for d in (before, now) if d), default=None)


def stored_filings(spark: SparkSession, root: str) -> DataFrame:
    """Long fundamentals of all loaded data sets, as ``normalize_filing_sets`` gives them for all files at once."""
    current = _current(_stored(spark, f"{root}/filing_loads", LOADS)).select("dataset_quarter", "load")
    return ingest.latest_of_sets(_stored(spark, f"{root}/filings", FILINGS).join(current, ["dataset_quarter", "load"], "left_semi"))


def append_quarters(
    members: DataFrame,
    prices: DataFrame,
    fundamentals: DataFrame,
    universe: DataFrame,
    quarters: Sequence[date],
    root: str,
    changed_from: date | None = None,
) -> list[date]:
    """Build the panel quarters that the store lacks, or that lie on or after ``changed_from``; returns them.

    Own-history columns look back over a ticker's quarters, so everything from the first of these on is built;
    of stored quarters before it only the columns of that look-back are read. ``changed_from`` is the first
    date at which inputs differ from those of the stored quarters.
    """
    spark, path = members.sparkSession, f"{root}/panel"
    known = _stored(spark, path, "quarter_end date")
    have = {r[0] for r in known.select("quarter_end").distinct().collect()}
    open_ = [q for q in quarters if q not in have or (changed_from is not None and q >= changed_from)]
    if not open_:
        return []
    wanted = sorted(q for q in quarters if q >= min(open_))
    new = signals_of(historical_raw(members.filter(F.col("quarter_end").isin(wanted)), prices, fundamentals))
    rows = new
    if have:
        earlier = spark.read.parquet(path).filter(F.col("quarter_end") < min(wanted)).select("quarter_end", "ticker", "earnings_yield")
        rows = new.unionByName(earlier, allowMissingColumns=True)
    panel = enrich_panel(rows).filter(F.col("quarter_end").isin(wanted))
    _overwrite_partitions(ingest.first_sector(panel, universe), path, "quarter_end")
    return wanted
