"""Scans with declared columns; a text file's own header line names its columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitscore.functions.columns import clean_ticker, parse_yyyymmdd, to_double
from pitscore.sources import schemas


def _by_header(spark: SparkSession, path: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files below ``path`` (one a data set) by their header; only first lines are read."""
    files = [r[0] for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    found: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(files):
        header = spark.read.csv(file, sep="\t", header=True, inferSchema=False, quote="").columns
        found.setdefault(tuple(header), []).append(file)
    return found


def _tsv(spark: SparkSession, path: str | Sequence[str], needed: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Tab-separated files, all text, each read by its own header; a missing optional column is NULL."""
    parts = []
    for header, files in _by_header(spark, path).items():
        lacking = [c for c in needed if c not in header]
        if lacking:
            raise ValueError(f"{files[0]} has no column {', '.join(lacking)}")
        if optional and not any(c in header for c in optional):
            raise ValueError(f"{files[0]} has none of the columns {', '.join(optional)}")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        rows = spark.read.csv(files, sep="\t", header=True, schema=schema, quote="", mode="PERMISSIVE", enforceSchema=True)
        parts.append(rows.select(*needed, *[c for c in optional if c in header], F.col("_metadata.file_path").alias("_file")))
    if not parts:
        raise ValueError(f"no file in {path}")
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return rows.withColumns({c: F.lit(None).cast("string") for c in optional if c not in rows.columns})


def _dataset_quarter() -> F.Column:
    """Data-set label (like 2012q3) taken from the folder of the file."""
    return F.nullif(F.regexp_extract("_file", r"(\d{4}q[1-4])", 1), F.lit("")).alias("dataset_quarter")


def read_filing_headers(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per filing of one path or several; ``cik`` and dates that do not parse become NULL."""
    df = _tsv(spark, path, schemas.FILING_HEADER_COLUMNS)
    return df.withColumns(
        {
            "cik": F.col("cik").try_cast("long"),
            "period": parse_yyyymmdd("period"),
            "filed": parse_yyyymmdd("filed"),
        }
    ).select("*", _dataset_quarter()).drop("_file")


def read_filing_numbers(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per reported value; the amount is ``value``, or ``uval`` in a file without that column."""
    df = _tsv(spark, path, schemas.FILING_NUMBER_COLUMNS, schemas.FILING_AMOUNT_COLUMNS)
    return df.select(
        "adsh",
        "tag",
        parse_yyyymmdd("ddate").alias("ddate"),
        F.col("qtrs").try_cast("long").alias("qtrs"),
        to_double(F.coalesce(*schemas.FILING_AMOUNT_COLUMNS)).alias("amount"),
        _dataset_quarter(),
    )


def read_membership_history(spark: SparkSession, path: str) -> DataFrame:
    """``date, tickers`` (comma list); rows without a readable date are dropped."""
    schema = T.StructType([T.StructField("date", T.StringType()), T.StructField("tickers", T.StringType())])
    df = spark.read.csv(path, header=True, schema=schema)
    return df.withColumn("date", F.col("date").try_cast("date")).filter(F.col("date").isNotNull())


def read_company_map(spark: SparkSession, path: str) -> DataFrame:
    """Company map: one JSON object whose entries hold ``cik_str, ticker, title``; first per cik wins."""
    entry = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
    entries = (
        spark.read.text(path, wholetext=True)
        .select(F.from_json("value", entry).alias("m"))
        .select(F.posexplode("m").alias("pos", "k", "e"))
    )
    return (
        entries.groupBy(F.col("e.cik_str").alias("cik"))
        .agg(F.min_by(F.struct(clean_ticker("e.ticker").alias("ticker"), F.col("e.title").alias("name")), "pos").alias("r"))
        .select("cik", "r.ticker", "r.name")
    )


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """One ticker per line; blank lines and ``#`` comments are skipped."""
    return (
        spark.read.text(path)
        .select(clean_ticker("value").alias("ticker"))
        .filter((F.col("ticker") != "") & ~F.col("ticker").startswith("#"))
    )
