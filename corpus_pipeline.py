"""Corpus pipeline: toxicity, near duplicates, decontamination, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows it gets and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``. A stage starts after the output of the one before is written, so it first deletes the
intermediate tables of earlier stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitscore.llm import decontamination, neardedup, packing, secrets, toxicity
from pitscore.llm.common import drop_staged, staged, table
from pitscore.session import scratch_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model learns from this stage's own rows."""
    drop_staged(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.filter_documents(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id; of rows with one id, one.

    Rows without an id are linked with nothing and stay.
    """
    drop_staged(spark)
    found = staged(neardedup.near_duplicates(docs))
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return left
    again = left.join(repeated.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(repeated.select("doc_id"), "doc_id", "left_anti").unionByName(again)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    drop_staged(spark)
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and ``n_chars`` of the new text."""
    drop_staged(spark)
    rows = secrets.scan(docs)
    text = secrets.redact(F.col("text"), F.col("findings"))
    changed = F.size("findings") > 0
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences: one row per piece with its token ids."""
    drop_staged(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]
#: A trained model, signatures and a tokeniser are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
