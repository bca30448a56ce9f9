"""Exact shard sizes, gapless slots, row sums of the matrix, and the law of the draws."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pitscore.llm import sharding


def test_hypergeometric_law(spark):
    total, good, draws, n = 60, 25, 18, 40_000
    u = (F.col("id") + 0.5) / n
    got = spark.range(n).select(sharding.hypergeometric(F.lit(total).cast("long"), F.lit(good).cast("long"), F.lit(draws).cast("long"), u).alias("k"))
    counts = {r.k: r["count"] for r in got.groupBy("k").count().collect()}
    for k in range(draws + 1):
        p = math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws)
        assert abs(counts.get(k, 0) / n - p) < 2 / n + 1e-9


def test_matrix_sums(spark):
    sizes = [7, 0, 30, 1, 12]
    shards = [10, 10, 10, 10, 10]
    frame = spark.createDataFrame([(i * 3, s) for i, s in enumerate(sizes)], "_part bigint, n bigint")
    rows = {r._part: r.counts for r in sharding.communication_matrix(frame, shards, 4).collect()}
    assert [sum(rows[i * 3]) for i in range(5)] == sizes
    assert [sum(c) for c in zip(*rows.values())] == shards and min(map(min, rows.values())) >= 0


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_ROWS", 10)
    docs = spark.range(0, 1003, 1, 7).select(F.col("id").alias("doc_id"), F.lit("x").alias("slot"))
    out = sharding.uniform_shards(docs, 8).collect()
    assert sorted(r.doc_id for r in out) == list(range(1003))
    by = {s: sorted(r.slot for r in out if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} == {125, 126}
    # A uniform shuffle: every input partition spreads over all shards, and order is lost.
    assert len({(r.doc_id // 144, r.shard) for r in out}) == 56
