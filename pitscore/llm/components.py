"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore.llm.common import staged


#: Edges written to one file.
EDGES_A_FILE = 100_000


def _digest(edges: DataFrame) -> tuple:
    """Number and hash sum of distinct edges: equal for equal tables, found without a shuffle of rows."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``edges(a, b)``.

    Each round hangs every node on the smallest node of its neighbourhood: first larger neighbours, then
    smaller ones. Both are a grouped minimum, found before the shuffle where possible, and an equi-join, so
    a node with many neighbours is no group in one task. Rounds grow with the logarithm of the longest path.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = _digest(now)
    # A round never has more edges than the first; small tables are not spread over many files.
    parts = max(4, -(-before[0] // EDGES_A_FILE))
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large.coalesce(parts))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = staged(small.coalesce(parts))
        now, after = small, _digest(small)
        if after == before:
            break
        before = after
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
