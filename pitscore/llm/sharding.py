"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, native.

How many rows of partition p go to shard s is drawn first, from the law that a uniform permutation of all
rows would give: the matrix has the partitions' sizes as row sums and the shards' sizes as column sums. Rows
are permuted inside their partition and dealt by the matrix, exchanged once, and permuted again inside their
shard. The matrix is drawn along a binary tree over the partitions: a node splits its column sums between
its halves by univariate hypergeometric draws, shard by shard, all nodes of a level at once in one projection.

A draw inverts the distribution from its mode outwards; the terms left out have a mass below 1e-30.

Defined results: rows count one each, whatever they hold, so nulls, repeated rows and long texts need no
care; columns named like the helper columns (``_part`` and so on), ``shard`` or ``slot`` are replaced; an
empty table gives an empty result; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscore.llm.common import staged

#: Rows numbered together inside a shard.
RUN_ROWS = 50_000


def _uniform(*key: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """The number of good items among ``draws`` out of ``total``, by inversion of the uniform ``u``."""
    n, c, d = total.cast("double"), good.cast("double"), draws.cast("double")
    lowest, highest = F.greatest(F.lit(0).cast("long"), draws - (total - good)), F.least(good, draws)
    mode = F.least(highest, F.greatest(lowest, F.floor((d + 1) * (c + 1) / (n + 2)).cast("long")))
    spread = F.sqrt(d * (c / F.greatest(n, F.lit(1.0))) * (1 - c / F.greatest(n, F.lit(1.0))) * (n - d) / F.greatest(n - 1, F.lit(1.0)))
    width = F.ceil(12 * F.greatest(spread, F.lit(0.0)) + 24).cast("long")
    up, down = F.sequence(mode, F.least(highest, mode + width)), F.sequence(mode, F.greatest(lowest, mode - width))

    def rise(k: Column) -> Column:
        k = k.cast("double")
        return (c - k) * (d - k) / ((k + 1) * (n - c - d + k + 1))

    def fall(k: Column) -> Column:
        k = k.cast("double")
        return k * (n - c - d + k) / ((c - k + 1) * (d - k + 1))

    def state(w: Column, first: Column, goal: Column, k: Column) -> Column:
        return F.struct(w.alias("w"), first.alias("sum"), goal.alias("goal"), k.alias("k"))

    def step(ratio):
        def one(s: Column, k: Column) -> Column:
            after = s["sum"] + s["w"]
            return state(s["w"] * ratio(k), after, s["goal"], F.when((s["k"] < 0) & (after >= s["goal"]), k).otherwise(s["k"]))

        return one

    def walk(goal: Column) -> Column:
        """The sum of all weights and the place where it reaches ``goal``, upwards from the mode, then downwards."""
        above = F.aggregate(up, state(F.lit(1.0), F.lit(0.0), goal, F.lit(-1).cast("long")), step(rise))
        turned = F.transform(F.array(above), lambda s: state(fall(mode), s["sum"], s["goal"], s["k"]))[0]
        return F.aggregate(F.slice(down, 2, F.greatest(F.size(down) - 1, F.lit(0))), turned, step(fall))

    # The goal travels in the state: an expression inside a step would be computed anew at each one.
    found = walk(u * walk(F.lit(float("inf")))["sum"])["k"]
    drawn = F.transform(F.array(found), lambda k: F.when(k < 0, mode).otherwise(k))[0]
    return F.when(lowest >= highest, lowest).otherwise(drawn)


def _left_half(sizes: Column, draws: Column, *key: Column) -> Column:
    """Of column sums ``sizes``, the part that ``draws`` rows take."""
    state = F.struct(
        draws.cast("long").alias("draws"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"),
        F.array().cast("array<bigint>").alias("out"),
    )

    def step(s: Column, j: Column) -> Column:
        good = F.element_at(sizes, j)
        k = hypergeometric(s["total"], good, s["draws"], _uniform(*key, j))
        return F.transform(
            F.array(k), lambda k: F.struct((s["draws"] - k).alias("draws"), (s["total"] - good).alias("total"), F.concat(s["out"], F.array(k)).alias("out"))
        )[0]

    return F.aggregate(F.sequence(F.lit(1), F.size(sizes)), state, step, lambda s: s["out"])


def communication_matrix(sizes: DataFrame, shards: list[int], seed: int) -> DataFrame:
    """``_part, counts`` from ``_part, n``: one row of counts per partition; ``shards`` are the column sums."""
    leaves = staged(sizes.select("_part", "n", (F.row_number().over(W.orderBy("_part")) - 1).cast("long").alias("leaf")))
    levels = max(0, math.ceil(math.log2(max(1, leaves.count()))))
    state = sizes.sparkSession.createDataFrame([(0, shards)], "node bigint, counts array<bigint>")
    for level in range(levels):
        half = leaves.groupBy(F.shiftright("leaf", levels - level - 1).alias("node")).agg(F.sum("n").alias("n"))
        lefts = half.filter("node % 2 = 0").select(F.shiftright("node", 1).alias("node"), "n")
        left = _left_half(F.col("counts"), F.col("n"), F.lit(seed), F.lit(level), F.col("node"))
        split = state.join(lefts, "node").select("node", "counts", left.alias("l"))
        right = F.zip_with("counts", "l", lambda a, b: a - b)
        both = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("counts")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("counts")))
        state = split.select(F.inline(both))
        if level % 3 == 2:
            state = staged(state)
    return staged(leaves.join(state.withColumnRenamed("node", "leaf"), "leaf").select("_part", "counts"))


def uniform_shards(rows: DataFrame, n_shards: int, seed: int = 1) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: a uniform permutation cut into shards whose sizes differ by one at most.

    ``slot`` is the place in the shard, gapless from 0.
    """
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    # All columns of the input travel as one, so no name of theirs meets one of ours.
    data = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("none"))
    local = rows.select(data.alias("data"), F.rand(seed).alias("_first"), F.rand(seed + 1).alias("_again")).sortWithinPartitions("_first")
    place = F.monotonically_increasing_id()
    dealt = staged(local.select("data", "_again", F.shiftrightunsigned(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    sizes = staged(dealt.groupBy("_part").agg(F.count("*").alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix(sizes, shards, seed)
    ends = F.transform(F.sequence(F.lit(1), F.size("counts")), lambda j: F.aggregate(F.slice("counts", 1, j), F.lit(0).cast("long"), lambda s, x: s + x))
    sent = dealt.join(matrix.select("_part", ends.alias("_ends")), "_part")
    runs = max(1, math.ceil(total / n_shards / RUN_ROWS))
    sent = sent.select("data", "_again", F.size(F.filter("_ends", lambda e: e <= F.col("_at"))).alias("shard"), F.floor(F.col("_again") * runs).cast("int").alias("_run"))
    counts = sent.groupBy("shard", "_run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("shard").alias("_s"), F.col("_run").alias("_r"), before.alias("_before"))
    numbered = sent.withColumn("_row", F.row_number().over(W.partitionBy("shard", "_run").orderBy("_again")))
    joined = numbered.join(counts, (F.col("shard") == F.col("_s")) & (F.col("_run") == F.col("_r")))
    return joined.select(*[F.col("data").getField(c).alias(c) for c in names], "shard", (F.col("_before") + F.col("_row") - 1).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the shards to folders ``shard=<n>``, rows in the order of their slots within each file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
