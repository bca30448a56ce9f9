"""Point-in-time joins: last value known on or before a date."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscore.functions.columns import has_number, quarter_end


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str,
    right_on: str,
    values: Sequence[str],
    max_staleness_days: int | None = None,
) -> DataFrame:
    """Left rows plus ``values`` (and ``right_on``) of the last right row with time <= ``on``.

    Both sides are first reduced to one row per (key, date), so the ordered pass over a key is
    bounded by the calendar however many rows share the key; the result returns to the left rows
    through an equi-join on (key, date), which spreads a hot key over its dates.
    """
    by = list(by)
    dated = right.filter(F.col(right_on).isNotNull()).groupBy(*by, F.col(right_on).alias("_t"))
    if len(values) == 1:  # a plain maximum is aggregated by hash, one of structs by sorting all rows
        known = dated.agg(F.max(values[0]).alias("_v")).select(*by, "_t", F.struct(F.col("_t").alias(right_on), F.col("_v").alias(values[0])).alias("_known"))
    else:
        known = dated.agg(F.max(F.struct(F.col(right_on), *values)).alias("_known"))
    asked = left.select(*by, F.col(on).alias("_t")).distinct()
    merged = known.withColumn("_ask", F.lit(False)).unionByName(asked.withColumn("_ask", F.lit(True)), allowMissingColumns=True)
    # What is known on a date comes before what is asked on it.
    upto = W.partitionBy(*by).orderBy("_t", "_ask").rowsBetween(W.unboundedPreceding, 0)
    answers = (
        merged.withColumn("_known", F.last("_known", ignorenulls=True).over(upto))
        .filter("_ask")
        .select(*by, F.col("_t").alias(on), "_known")
    )
    if max_staleness_days is not None:
        fresh = F.datediff(F.col(on), F.col(f"_known.{right_on}")) <= max_staleness_days
        answers = answers.withColumn("_known", F.when(fresh, F.col("_known")))
    joined = left.join(answers, [*by, on], "left")
    return joined.select(*left.columns, *[F.col(f"_known.{c}").alias(c) for c in (right_on, *values)])


def quarter_ends(spark, start: date, end: date) -> DataFrame:
    """Calendar of quarter-ends from the first one on or after ``start`` to the first on or after ``end``."""
    span = F.sequence(quarter_end(F.lit(start)), quarter_end(F.lit(end)), F.expr("interval 3 months"))
    return spark.range(1).select(F.explode(span).alias("d")).select(F.last_day("d").alias("quarter_end"))


def panel_quarters(df: DataFrame) -> list[date]:
    """Sorted distinct quarter-ends of a panel: a list bounded by the calendar (four per year)."""
    return [r[0] for r in df.select("quarter_end").distinct().orderBy("quarter_end").collect()]


def spine_literal(quarters: Sequence[date]) -> Column:
    return F.array(*[F.lit(q) for q in sorted(quarters)])


def prices_at_quarters(prices: DataFrame, quarters: Sequence[date], max_staleness_days: int | None = None) -> DataFrame:
    """Last close on or before every quarter-end of the spine: ``ticker, quarter_end, q, price``.

    ``q`` is the position in the sorted spine. Closes are reduced to one row per (ticker, calendar
    quarter) before the shuffle; a price is carried forward (without limit, or up to
    ``max_staleness_days``) by expanding the positions up to the next observation, so no ticker x
    quarter grid is joined.
    """
    spine, last = spine_literal(quarters), len(quarters) - 1
    per_quarter = (
        prices.filter(has_number("close"))
        .groupBy("ticker", quarter_end("trade_date").alias("_qe"))
        .agg(F.max(F.struct("trade_date", F.col("close").alias("price"))).alias("_last"))
        .select("ticker", "_qe", "_last.trade_date", "_last.price")
        .withColumn("_slot", F.size(F.filter(spine, lambda d: d < F.col("_qe"))))
    )
    following = F.lead("_slot").over(W.partitionBy("ticker").orderBy("_qe"))
    grid = (
        per_quarter.withColumn("_until", F.coalesce(following - 1, F.lit(last)))
        .filter(F.col("_slot") <= F.col("_until"))
        .select("ticker", "trade_date", "price", F.explode(F.sequence("_slot", "_until")).alias("q"))
        .select("ticker", F.get(spine, F.col("q")).alias("quarter_end"), "q", "price", "trade_date")
    )
    if max_staleness_days is not None:
        grid = grid.filter(F.datediff("quarter_end", "trade_date") <= max_staleness_days)
    return grid.drop("trade_date")
