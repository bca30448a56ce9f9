"""Monthly, forward and excess returns."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscore.functions.columns import has_number, ratio
from pitscore.operators.asof import prices_at_quarters, spine_literal
from pitscore.params import BENCHMARK, HORIZONS


def monthly_returns(prices: DataFrame) -> DataFrame:
    """Return per calendar month from the last close of each month: ``month, ticker, return``.

    A month without a close counts as unchanged (return 0, catch-up afterwards); the first month
    of a ticker has no return. Closes are reduced to one row per (ticker, month) before the
    shuffle, and the months between two observations are expanded in place.
    """
    month_close = (
        prices.filter(has_number("close"))
        .groupBy("ticker", F.last_day("trade_date").alias("_end"))
        .agg(F.max_by("close", "trade_date").alias("close"))
    )
    series = W.partitionBy("ticker").orderBy("_end")
    following = F.sequence(F.date_add("_from", 1), F.col("_end"), F.expr("interval 1 month"))
    return (
        month_close.withColumns({"_before": F.lag("close").over(series), "_from": F.lag("_end").over(series)})
        .filter(F.col("_from").isNotNull())
        .withColumn("month", F.explode(F.transform(following, F.last_day)))
        .select(
            "month",
            "ticker",
            F.when(F.col("month") == F.col("_end"), ratio("close", "_before") - 1.0).otherwise(0.0).alias("return"),
        )
        .filter(F.col("return").isNotNull())
    )


def _forward(px: Column, k: int, series) -> Column:
    later = F.lead(px, k).over(series)
    return F.when(later > 0, ratio(later, px) - 1.0)


def forward_returns(
    panel: DataFrame, prices: DataFrame, quarters: Sequence[date], benchmark: str = BENCHMARK
) -> DataFrame:
    """Forward and excess returns per panel ticker and quarter, for every horizon.

    Horizons are positions in the panel's sorted quarter list. Prices carry forward without
    limit, so every ticker of the panel has rows from its first price on, member or not.
    ``as_of_quarter, ticker, fwd_<h>.., excess_<h>..``
    """
    listed = panel.select("ticker").distinct()
    grid = prices_at_quarters(prices, quarters)
    # Carry-forward leaves no holes: k rows ahead is k quarters ahead.
    series = W.partitionBy("ticker").orderBy("q")
    fwd = grid.select(
        "ticker", "q", "quarter_end", "price",
        *[F.when(F.col("price") > 0, _forward(F.col("price"), k, series)).alias(f"fwd_{h}") for h, k in HORIZONS.items()],
    )
    market = fwd.filter(F.col("ticker") == benchmark).select(
        F.col("quarter_end"), *[F.col(f"fwd_{h}").alias(f"_m_{h}") for h in HORIZONS]
    )
    return (
        fwd.filter((F.col("price") > 0) & (F.col("ticker") != benchmark))
        .join(listed, "ticker", "left_semi")
        .join(market, "quarter_end", "left")
        .select(
            F.col("quarter_end").alias("as_of_quarter"),
            "ticker",
            *[f"fwd_{h}" for h in HORIZONS],
            *[(F.col(f"fwd_{h}") - F.col(f"_m_{h}")).alias(f"excess_{h}") for h in HORIZONS],
        )
    )


def next_quarter_returns(forward: DataFrame, quarters: Sequence[date]) -> DataFrame:
    """One-quarter returns labelled with the panel quarter they end in: ``quarter_end, ticker, fwd_return``."""
    spine = spine_literal(quarters)
    here = F.array_position(spine, F.col("as_of_quarter")).cast("int")
    return (
        forward.filter(F.col("fwd_1q").isNotNull())
        .select(F.get(spine, here).alias("quarter_end"), "ticker", F.col("fwd_1q").alias("fwd_return"))
        .filter(F.col("quarter_end").isNotNull())
    )
