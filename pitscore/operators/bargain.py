"""Entry-price score: margin of safety, valuation against own history, discount to the 52-week high."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscore.functions.columns import clamp, linear_score, ratio, weighted_mean_of
from pitscore.operators.prices import history_percentile
from pitscore.params import BARGAIN_WEIGHTS, HISTORY_QUARTERS

COMPONENTS = tuple(BARGAIN_WEIGHTS)


def margin_of_safety(graham_ratio: Column) -> Column:
    return F.when(graham_ratio > 0, linear_score(graham_ratio, 0.30, 1.30))


def discount_52w(price: Column, high: Column) -> Column:
    return F.when((high > 0) & (price > 0), linear_score(1.0 - ratio(price, high), 0.0, 0.30))


def with_bargain(df: DataFrame, weights: Mapping[str, float] = BARGAIN_WEIGHTS) -> DataFrame:
    """Add ``bargain_<component>`` and ``bargain_score``; a stored 52-week component is used where
    price or high are unusable. The obsolete RSI component is dropped."""
    discount = discount_52w(F.col("price"), F.col("fifty_two_week_high"))
    if "bargain_discount_52w" in df.columns:
        discount = F.coalesce(discount, F.col("bargain_discount_52w"))
    df = df.withColumns(
        {
            "bargain_margin_of_safety": margin_of_safety(F.col("graham_ratio")),
            "bargain_valuation_vs_history": clamp("valuation_vs_history", 0.0, 100.0),
            "bargain_discount_52w": discount,
        }
    )
    return df.withColumn("bargain_score", reweighted(weights)).drop("bargain_rsi_oversold")


def reweighted(weights: Mapping[str, float]) -> Column:
    """Score from stored components under any weights."""
    return F.round(weighted_mean_of({f"bargain_{k}": float(weights.get(k, 0.0)) for k in COMPONENTS}), 9)


def with_valuation_vs_history(panel: DataFrame) -> DataFrame:
    """Earnings yield against the ticker's previous 20 panel rows (current row excluded).

    A ticker has at most one panel row per quarter, which bounds the window partition.
    """
    past = W.partitionBy("ticker").orderBy("quarter_end").rowsBetween(-HISTORY_QUARTERS, -1)
    return panel.withColumn("_h", F.collect_list("earnings_yield").over(past)).withColumn(
        "valuation_vs_history", history_percentile(F.col("earnings_yield"), F.col("_h"))
    ).drop("_h")


def enrich_panel(panel: DataFrame) -> DataFrame:
    return with_bargain(with_valuation_vs_history(panel))
