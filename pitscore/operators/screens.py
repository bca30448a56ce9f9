"""Screens, rankings, top-k selections and display bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscore.functions.columns import clamp, mean_of
from pitscore.functions.distributed import first_by
from pitscore.params import DCA_TOP_N, FAMILIES, TOP_FRACTION, Thresholds


def passes_gate(t: Thresholds, with_consensus: bool = True) -> Column:
    """Good-buy gate; a NULL score fails, a missing consensus does not."""
    ok = (F.col("composite") >= t.composite_min) & (F.col("bargain_score") >= t.bargain_min)
    if t.require_implied_upside:
        ok = ok & (F.col("implied_upside_pct") >= t.implied_upside_min_pct)
    if with_consensus and t.exclude_sell_consensus:
        ok = ok & ~F.col("consensus_label").eqNullSafe("Sell")
    return F.coalesce(ok, F.lit(False))


def with_good_buy(df: DataFrame, thresholds: Thresholds) -> DataFrame:
    return df.withColumn("is_good_buy", passes_gate(thresholds, "consensus_label" in df.columns))


def good_buys(scored: DataFrame, watchlist: DataFrame, thresholds: Thresholds) -> DataFrame:
    """Names of the watchlist that pass the gate."""
    return with_good_buy(scored.join(watchlist.select("ticker"), "ticker", "left_semi"), thresholds).filter("is_good_buy")


def scorecard_order() -> list[Column]:
    """Buys first, best composite first, then ticker."""
    return [F.desc("is_good_buy"), F.desc_nulls_last("composite"), F.asc("ticker")]


def scorecard(df: DataFrame) -> DataFrame:
    return df.orderBy(*scorecard_order())


def scorecard_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("is_good_buy").alias("buy_count"), F.count(F.lit(1)).alias("total_count"))


def top_by_composite(df: DataFrame, n: int = 20) -> DataFrame:
    return df.filter(F.col("composite").isNotNull()).orderBy(F.desc("composite"), F.asc("ticker")).limit(n)


def quintile_size(n: Column, fraction: float = TOP_FRACTION) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(n * fraction))


def top_fraction(
    scored: DataFrame, keys: Sequence[str] = ("quarter_end",), fraction: float = TOP_FRACTION, score: str = "composite"
) -> DataFrame:
    """Best fifth of every quarter (at least one name), by an exact cut-off value per quarter."""
    return first_by(scored, keys, score, "ticker", fraction, lambda n: quintile_size(n, fraction))


def top_n(
    scored: DataFrame, n: int = DCA_TOP_N, keys: Sequence[str] = ("quarter_end",), order: Sequence[str] = ("composite",)
) -> DataFrame:
    """Best ``n`` names per quarter. The rank filter is pushed below the shuffle by the planner
    (each task keeps its own best ``n`` per quarter), so a hot quarter stays small."""
    best = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], F.asc("ticker"))
    ready = scored.dropna(subset=list(order))
    return ready.withColumn("pick", F.row_number().over(best)).filter(F.col("pick") <= n)


def gated_top_n(
    scored: DataFrame,
    thresholds: Thresholds,
    n: int = DCA_TOP_N,
    keys: Sequence[str] = ("quarter_end",),
    order: Sequence[str] = ("composite", "bargain_score"),
) -> DataFrame:
    """Best ``n`` names per quarter among those at or above both score thresholds."""
    gate = (F.col("composite") >= thresholds.composite_min) & (F.col("bargain_score") >= thresholds.bargain_min)
    return top_n(scored.filter(gate), n, keys, order)


def percentile_band(c: Column) -> Column:
    p = clamp(c, 0.0, 100.0)
    return F.when(p.isNull(), "none").when(p <= 30, "low").when(p <= 70, "middle").otherwise("high")


def gauge_band(c: Column) -> Column:
    return F.when(c.isNull(), "N/A").when(c >= 50, "Good").when(c <= 25, "Weak").otherwise("Fair")


def proximity_band(c: Column) -> Column:
    """Distance below a high: near, moderate or discounted."""
    return F.when(c.isNull(), "none").when(c <= 0.10, "near").when(c <= 0.25, "moderate").otherwise("discounted")


def radar_values(families: Sequence[str] = tuple(FAMILIES)) -> dict[str, Column]:
    """Family percentiles with gaps filled by the mean of the others, 50 when there is none."""
    fill = F.coalesce(mean_of([f"pct_{f}" for f in families]), F.lit(50.0))
    return {f"radar_{f}": F.coalesce(F.col(f"pct_{f}"), fill) for f in families}
