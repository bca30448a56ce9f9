"""Periodic-investment simulation as set operations: no loop over quarters.

``by`` names the columns of independent scenarios. Picks are a handful of names per quarter, so
the position history of a scenario is bounded by picks x quarters.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscore.functions.columns import ratio
from pitscore.operators.asof import spine_literal
from pitscore.params import BENCHMARK, COST_BPS, DELIST_RETURN, QUARTERLY_INVESTMENT


def _spine(df: DataFrame, keys: Sequence[str], quarters: Sequence[date]) -> DataFrame:
    return df.select(*keys).distinct().select(*keys, F.posexplode(spine_literal(quarters)).alias("q", "quarter_end"))


def purchases(picks: DataFrame, grid: DataFrame, by: Sequence[str], cost_bps: float = COST_BPS) -> DataFrame:
    """Shares bought per pick. The slice is the quarterly amount over all picks; a pick without a
    price loses its slice."""
    per = W.partitionBy(*by, "quarter_end")
    amount = F.lit(QUARTERLY_INVESTMENT) / F.count(F.lit(1)).over(per)
    paid = F.col("price") * (1.0 + cost_bps / 10_000.0)
    return (
        picks.select(*by, "quarter_end", "ticker").withColumn("_amount", amount)
        .join(grid.select("ticker", "quarter_end", "price"), ["ticker", "quarter_end"], "left")
        .withColumn("shares", F.when(F.col("price") > 0, ratio("_amount", paid)))
        .withColumn("cost", F.when(F.col("price") > 0, F.col("_amount")))
        .drop("_amount", "price")
    )


def wealth_path(
    picks: DataFrame,
    grid: DataFrame,
    quarters: Sequence[date],
    delisted: DataFrame,
    by: Sequence[str] = (),
    strategy: str = "buy_and_hold",
    delist_return: Column | float = DELIST_RETURN,
    cost_bps: float = COST_BPS,
) -> DataFrame:
    """Wealth at every quarter-end: ``by, q, quarter_end, wealth``.

    Positions accumulate from the first purchase on. With ``rebalance`` a position is sold at the
    first quarter its name is not picked, and the proceeds stay in cash: a run of consecutive
    picks is one spell. An unpriced delisted position counts at average cost less the penalty.
    """
    keys, last = list(by), len(quarters) - 1
    loss = F.lit(delist_return) if isinstance(delist_return, float) else delist_return
    position = F.array_position(spine_literal(quarters), F.col("quarter_end")).cast("int") - 1
    bought = purchases(picks, grid, keys, cost_bps).withColumn("q", position)
    name = W.partitionBy(*keys, "ticker").orderBy("q")
    if strategy == "rebalance":
        bought = bought.withColumn("spell", F.col("q") - F.row_number().over(name))
    else:
        bought = bought.withColumn("spell", F.lit(0))
    spell = W.partitionBy(*keys, "ticker", "spell").orderBy("q")
    upto = spell.rowsBetween(W.unboundedPreceding, 0)
    ends = F.col("q") if strategy == "rebalance" else F.lit(last)
    lots = bought.withColumns(
        {
            "shares": F.sum("shares").over(upto),
            "cost": F.sum("cost").over(upto),
            "_until": F.coalesce(F.lead("q").over(spell) - 1, ends),
            "_open": F.lead("q").over(spell).isNull(),
        }
    ).filter(F.col("shares").isNotNull())
    marks = grid.select("ticker", "q", "price")
    gone = delisted.select("ticker", F.lit(True).alias("_gone"))
    unit = F.coalesce(
        F.col("price"), F.when(F.col("_gone"), ratio("cost", "shares") * (1.0 + loss)), F.lit(0.0)
    )
    held = (
        lots.select(*keys, "ticker", "shares", "cost", F.explode(F.sequence("q", "_until")).alias("q"))
        .join(marks, ["ticker", "q"], "left").join(gone, "ticker", "left")
        .groupBy(*keys, "q").agg(F.sum(F.col("shares") * unit).alias("held"))
    )
    path = _spine(picks, keys, quarters).join(held, [*keys, "q"], "left")
    cash = F.lit(0.0)
    if strategy == "rebalance":
        sold = (
            lots.filter(F.col("_open") & (F.col("q") < last))
            .select(*keys, "ticker", "shares", "cost", (F.col("q") + 1).alias("q"))
            .join(marks, ["ticker", "q"], "left").join(gone, "ticker", "left")
            .groupBy(*keys, "q").agg(F.sum(F.col("shares") * unit * (1.0 - cost_bps / 10_000.0)).alias("sold"))
        )
        path = path.join(sold, [*keys, "q"], "left")
        through = W.partitionBy(*keys).orderBy("q").rowsBetween(W.unboundedPreceding, 0)
        cash = F.coalesce(F.sum("sold").over(through), F.lit(0.0))
    return path.select(*keys, "q", "quarter_end", (F.coalesce("held", F.lit(0.0)) + cash).alias("wealth"))


def summarize(path: DataFrame, picks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Result row per scenario. Growth uses days / 365.25; drawdown includes contributions, and
    quarters that start from zero wealth have no return."""
    keys = list(by)
    series = W.partitionBy(*keys).orderBy("q")
    moves = path.withColumn("_before", F.lag("wealth").over(series)).withColumn(
        "_r", F.when(F.col("_before") > 0, ratio("wealth", "_before"))
    )
    upto = series.rowsBetween(W.unboundedPreceding, 0)
    index = moves.withColumn("_w", F.product("_r").over(upto)).withColumn(
        "_dd", F.when(F.col("_r").isNotNull(), ratio("_w", F.max(F.when(F.col("_r").isNotNull(), F.col("_w"))).over(upto)) - 1.0)
    )
    totals = index.groupBy(*keys).agg(
        F.max_by("wealth", "q").alias("terminal_wealth"),
        F.coalesce(F.min("_dd"), F.lit(0.0)).alias("max_drawdown"),
        F.min("quarter_end").alias("period_start"),
        F.max("quarter_end").alias("period_end"),
    )
    spent = picks.groupBy(*keys).agg(F.countDistinct("quarter_end").alias("quarters_invested"))
    years = F.greatest(F.datediff("period_end", "period_start") / 365.25, F.lit(1e-6))
    multiple = ratio("terminal_wealth", "total_invested")
    joined = totals.join(spent, keys) if keys else totals.withColumn("_1", F.lit(1)).join(spent.withColumn("_1", F.lit(1)), "_1").drop("_1")
    return joined.withColumn("total_invested", F.col("quarters_invested") * QUARTERLY_INVESTMENT).withColumns(
        {
            "total_return": F.coalesce(multiple - 1.0, F.lit(0.0)),
            "cagr": F.coalesce(F.pow(multiple, 1.0 / years) - 1.0, F.lit(0.0)),
        }
    )


def holdings_log(picks: DataFrame, grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Names bought per quarter (a handful) and the amount invested."""
    bought = purchases(picks, grid, by)
    return bought.groupBy(*by, "quarter_end").agg(
        F.sort_array(F.collect_list(F.when(F.col("shares").isNotNull(), F.col("ticker")))).alias("bought"),
        F.lit(QUARTERLY_INVESTMENT).alias("invested"),
    )


def benchmark_picks(grid: DataFrame, benchmark: str = BENCHMARK) -> DataFrame:
    """The benchmark as the only pick of every quarter in which it has a price."""
    return grid.filter((F.col("ticker") == benchmark) & (F.col("price") > 0)).select("quarter_end", "ticker")


def compare(strategy: DataFrame, benchmark: DataFrame, label: Column, vs_market: bool, keys: Sequence[str] = ()) -> DataFrame:
    """Deltas and beat flags of result rows against those of a benchmark. Against the market the
    return on deployed capital decides, against another strategy terminal wealth."""
    cols = ("terminal_wealth", "total_return", "cagr")
    other = benchmark.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols])
    if keys:
        joined = strategy.join(other, list(keys))
    else:
        joined = strategy.withColumn("_1", F.lit(1)).join(other.withColumn("_1", F.lit(1)), "_1")
    delta = {c: F.col(c) - F.col(f"_b_{c}") for c in cols}
    roi, richer = delta["total_return"] > 0, F.col("terminal_wealth") > F.col("_b_terminal_wealth")
    return joined.select(
        *keys,
        label.alias("label"),
        delta["terminal_wealth"].alias("terminal_wealth_delta"),
        F.when(F.col("_b_terminal_wealth") > 0, ratio(delta["terminal_wealth"], "_b_terminal_wealth")).alias("terminal_wealth_delta_pct"),
        delta["total_return"].alias("total_return_delta"),
        delta["cagr"].alias("cagr_delta"),
        (roi if vs_market else richer).alias("beat_benchmark"),
        roi.alias("beat_on_roi"),
        richer.alias("beat_on_wealth"),
    )


def simulate(
    picks: DataFrame, grid: DataFrame, quarters: Sequence[date], delisted: DataFrame, by: Sequence[str] = (),
    strategy: str = "buy_and_hold", delist_return: Column | float = DELIST_RETURN, scenarios: DataFrame | None = None,
) -> DataFrame:
    """Simulate and summarise all scenarios; one of ``scenarios`` (columns ``by``) without picks has a row of zeros."""
    found = summarize(wealth_path(picks, grid, quarters, delisted, by, strategy, delist_return), picks, by)
    if scenarios is None:
        return found
    rows = scenarios.select(*by).distinct().join(found, list(by), "left")
    return rows.withColumns(
        {"period_start": F.coalesce("period_start", F.lit(quarters[0])), "period_end": F.coalesce("period_end", F.lit(quarters[-1]))}
    ).fillna(0, [c for c in found.columns if c not in (*by, "period_start", "period_end")])


def fold_excess(
    picks: DataFrame,
    grid: DataFrame,
    folds: Sequence[tuple[Sequence[date], date]],
    delisted: DataFrame,
    by: Sequence[str] = (),
    delist_return: float = DELIST_RETURN,
    cost_bps: float = COST_BPS,
    benchmark: str = BENCHMARK,
) -> DataFrame:
    """Return on invested capital within each fold less that of the benchmark: ``by, fold, excess``.

    The amount is split over priced picks only. Positions are marked at the fold's end; without a
    price there a delisted name keeps its cost less the penalty and any other is worth nothing.
    """
    keys, gross = list(by), 1.0 + cost_bps / 10_000.0
    entries = F.array(*[
        F.struct(F.lit(q).alias("quarter_end"), F.lit(i).alias("fold"), F.lit(end).alias("fold_end"))
        for i, (members, end) in enumerate(folds) for q in members
    ])
    placed = lambda df: df.withColumn(
        "_f", F.explode(F.filter(entries, lambda e: e["quarter_end"] == F.col("quarter_end")))
    ).withColumns({"fold": F.col("_f.fold"), "fold_end": F.col("_f.fold_end")}).drop("_f")
    priced = grid.filter(F.col("price") > 0).select("ticker", "quarter_end", "price")
    ends = priced.select("ticker", F.col("quarter_end").alias("fold_end"), F.col("price").alias("_end"))
    bought = placed(picks.select(*keys, "quarter_end", "ticker").join(priced, ["ticker", "quarter_end"]))
    share = F.lit(QUARTERLY_INVESTMENT) / F.count(F.lit(1)).over(W.partitionBy(*keys, "quarter_end", "fold"))
    gone = delisted.select("ticker", F.lit(True).alias("_gone"))
    value = F.coalesce(
        ratio("_cost", F.col("price") * gross) * F.col("_end"),
        F.when(F.col("_gone"), F.col("_cost") * (1.0 + delist_return)),
        F.lit(0.0),
    )
    campaign = (
        bought.withColumn("_cost", share)
        .join(ends, ["ticker", "fold_end"], "left").join(gone, "ticker", "left")
        .groupBy(*keys, "fold").agg((ratio(F.sum(value), F.sum("_cost")) - 1.0).alias("roi"))
    )
    market = (
        placed(priced.filter(F.col("ticker") == benchmark)).join(ends, ["ticker", "fold_end"])
        .groupBy("fold").agg((ratio(F.sum(ratio("_end", F.col("price") * gross)), F.count(F.lit(1))) - 1.0).alias("market_roi"))
    )
    return campaign.join(market, "fold").select(*keys, "fold", (F.col("roi") - F.col("market_roi")).alias("excess"))
