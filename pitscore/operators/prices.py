"""Price analytics per ticker and as-of date.

A ticker's closes are cut into blocks of 64 rows (one shuffle on ticker). A quarter-end reads the blocks of its
look-back only: no row holds a whole history, and nothing is multiplied by quarters x look-back rows in a shuffle.
The look-backs of many rows are evaluated together, as matrices of closes.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitscore.functions.columns import clamp, has_number, ratio
from pitscore.params import LOOKBACK_ROWS, YEAR_ROWS

RSI_PERIOD = 14
# What a Wilder average keeps of its last value.
_KEEP = 1.0 - 1.0 / RSI_PERIOD
BLOCK_ROWS = 64
# Blocks that the look-back can touch, the last one included.
BLOCK_REACH = -(-LOOKBACK_ROWS // BLOCK_ROWS) + 1
#: Look-backs in one matrix.
MATRIX_ROWS = 1024


def price_blocks(prices: DataFrame) -> DataFrame:
    """Closes per ticker in blocks of ``BLOCK_ROWS``: ``ticker, since, until, blocks``.

    Input has one row per day. ``since`` is the block's first date, ``until`` that of the next block.
    ``blocks`` holds the last ``BLOCK_REACH`` blocks up to this one, oldest first. All steps share the shuffle
    on ticker.
    """
    by_date = W.partitionBy("ticker").orderBy("trade_date")
    rows = prices.filter(has_number("close")).select(
        "ticker", "trade_date", "close", F.floor((F.row_number().over(by_date) - 1) / BLOCK_ROWS).alias("_block")
    )
    blocks = rows.groupBy("ticker", "_block").agg(
        F.min("trade_date").alias("since"), F.sort_array(F.collect_list(F.struct("trade_date", "close"))).alias("bars")
    )
    in_order = W.partitionBy("ticker").orderBy("_block")
    return blocks.select(
        "ticker", "since", F.lead("since").over(in_order).alias("until"),
        F.collect_list(F.struct("bars")).over(in_order.rowsBetween(1 - BLOCK_REACH, 0)).alias("blocks"),
    )


def _part(xs: Column, start: Column, end: Column) -> Column:
    """Elements ``start`` to ``end - 1``, counted from 0."""
    return F.slice(xs, F.greatest(start, F.lit(0)) + 1, F.greatest(end - start, F.lit(0)))


def _pairs(xs: Column, f) -> Column:
    """f(previous, current) over neighbouring elements."""
    n = F.greatest(F.size(xs) - 1, F.lit(0))
    return F.zip_with(F.slice(xs, 1, n), F.slice(xs, 2, n), f)


def _no_drawdown() -> Column:
    return F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))


def _fallen(dd: Column, low: Column, peak: Column) -> Column:
    return F.least(dd, F.coalesce(ratio(low, peak) - 1.0, F.lit(0.0)))


def _drawdown(start: Column, closes: Column) -> Column:
    """Peak and drawdown after further closes."""

    def step(acc: Column, x: Column) -> Column:
        peak = F.greatest(acc["peak"], x)
        return F.struct(peak.alias("peak"), _fallen(acc["dd"], x, peak).alias("dd"))

    return F.aggregate(closes, start, step)


def max_drawdown(closes: Column) -> Column:
    return _drawdown(_no_drawdown(), closes)["dd"]


def momentum(closes: Column) -> Column:
    """Return from 252 closes back to 22 closes back."""
    end, start = F.try_element_at(closes, F.lit(-22)), F.try_element_at(closes, F.lit(-YEAR_ROWS))
    return F.when((F.size(closes) >= YEAR_ROWS) & (start > 0), ratio(end, start) - 1.0)


def _smoothed(start: Column, closes: Column) -> Column:
    """Wilder averages of gains and losses after the changes between further closes."""

    def step(acc: Column, change: Column) -> Column:
        up, down = F.greatest(change, F.lit(0.0)), F.greatest(-change, F.lit(0.0))
        return F.struct(
            (acc["gain"] * _KEEP + up * (1.0 - _KEEP)).alias("gain"), (acc["loss"] * _KEEP + down * (1.0 - _KEEP)).alias("loss")
        )

    return F.aggregate(_pairs(closes, lambda a, b: b - a), start, step)


def _seed(xs: Column, at: Column) -> Column:
    """Wilder averages that start with the change after position ``at``."""
    first = F.get(xs, at + 1) - F.get(xs, at)
    return F.struct(F.greatest(first, F.lit(0.0)).alias("gain"), F.greatest(-first, F.lit(0.0)).alias("loss"))


def _relative_strength(averages: Column) -> Column:
    gain, loss = averages["gain"], averages["loss"]
    return F.when(loss == 0, F.when(gain > 0, 100.0).otherwise(50.0)).otherwise(100.0 - 100.0 / (ratio(gain, loss) + 1.0))


def wilder_rsi(closes: Column) -> Column:
    """Wilder RSI, averages seeded with the first change of the slice."""
    averages = _smoothed(_seed(closes, F.lit(0)), _part(closes, F.lit(1), F.size(closes)))
    return F.when(F.size(closes) >= RSI_PERIOD + 1, _relative_strength(averages))


PRICE_METRICS = (
    "price", "momentum_12_1", "volatility_12m", "max_drawdown", "downside_deviation", "rsi_14",
    "fifty_two_week_high", "fifty_two_week_low", "all_time_high",
)


def _yearly_std(x: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Yearly sample deviation of the used values of each row, NaN for fewer than two."""
    n = used.sum(axis=1)
    mean = np.where(used, x, 0.0).sum(axis=1) / n
    return np.sqrt(np.where(used, (x - mean[:, None]) ** 2, 0.0).sum(axis=1) / (n - 1)) * YEAR_ROWS**0.5


def _matrix_metrics(trail: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """``PRICE_METRICS`` of look-backs whose last ``n`` columns are closes. Returns from a close of zero are left out."""
    rows, width = trail.shape
    held = np.arange(width) >= width - n[:, None]
    year, in_year = trail[:, -YEAR_ROWS:], held[:, -YEAR_ROWS:]
    none = lambda x, missing: pa.array(x, pa.float64(), mask=missing)

    start = year[:, 0]
    short = n < 60
    change = year[:, 1:] / year[:, :-1] - 1.0
    used = in_year[:, :-1] & (year[:, :-1] != 0)
    falls = used & (change < 0)
    n_falls = falls.sum(axis=1)
    peak = np.maximum.accumulate(np.where(in_year, year, 0.0), axis=1)
    fallen = np.fmin.reduce(np.where(in_year & (peak != 0), year / peak - 1.0, 0.0), axis=1, initial=0.0)

    # Wilder averages: the first change of the look-back is their first value.
    moves, moved = np.diff(trail, axis=1), held[:, :-1]
    age = np.arange(width - 1)[::-1]
    weight = np.where(age == n[:, None] - 2, 1.0, 1.0 - _KEEP) * _KEEP**age
    gain = np.where(moved, np.maximum(moves, 0.0) * weight, 0.0).sum(axis=1)
    loss = np.where(moved, np.maximum(-moves, 0.0) * weight, 0.0).sum(axis=1)
    strength = np.where(loss == 0, np.where(gain > 0, 100.0, 50.0), 100.0 - 100.0 / (gain / loss + 1.0))

    high = np.where(in_year, year, -np.inf).max(axis=1)
    found = {
        "price": none(trail[:, -1], n < 1),
        "momentum_12_1": none(year[:, -22] / start - 1.0, (n < YEAR_ROWS) | ~(start > 0)),
        "volatility_12m": none(_yearly_std(change, used), short | (used.sum(axis=1) < 2)),
        "max_drawdown": none(fallen, short),
        "downside_deviation": none(np.where(n_falls == 0, 0.0, _yearly_std(change, falls)), short | (n_falls == 1)),
        "rsi_14": none(strength, n < RSI_PERIOD + 1),
        "fifty_two_week_high": none(high, n < 1),
        "fifty_two_week_low": none(np.where(in_year, year, np.inf).min(axis=1), n < 1),
        "all_time_high": none(np.where(held, trail, -np.inf).max(axis=1), n < 1),
    }
    return [found[name] for name in PRICE_METRICS]


@F.arrow_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in PRICE_METRICS]))
def _metrics_of(closes: pa.Array, seen: pa.Array) -> pa.Array:
    """The metrics of each row's first ``seen`` closes."""
    flat, first = closes.flatten().to_numpy(zero_copy_only=False), closes.offsets.to_numpy().astype(np.int64)
    end = first[:-1] - first[0] + seen.to_numpy(zero_copy_only=False)
    n = np.minimum(end - (first[:-1] - first[0]), LOOKBACK_ROWS)
    flat = np.append(flat, 0.0)
    parts = []
    with np.errstate(all="ignore"):
        for a in range(0, len(end), MATRIX_ROWS):
            at = end[a : a + MATRIX_ROWS, None] - np.arange(LOOKBACK_ROWS, 0, -1)
            here = n[a : a + MATRIX_ROWS]
            parts.append(_matrix_metrics(flat[np.where(at >= 0, at, -1)], here))
    columns = [pa.concat_arrays(c) for c in zip(*parts)] if parts else [pa.array([], pa.float64())] * len(PRICE_METRICS)
    return pa.StructArray.from_arrays(columns, PRICE_METRICS)


def block_metrics(df: DataFrame) -> DataFrame:
    """Replace ``blocks`` by the price metrics as of ``quarter_end``."""
    blocks = F.col("blocks")
    last = F.element_at(blocks, -1)["bars"]
    seen = (F.size(blocks) - 1) * BLOCK_ROWS + F.size(F.filter(last["trade_date"], lambda d: d <= F.col("quarter_end")))
    kept = [c for c in df.columns if c != "blocks"]
    metrics = df.select(*kept, _metrics_of(F.flatten(blocks["bars"])["close"], seen).alias("_m"))
    return metrics.select(*kept, *[F.col("_m")[name].alias(name) for name in PRICE_METRICS])


def with_price_blocks(keys: DataFrame, prices: DataFrame) -> DataFrame:
    """Keys (ticker, quarter_end, further columns) that have a price by then, with the ``blocks`` up to that date.

    A ticker's dates travel as one array (bounded by the calendar) to its blocks, each of which keeps its own.
    """
    rest = [c for c in keys.columns if c != "ticker"]
    asked = keys.groupBy("ticker").agg(F.collect_list(F.struct(*rest)).alias("_asked"))
    until = F.coalesce("until", F.lit("9999-12-31").cast("date"))
    here = F.filter("_asked", lambda k: (k["quarter_end"] >= F.col("since")) & (k["quarter_end"] < until))
    found = price_blocks(prices).join(asked, "ticker").select("ticker", "blocks", F.explode(here).alias("_key"))
    return found.select("ticker", *[F.col("_key")[c].alias(c) for c in rest], "blocks")


def price_metrics(keys: DataFrame, prices: DataFrame) -> DataFrame:
    """Price metrics at each (ticker, quarter_end) key that has a price by then."""
    return block_metrics(with_price_blocks(keys, prices))


def all_time_highs(prices: DataFrame) -> DataFrame:
    """Highest close of the whole history, per ticker."""
    close = F.when(has_number("close"), F.col("close"))
    return prices.groupBy("ticker").agg(F.max(close).alias("all_time_high"))


def moving_average(prices: DataFrame, rows: int = 20) -> DataFrame:
    """Simple moving average of the close; NULL until ``rows`` closes exist."""
    w = W.partitionBy("ticker").orderBy("trade_date").rowsBetween(-(rows - 1), 0)
    close = F.when(has_number("close"), F.col("close"))
    return prices.withColumn("sma", F.when(F.count(close).over(w) == rows, F.avg(close).over(w)))


# Chart ranges as months back from the last date.
RANGES = {"1M": 1, "3M": 3, "6M": 6, "1Y": 12, "2Y": 24, "5Y": 60}


def price_range(prices: DataFrame, name: str) -> DataFrame:
    """Rows of a chart range (1M 3M 6M YTD 1Y 2Y 5Y All) counted back from each ticker's last date."""
    if name == "All":
        return prices
    last = prices.groupBy("ticker").agg(F.max("trade_date").alias("_last"))
    since = F.trunc("_last", "year") if name == "YTD" else F.add_months("_last", -RANGES[name])
    return prices.join(last, "ticker").filter(F.col("trade_date") >= since).drop("_last")


def range_summary(prices: DataFrame) -> DataFrame:
    """Rows, first date and extremes of every chart range per ticker, in one pass over the rows."""
    last = prices.groupBy("ticker").agg(F.max("trade_date").alias("_last"))
    since = {name: F.add_months("_last", -months) for name, months in RANGES.items()} | {"YTD": F.trunc("_last", "year").cast("date")}
    names = F.array_compact(F.array(*[F.when(F.col("trade_date") >= s, F.lit(n)) for n, s in since.items()], F.lit("All")))
    rows = prices.join(last, "ticker").select("ticker", "trade_date", "close", F.explode(names).alias("price_range"))
    return rows.groupBy("ticker", "price_range").agg(
        F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first_date"), F.min("close").alias("low"), F.max("close").alias("high")
    )


def pct_below(price: Column, high: Column) -> Column:
    """Share below a high, floored at 0."""
    return F.when((high > 0) & (price > 0), F.greatest(F.lit(0.0), 1.0 - ratio(price, high)))


def range_position(price: Column, low: Column, high: Column) -> Column:
    """Position in the 52-week range, 0 = low, 1 = high."""
    return F.when(high > low, clamp(ratio(price - low, high - low), 0.0, 1.0))


def history_percentile(current: Column, history: Column, min_items: int = 4) -> Column:
    """Share of a history at or below the current value, in percent; needs four observations."""
    n = F.size(history)
    below = F.size(F.filter(history, lambda h: h <= current))
    return F.when(current.isNotNull() & (n >= min_items), below / n.cast("double") * 100.0)


def earnings_yield_history(
    statements: DataFrame, prices: DataFrame, years: int = 5
) -> DataFrame:
    """EBIT / enterprise value per statement period, newest ``max(4, 4 * years)`` periods per ticker.

    ``statements``: wide rows ``ticker, period, ebit, shares, total_debt, total_cash``. A period
    without EBIT, with shares, price or enterprise value not above zero, is left out.
    """
    from pitscore.operators.asof import asof_join

    periods = max(4, 4 * years)
    newest = W.partitionBy("ticker").orderBy(F.desc("period"))
    kept = statements.withColumn("_i", F.row_number().over(newest)).filter(F.col("_i") <= periods).drop("_i")
    priced = asof_join(kept, prices, ["ticker"], "period", "trade_date", ["close"])
    ev = F.col("close") * F.col("shares") + F.coalesce("total_debt", F.lit(0.0)) - F.coalesce("total_cash", F.lit(0.0))
    return (
        priced.withColumn("enterprise_value", ev)
        .filter((F.col("shares") > 0) & (F.col("close") > 0) & (F.col("enterprise_value") > 0) & F.col("ebit").isNotNull())
        .select("ticker", "period", ratio("ebit", "enterprise_value").alias("earnings_yield"))
    )


# Statement names of the yield history, by priority.
YIELD_INCOME = {"ebit": ["EBIT", "Operating Income"]}
YIELD_BALANCE = {
    "shares": ["Ordinary Shares Number", "Share Issued", "Common Stock Shares Outstanding"],
    "total_debt": ["Total Debt", "Long Term Debt And Capital Lease Obligation", "Long Term Debt"],
    "total_cash": ["Cash And Cash Equivalents", "Cash Cash Equivalents And Short Term Investments", "Cash"],
}


def statement_yields(income: DataFrame, balance: DataFrame, prices: DataFrame, years: int = 5) -> DataFrame:
    """``earnings_yield_history`` from long quarterly statements ``ticker, metric, period, value``.

    The periods are those of the income statement; every field has its own list of names, and balance
    cells count at the same period only.
    """
    from pitscore.operators.ingest import values_by_period

    periods = income.filter(F.col("period").isNotNull()).select("ticker", "period").distinct()
    keys = ["ticker", "period"]
    rows = periods.join(values_by_period(income, YIELD_INCOME), keys, "left").join(values_by_period(balance, YIELD_BALANCE), keys, "left")
    return earnings_yield_history(rows, prices, years)


def valuation_vs_own_history(current: DataFrame, history: DataFrame) -> DataFrame:
    """Percentile of ``earnings_yield_current`` in the ticker's own history (at most ~20 values);
    a stored ``valuation_vs_history`` is kept."""
    past = history.groupBy("ticker").agg(F.collect_list("earnings_yield").alias("_h"))
    own = history_percentile(F.col("earnings_yield_current"), F.coalesce("_h", F.array().cast("array<double>")))
    if "valuation_vs_history" in current.columns:
        own = F.coalesce("valuation_vs_history", own)
    return current.join(past, "ticker", "left").withColumn("valuation_vs_history", own).drop("_h")
