"""Portfolio backtest: holdings, monthly returns, rolling excess, drawdown, rank correlations.

``by`` names the columns of independent runs (candidate, window); all runs are computed together.
Monthly series are bounded by the calendar, so windows over one run's months stay small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscore.functions.columns import has_number, ratio
from pitscore.functions.distributed import rank_correlation
from pitscore.operators.candidates import score_groups, with_candidate_scores
from pitscore.operators.crosssections import by_size, rank_correlations, top_sums
from pitscore.operators.screens import top_fraction
from pitscore.params import BENCHMARK, DELIST_RETURN, HISTORICAL_FAMILIES, HORIZONS, ROLLING_MONTHS, TOP_FRACTION, Window
from pitscore.session import materialize


def month_after(quarter_end: Column, k: Column | int) -> Column:
    return F.last_day(F.add_months(quarter_end, k))


def holding_months(picks: DataFrame, months: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Month-ends in which each pick is held; where periods overlap the later quarter wins."""
    keys = list(by)
    won = (
        picks.select(*keys, "quarter_end").distinct()
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(months))))
        .groupBy(*keys, month_after(F.col("quarter_end"), F.col("k")).alias("month"))
        .agg(F.max("quarter_end").alias("quarter_end"))
    )
    return picks.select(*keys, "quarter_end", "ticker").join(won, [*keys, "quarter_end"])


def with_holding_returns(
    scored: DataFrame, monthly: DataFrame, delisted: DataFrame, months: int = 3, delist_return: float = DELIST_RETURN
) -> DataFrame:
    """Add ``held``: per month after the quarter-end the return the name contributes if picked.

    A delisted name without a return contributes ``delist_return`` in every such month. Joined
    once on (ticker, quarter_end), before rows are expanded by candidates, so that picks need no
    join of their own.
    """
    after = (
        monthly.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(months))))
        .withColumn("quarter_end", F.last_day(F.add_months("month", -F.col("k"))))
        .filter(F.month("quarter_end") % 3 == 0)
        .groupBy("ticker", "quarter_end")
        .agg(F.map_from_entries(F.collect_list(F.struct("k", "return"))).alias("_r"))
    )
    gone = delisted.select("ticker", F.lit(True).alias("_gone"))
    value = lambda k: F.try_element_at("_r", k)
    held = F.transform(
        F.sequence(F.lit(1), F.lit(months)),
        lambda k: F.struct(
            month_after(F.col("quarter_end"), k).alias("month"),
            F.coalesce(value(k), F.when(F.col("_gone"), delist_return)).alias("value"),
            value(k).isNotNull().alias("seen"),
        ),
    )
    return (
        scored.join(after, ["ticker", "quarter_end"], "left").join(gone, "ticker", "left")
        .withColumn("held", held).drop("_r", "_gone")
    )


def portfolio_sums(picks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums per (run, quarter, month), formed before any shuffle: ``by, quarter_end, month, total, names, seen``."""
    keys = list(by)
    return (
        picks.select(*keys, "quarter_end", F.explode("held").alias("h"))
        .groupBy(*keys, "quarter_end", F.col("h.month").alias("month"))
        .agg(F.sum("h.value").alias("total"), F.count("h.value").alias("names"), F.count_if("h.seen").alias("seen"))
    )


def candidate_sums(
    held: DataFrame, candidates: Mapping[str, Mapping[str, float]], names: Sequence[str] = HISTORICAL_FAMILIES, prefix: str = "pct_", months: int = 3
) -> DataFrame:
    """``portfolio_sums`` of each quarter's best fifth under many weight sets (column ``candidate``)."""
    whole, large = by_size(held, ["quarter_end"])
    sums = top_sums(whole, candidates, names, prefix, months, TOP_FRACTION)
    out = sums.select("candidate", "quarter_end", month_after(F.col("quarter_end"), F.col("k")).alias("month"), "total", "names", "seen")
    if large is None:
        return out
    expanded = with_candidate_scores(large, candidates, names, prefix).select("candidate", "quarter_end", "ticker", "composite", "held")
    return out.unionByName(portfolio_sums(top_fraction(expanded, ["candidate", "quarter_end"]), ["candidate"]))


def portfolio_returns(picks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Equal-weight return per month: ``by, month, port``. Months in which no held name has a
    return are left out."""
    return _monthly(portfolio_sums(picks, by), by)


def _monthly(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = list(by)
    last = sums.groupBy(*keys, "month").agg(F.max_by(F.struct("total", "names", "seen"), "quarter_end").alias("s"))
    return last.filter(F.col("s.seen") > 0).select(*keys, "month", ratio("s.total", "s.names").alias("port"))


def benchmark_returns(monthly: DataFrame, benchmark: str = BENCHMARK) -> DataFrame:
    return monthly.filter(F.col("ticker") == benchmark).select("month", F.col("return").alias("bench"))


def window_list(windows: Sequence[Window], months: int = 3) -> Column:
    """Literal array of windows with the first and last benchmark month of each."""
    one = lambda w: F.struct(
        F.lit(w.name).alias("window"), F.lit(w.start).alias("start"), F.lit(w.end).alias("end"),
        F.last_day(F.lit(w.start)).alias("first_month"),
        F.last_day(F.add_months(F.lit(w.end), months)).alias("last_month"),
    )
    return F.array(*[one(w) for w in windows])


def in_windows(df: DataFrame, windows: Sequence[Window]) -> DataFrame:
    """Rows once per window that contains their ``quarter_end``, with a ``window`` column."""
    fits = F.filter(window_list(windows), lambda w: F.col("quarter_end").between(w["start"], w["end"]))
    return df.withColumn("window", F.explode(F.transform(fits, lambda w: w["window"])))


def benchmark_in_windows(bench: DataFrame, windows: Sequence[Window], months: int = 3) -> DataFrame:
    fits = F.filter(window_list(windows, months), lambda w: F.col("month").between(w["first_month"], w["last_month"]))
    return bench.withColumn("window", F.explode(F.transform(fits, lambda w: w["window"])))


def rolling_excess(aligned: DataFrame, by: Sequence[str] = (), months: int = ROLLING_MONTHS) -> DataFrame:
    """Compounded excess over the trailing ``months`` for every month that has a full window.
    ``aligned``: ``by, month, port, bench`` for months both series have."""
    w = W.partitionBy(*by).orderBy("month").rowsBetween(-(months - 1), 0)
    growth = lambda c: F.product(F.col(c) + 1.0).over(w)
    full = F.count(F.lit(1)).over(w) == months
    return (
        aligned.withColumns({"_full": full, "excess": growth("port") - growth("bench")})
        .filter("_full").select(*by, "month", "excess")
    )


def win_rate(excess: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return excess.groupBy(*by).agg(
        F.avg((F.col("excess") > 0).cast("double")).alias("rolling_win_rate"),
        F.percentile("excess", F.lit(0.5)).alias("median_excess"),
    )


def cagr(c: str) -> Column:
    """Annualised growth of a monthly return series (aggregate)."""
    n = F.count(c)
    return F.when(n > 0, F.pow(F.product(F.col(c) + 1.0), F.lit(12.0) / n) - 1.0).otherwise(0.0)


def drawdown(returns: DataFrame, by: Sequence[str] = (), column: str = "port") -> DataFrame:
    """Largest loss of compounded wealth from its running peak (the first month is the first peak)."""
    upto = W.partitionBy(*by).orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    wealth = returns.withColumn("_w", F.product(F.col(column) + 1.0).over(upto))
    return (
        wealth.withColumn("_dd", ratio("_w", F.max("_w").over(upto)) - 1.0)
        .groupBy(*by).agg(F.min("_dd").alias("max_drawdown"))
    )


def quarterly_ics(
    scored: DataFrame, forward: DataFrame, score: str = "composite", by: Sequence[str] = (),
    horizons: Sequence[str] = tuple(HORIZONS),
) -> DataFrame:
    """Rank correlation of a score with forward horizons per quarter: ``by, horizon, quarter_end, ic``."""
    rows = scored.filter(F.col(score).isNotNull()).select(*by, "quarter_end", "ticker", score)
    joined = rows.join(_long_forward(forward, horizons), ["quarter_end", "ticker"])
    return rank_correlation(joined, [*by, "horizon", "quarter_end"], score, "fwd").drop("n")


def _long_forward(forward: DataFrame, horizons: Sequence[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("fwd")) for h in horizons])
    rows = forward.select(F.col("as_of_quarter").alias("quarter_end"), "ticker", F.explode(each).alias("f"))
    return rows.select("quarter_end", "ticker", "f.horizon", "f.fwd").filter(F.col("fwd").isNotNull())


def candidate_ics(
    base: DataFrame, forward: DataFrame, candidates: Mapping[str, Mapping[str, float]], names: Sequence[str] = HISTORICAL_FAMILIES,
    prefix: str = "pct_", horizons: Sequence[str] = tuple(HORIZONS),
) -> DataFrame:
    """Rank correlations of the scores of many weight sets: ``candidate, horizon, quarter_end, ic``.

    A task ranks a quarter's returns once and then the scores of a block of weight sets. In quarters that are too large for
    a task, rows are expanded by the weight sets just before they are ordered.
    """
    found, returns, keys = [], _long_forward(forward, horizons), ["horizon", "quarter_end"]
    for members, expand, valid in score_groups(candidates, names, prefix):
        rows = base.filter(valid).join(returns, ["quarter_end", "ticker"]).filter(has_number("fwd"))
        whole, large = by_size(rows, keys)
        found.append(rank_correlations(whole, keys, {c: candidates[c] for c in members}, names, prefix, "fwd").select("candidate", *keys, "ic"))
        if large is not None:
            ics = rank_correlation(large, keys, expand, "fwd", valid=valid)
            found.append(ics.select(F.get(F.array(*[F.lit(c) for c in members]), F.col("pos")).alias("candidate"), *keys, "ic"))
    return reduce(DataFrame.unionByName, found)


def mean_horizon_ics(ics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean correlation per horizon, 0 where no quarter has one: ``by, ic_<h>..``"""
    return ics.groupBy(*by).agg(
        *[F.coalesce(F.avg(F.when(F.col("horizon") == h, F.col("ic"))), F.lit(0.0)).alias(f"ic_{h}") for h in HORIZONS]
    )


def next_quarter_ic(ics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean correlation with the next quarter's return inside each run's quarters, whose last one
    has no next quarter: ``by, mean_ic``. ``ics`` holds every quarter of the run."""
    keys = list(by)
    last = F.max("quarter_end").over(W.partitionBy(*keys))
    usable = (F.col("horizon") == "1q") & (F.col("quarter_end") < F.col("_last"))
    return ics.withColumn("_last", last).groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(usable, F.col("ic"))), F.lit(0.0)).alias("mean_ic")
    )


def run_backtest(
    scored: DataFrame,
    monthly: DataFrame,
    forward: DataFrame | None,
    delisted: DataFrame,
    windows: Sequence[Window],
    by: Sequence[str] = (),
    months: int = 3,
    delist_return: float = DELIST_RETURN,
    horizons: Sequence[str] = tuple(HORIZONS),
    rolling_months: int = ROLLING_MONTHS,
    ics: DataFrame | None = None,
    sums: DataFrame | None = None,
) -> DataFrame:
    """Quarterly top-quintile backtest, one row per run and window. ``forward=None`` skips the
    rank correlations unless ``ics`` has them; ``horizons`` (with ``1q``) narrows them. A correlation that was not
    computed is NULL. With ``sums`` (``portfolio_sums`` of the picks) ``scored`` needs the runs and their quarters only."""
    keys = [*by, "window"]
    if sums is None:
        held = scored if "held" in scored.columns else with_holding_returns(scored, monthly, delisted, months, delist_return)
        sums = portfolio_sums(top_fraction(held, [*by, "quarter_end"]), by)
    # One small row per run, window and month from here on.
    port = materialize(_monthly(in_windows(sums, windows), keys))
    bench = materialize(benchmark_in_windows(benchmark_returns(monthly), windows, months))
    runs = scored.select(*by).distinct() if by else scored.sparkSession.range(1).select()
    out = runs.withColumn("window", F.explode(F.array(*[F.lit(w.name) for w in windows])))
    excess = rolling_excess(port.join(bench, ["month", "window"]), keys, rolling_months)
    out = (
        out.join(win_rate(excess, keys), keys, "left")
        .join(port.groupBy(*keys).agg(cagr("port").alias("cagr")), keys, "left")
        .join(bench.groupBy("window").agg(cagr("bench").alias("benchmark_cagr")), "window", "left")
        .join(drawdown(port, keys), keys, "left")
    )
    zero = ["rolling_win_rate", "median_excess", "cagr", "benchmark_cagr", "max_drawdown"]
    if forward is None and ics is None:
        missing = F.lit(None).cast("double")
        return out.fillna(0.0, zero).withColumns({"mean_ic": F.lit(0.0), **{f"ic_{h}": missing for h in HORIZONS}})
    ics = in_windows(materialize(quarterly_ics(scored, forward, by=by, horizons=horizons) if ics is None else ics), windows)
    last_scored = in_windows(scored.select(*by, "quarter_end").distinct(), windows)
    ics = last_scored.join(ics, [*keys, "quarter_end"], "left")
    out = out.join(next_quarter_ic(ics, keys), keys, "left").join(mean_horizon_ics(ics, keys), keys, "left")
    out = out.fillna(0.0, [*zero, "mean_ic"])
    measured = {f"ic_{h}": F.coalesce(f"ic_{h}", F.lit(0.0)) if h in horizons else F.lit(None).cast("double") for h in HORIZONS}
    return out.withColumns(measured)
