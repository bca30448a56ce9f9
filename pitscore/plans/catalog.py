"""Registered queries: every operator over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscore import params
from pitscore.functions.columns import to_double
from pitscore.functions.distributed import positions, quantiles
from pitscore.operators import (
    analysts, asof, backtest, bargain, candidates, dca, factors, ingest, live, overlay, prices, returns,
    scoring, screens, validation,
)
from pitscore.plans.panel import SIGNALS
from pitscore.plans.pipeline import WEIGHTS, Pipeline
from pitscore.sources import samples
from pitscore.sources.schemas import FIELDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Gate for the given data, whose scores spread less than real ones.
GATE = params.Thresholds(composite_min=45.0, bargain_min=40.0)
LIVE_GATE = params.Thresholds(composite_min=45.0, bargain_min=20.0)
def _search(samples: int) -> dict[str, dict[str, float]]:
    draws = params.dirichlet_weights(samples, 42, params.HISTORICAL_FAMILIES)
    return {**draws, "baseline": params.historical_weights(params.EVIDENCE_WEIGHTS)}


# Trailing months of the search objective: the windows of the given tables are shorter than the production ones.
SEARCH_MONTHS = 12


def _output(c: Column) -> Column:
    """Six decimals, three from a million on and ten significant digits from 1e10 on (half to even)."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - 9)
    return (
        F.when(F.abs(c) >= 1e10, F.rint(c / scale) * scale)
        .when(F.abs(c) >= 1e6, F.rint(c * 1e3) / 1e3)
        .otherwise(F.rint(c * 1e6) / 1e6)
    )


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded for output (sums of doubles differ in the last bits between layouts),
    integers widened."""
    kinds = {"double": _output, "int": lambda c: c.cast("long")}
    return df.select(*[kinds[t](F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def query(f: Callable[[Pipeline], DataFrame]) -> Callable[[Pipeline], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(Pipeline(spark, sf_dir)))
    return f


def long_format(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


# Point-in-time inputs ------------------------------------------------------------------------


@query
def monthly_returns(p: Pipeline) -> DataFrame:
    return returns.monthly_returns(p.view("prices")).withColumnRenamed("return", "ret")


@query
def quarter_end_prices(p: Pipeline) -> DataFrame:
    return asof.prices_at_quarters(p.view("prices"), p.calendar).select("ticker", "quarter_end", "price")


@query
def asof_statement_prices(p: Pipeline) -> DataFrame:
    """Last close on or before the filing date of each entry."""
    left = p.view("fundamentals").select("ticker", "field", "filed", "period")
    return asof.asof_join(left, p.view("prices"), ["ticker"], "filed", "trade_date", ["close"])


@query
def asof_fresh_prices(p: Pipeline) -> DataFrame:
    """The same with a staleness limit of ten days."""
    left = p.view("fundamentals").select("ticker", "field", "filed", "period")
    return asof.asof_join(left, p.view("prices"), ["ticker"], "filed", "trade_date", ["close"], max_staleness_days=10)


@query
def forward_returns(p: Pipeline) -> DataFrame:
    return returns.forward_returns(p.panel, p.prices, p.quarters)


@query
def next_quarter_returns(p: Pipeline) -> DataFrame:
    return returns.next_quarter_returns(p.forward, p.quarters)


@query
def pit_fundamentals(p: Pipeline) -> DataFrame:
    fields = tuple(f for f in FIELDS if not f.startswith("total_debt"))
    out = ingest.pit_fundamentals(p.members.select("quarter_end", "ticker"), p.view("fundamentals"), fields)
    return out.select("quarter_end", "ticker", *fields, *[f"{f}_prior" for f in fields], "book_value", "total_debt")


@query
def normalize_filings(p: Pipeline) -> DataFrame:
    return ingest.normalize_filings(p.view("sub"), p.view("num"), p.view("cik_map"))


@query
def normalize_filings_quarterly(p: Pipeline) -> DataFrame:
    return ingest.normalize_filings(p.view("sub"), p.view("num"), p.view("cik_map"), prefer_quarterly=True)


@query
def filing_sets(p: Pipeline) -> DataFrame:
    """Filings and values in one data set per filing quarter."""
    label = F.concat(F.year("filed"), F.lit("q"), F.quarter("filed"))
    sub = p.view("sub").withColumn("dataset_quarter", label)
    num = p.view("num").join(sub.select("adsh", "dataset_quarter"), "adsh")
    return ingest.normalize_filing_sets(sub, num, p.view("cik_map"))


@query
def membership_panel(p: Pipeline) -> DataFrame:
    return ingest.membership_panel(p.view("membership_history"), p.calendar)


@query
def members_as_of(p: Pipeline) -> DataFrame:
    return ingest.members_as_of(p.members, samples.END)


@query
def delisted_catalog(p: Pipeline) -> DataFrame:
    return ingest.delisted_catalog(p.members, p.view("prices"))


@query
def benchmark_check(p: Pipeline) -> DataFrame:
    """Prices without the benchmark, completed from the full price table; rows per ticker."""
    full = p.view("prices")
    out = ingest.with_benchmark(full.filter(F.col("ticker") != params.BENCHMARK), full)
    return out.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("trade_date").alias("last_date"))


@query
def daily_closes(p: Pipeline) -> DataFrame:
    """One close per (ticker, day) straight from the line items as raw quotes."""
    raw = p.spark.read.parquet(f"{p.sf_dir}/lineitem.parquet").select(
        F.concat(F.lit(" s"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.col("l_shipdate").cast("date").alias("trade_date"),
        F.col("l_extendedprice").alias("close"),
    )
    return ingest.daily_closes(raw)


@query
def usable_quotes(p: Pipeline) -> DataFrame:
    return ingest.usable_quotes(p.view("quotes")).select("ticker", "long_name", "current_price", "regular_market_price")


@query
def statement_latest_prior(p: Pipeline) -> DataFrame:
    return ingest.statement_values(p.view("statements"), factors.STATEMENT_NAMES)


@query
def statement_warnings(p: Pipeline) -> DataFrame:
    values = ingest.statement_values(p.view("statements"), factors.STATEMENT_NAMES)
    return ingest.data_warnings(values).withColumn("data_warnings", F.array_join("data_warnings", "|"))


# Price analytics ----------------------------------------------------------------------------


def _metrics(p: Pipeline, *columns: str) -> DataFrame:
    keys = p.members.select("quarter_end", "ticker")
    return prices.price_metrics(keys, p.view("prices")).select("quarter_end", "ticker", *columns)


@query
def price_momentum(p: Pipeline) -> DataFrame:
    return _metrics(p, "price", "momentum_12_1")


@query
def price_volatility(p: Pipeline) -> DataFrame:
    return _metrics(p, "volatility_12m")


@query
def price_drawdown(p: Pipeline) -> DataFrame:
    return _metrics(p, "max_drawdown", "downside_deviation")


@query
def price_rsi(p: Pipeline) -> DataFrame:
    return _metrics(p, "rsi_14")


@query
def price_52w(p: Pipeline) -> DataFrame:
    m = _metrics(p, "price", "fifty_two_week_high", "fifty_two_week_low", "all_time_high")
    price, high, low = F.col("price"), F.col("fifty_two_week_high"), F.col("fifty_two_week_low")
    return m.withColumns(
        {
            "below_52w_high": prices.pct_below(price, high),
            "below_ath": prices.pct_below(price, F.col("all_time_high")),
            "range_position": prices.range_position(price, low, high),
        }
    )


@query
def all_time_highs(p: Pipeline) -> DataFrame:
    return prices.all_time_highs(p.view("prices"))


@query
def moving_average(p: Pipeline) -> DataFrame:
    return prices.moving_average(p.view("prices"))


@query
def price_range_slice(p: Pipeline) -> DataFrame:
    """Rows, first date and extremes of every chart range per ticker."""
    return prices.range_summary(p.prices)


def _statement_rows(p: Pipeline) -> DataFrame:
    """Wide statement rows with the latest filed value of each field."""
    names = {"ebit": "ebit", "shares_outstanding": "shares", "long_term_debt": "total_debt", "total_cash": "total_cash"}
    # One entry per period in the map-side aggregate, whatever the number of fields.
    filed = lambda field: F.when(F.col("field") == field, F.col("filed"))
    return p.fundamentals.groupBy("ticker", "period").agg(*[F.max_by("amount", filed(f)).alias(name) for f, name in names.items()])


@query
def earnings_yield_history(p: Pipeline) -> DataFrame:
    return prices.earnings_yield_history(_statement_rows(p), p.prices)


@query
def statement_yields(p: Pipeline) -> DataFrame:
    """Yield history of long quarterly statements; share and cash cells under several names are made from the assets."""
    cells = p.view("statements")
    income = cells.filter(F.col("metric").isin("EBIT", "Operating Income", "Total Revenue", "Operating Revenue"))
    k = F.substring("ticker", 2, 10).cast("int")
    assets = cells.filter("metric = 'Total Assets'")
    issued = assets.withColumns({"metric": F.lit("Share Issued"), "value": F.col("value") / 1000})
    ordinary = assets.filter(k % 2 == 0).withColumns(
        {"metric": F.lit("Ordinary Shares Number"), "value": F.when(F.month("period") != 6, F.col("value") / 500)}
    )
    cash = assets.filter(k % 3 != 1).withColumns({"metric": F.lit("Cash"), "value": F.col("value") / 10})
    return prices.statement_yields(income, cells.unionByName(issued).unionByName(ordinary).unionByName(cash), p.prices)


@query
def valuation_vs_own_history(p: Pipeline) -> DataFrame:
    history = prices.earnings_yield_history(_statement_rows(p), p.prices)
    current = history.groupBy("ticker").agg(F.max_by("earnings_yield", "period").alias("earnings_yield_current"))
    return prices.valuation_vs_own_history(current, history)


# Factors ------------------------------------------------------------------------------------


def _formulas(p: Pipeline, *groups: Callable[[], dict[str, Column]]) -> DataFrame:
    columns = {k: v for g in groups for k, v in g().items()}
    return factors.with_inputs(p.raw).withColumns(columns).select("quarter_end", "ticker", *columns)


@query
def historical_inputs(p: Pipeline) -> DataFrame:
    return p.raw.select(
        "quarter_end", "ticker", "price", "market_cap", "enterprise_value", "trailing_eps", "trailing_pe",
        "earnings_growth", "dividend_yield", "debt_to_equity", "current_ratio_info", "book_value", "total_debt",
    )


@query
def value_factors(p: Pipeline) -> DataFrame:
    return _formulas(p, factors.value_factors, factors.graham_factors)


@query
def quality_factors(p: Pipeline) -> DataFrame:
    return _formulas(p, factors.quality_factors, factors.earnings_quality, factors.capital_efficiency)


@query
def risk_factors(p: Pipeline) -> DataFrame:
    return _formulas(p, factors.risk_factors, factors.downside_protection)


@query
def piotroski(p: Pipeline) -> DataFrame:
    return _formulas(p, factors.piotroski)


@query
def garp(p: Pipeline) -> DataFrame:
    return _formulas(p, factors.garp_factor)


@query
def balance_sheet(p: Pipeline) -> DataFrame:
    return _formulas(p, factors.balance_sheet_factors, factors.altman_z)


@query
def capital_discipline(p: Pipeline) -> DataFrame:
    return _formulas(p, factors.investment_factor, factors.shareholder_yield)


@query
def buybacks_as_payments(p: Pipeline) -> DataFrame:
    """Shareholder yield with buy-backs entered as positive payments."""
    return _formulas(p, lambda: factors.shareholder_yield(payment_sign=1))


@query
def factor_panel(p: Pipeline) -> DataFrame:
    return p.build_panel().select("quarter_end", "ticker", "price", "market_cap", "fifty_two_week_high", *SIGNALS)


# Cross-sectional scores ---------------------------------------------------------------------


@query
def winsor_bounds(p: Pipeline) -> DataFrame:
    long = long_format(p.panel, ["quarter_end"], SIGNALS, "signal", "v")
    return quantiles(long, ["quarter_end", "signal"], "v", {"lo": 0.01, "hi": 0.99})


@query
def universe_zscore(p: Pipeline) -> DataFrame:
    z = scoring.with_zscores(p.panel, ["quarter_end"], SIGNALS, sector=None)
    return z.select("quarter_end", "ticker", F.posexplode("z").alias("signal", "z")).filter(F.col("z").isNotNull())


@query
def sector_zscore(p: Pipeline) -> DataFrame:
    z = scoring.with_zscores(p.panel, ["quarter_end"], SIGNALS)
    return z.select("quarter_end", "ticker", F.posexplode("z").alias("signal", "z")).filter(F.col("z").isNotNull())


@query
def family_percentiles(p: Pipeline) -> DataFrame:
    scored = scoring.score_panel(p.panel, WEIGHTS)
    return scored.select("quarter_end", "ticker", *[f"pct_{f}" for f in params.HISTORICAL_FAMILIES])


@query
def composite(p: Pipeline) -> DataFrame:
    return p.scored.select("quarter_end", "ticker", "composite", "factor_coverage_pct")


@query
def candidate_composites(p: Pipeline) -> DataFrame:
    scored = candidates.with_candidate_scores(p.scored, params.named_candidates())
    return scored.select("candidate", "quarter_end", "ticker", "composite")


THEMES = {
    "cheap": {"value": 2.0, "garp": 1.0},
    "strong": {"quality": 3.0, "balance_sheet": 1.0},
    "trend": {"momentum": 1.0, "low_volatility": 1.0},
    "capital": {"capital_discipline": 1.0},
}


@query
def theme_composites(p: Pipeline) -> DataFrame:
    """Composites under weights of themes: one theme a family, and themes of several families."""
    grouped = params.theme_weights({"cheap": 0.4, "strong": 0.35, "trend": 0.15, "capital": 0.1}, THEMES)
    single = params.theme_weights(params.EVIDENCE_WEIGHTS)
    scored = candidates.with_candidate_scores(p.scored, {"grouped": params.historical_weights(grouped), "single": params.historical_weights(single)})
    return scored.select("candidate", "quarter_end", "ticker", "composite")


@query
def valuation_vs_history(p: Pipeline) -> DataFrame:
    out = bargain.with_valuation_vs_history(p.panel.select("quarter_end", "ticker", "earnings_yield"))
    return out.select("quarter_end", "ticker", "valuation_vs_history")


@query
def bargain_score(p: Pipeline) -> DataFrame:
    out = bargain.enrich_panel(p.panel.select("quarter_end", "ticker", "price", "fifty_two_week_high", "graham_ratio", "earnings_yield"))
    return out.select("quarter_end", "ticker", *[f"bargain_{c}" for c in bargain.COMPONENTS], "bargain_score")


@query
def bargain_reweighted(p: Pipeline) -> DataFrame:
    base = p.panel.select("quarter_end", "ticker", *[f"bargain_{c}" for c in bargain.COMPONENTS])
    out = candidates.with_candidate_scores(base, params.BARGAIN_ALTERNATIVES, bargain.COMPONENTS, "bargain_", "bargain_score")
    return out.select("candidate", "quarter_end", "ticker", "bargain_score")


# Analysts -----------------------------------------------------------------------------------


def _targets(p: Pipeline) -> DataFrame:
    last = p.prices.groupBy("ticker").agg(F.max_by("close", "trade_date").alias("price"))
    return p.view("quotes").select("ticker", "target_mean", "recommendation_key").join(last, "ticker", "full_outer")


CONSENSUS = (
    "ticker", "mean_rating_score", "consensus_label", "buy_count", "hold_count", "sell_count",
    "recent_upgrades", "recent_downgrades", "implied_upside_pct",
)


def _consensus(p: Pipeline) -> DataFrame:
    joined = analysts.period_summary(p.view("recs_period")).join(_targets(p), "ticker", "full_outer")
    return analysts.with_consensus(joined.fillna(0, ["recent_upgrades", "recent_downgrades"]))


@query
def analyst_consensus(p: Pipeline) -> DataFrame:
    return _consensus(p).select(*CONSENSUS)


@query
def analyst_actions(p: Pipeline) -> DataFrame:
    joined = analysts.action_summary(p.view("recs_actions")).join(_targets(p), "ticker", "full_outer")
    out = analysts.with_consensus(joined.fillna(0, ["recent_upgrades", "recent_downgrades"]))
    notes = F.transform("recent_actions", lambda a: F.concat_ws(" ", a["date"], a["rating"], a["action"]))
    return out.select(*CONSENSUS, F.array_join(notes, "|").alias("recent_actions"))


@query
def earnings_revisions(p: Pipeline) -> DataFrame:
    by_period = analysts.revisions_from_periods(p.view("recs_period")).withColumnRenamed("earnings_revisions", "from_periods")
    by_action = analysts.revisions_from_actions(p.view("recs_actions")).withColumnRenamed("earnings_revisions", "from_actions")
    return by_period.join(by_action, "ticker", "full_outer")


# Live universe ------------------------------------------------------------------------------


def _snapshot(p: Pipeline) -> DataFrame:
    return p._stage("snapshot", lambda: live.universe_snapshot(
        p.view("quotes"), p.view("statements"), p.prices, p.view("recs_period"), samples.END
    ))


@query
def universe_snapshot(p: Pipeline) -> DataFrame:
    return _snapshot(p).select("ticker", "name", "sector", "industry", "price", "market_cap", "fifty_two_week_high",
                           "fifty_two_week_low", "earnings_yield_current", *factors.SIGNALS)


def _scored_universe(p: Pipeline) -> DataFrame:
    return p._stage("scored_universe", lambda: live.score_universe(_snapshot(p)))


@query
def score_universe(p: Pipeline) -> DataFrame:
    return _scored_universe(p).select("ticker", *[f"pct_{f}" for f in params.FAMILIES], "composite", "factor_coverage_pct")


def _fresh_rows(p: Pipeline) -> DataFrame:
    """Live rows as fetched later: some prices moved, some names are blank or only the ticker, and
    some tickers are not in the stored universe."""
    n = F.substring("ticker", 2, 20).cast("long")
    stored = _snapshot(p).select("ticker", "name", "sector", "price", "market_cap", "momentum_12_1", "low_volatility", "roe", "earnings_revisions")
    moved = stored.withColumns(
        {
            "name": F.when(n % 4 == 0, F.col("ticker")).when(n % 4 == 1, F.lit(" unknown ")).otherwise(F.concat(F.col("name"), F.lit(" Inc"))),
            "sector": F.when(n % 5 == 0, F.lit("")).otherwise(F.col("sector")),
            "price": F.when(n % 3 == 0, F.lit(None)).otherwise(F.col("price") * 1.25),
            "momentum_12_1": F.col("momentum_12_1") + 0.5,
            "roe": F.col("roe") + 1.0,
        }
    )
    new = moved.filter(n % 10 == 1).withColumn("ticker", F.concat(F.lit("n"), F.col("ticker")))
    return moved.unionByName(new)


@query
def overlay_merge(p: Pipeline) -> DataFrame:
    merged = overlay.overlay_live(_snapshot(p), _fresh_rows(p))
    return merged.select("ticker", "name", "sector", "industry", "price", "market_cap", "momentum_12_1", "low_volatility", "roe", "earnings_yield")


def _analysis(p: Pipeline) -> DataFrame:
    """Watchlist names scored over the overlaid universe with bargain and analyst columns."""
    history = prices.earnings_yield_history(_statement_rows(p), p.prices)
    analyst = _consensus(p).select("ticker", "consensus_label", "implied_upside_pct")
    return live.analyse(_snapshot(p), _fresh_rows(p), history, analyst)


RESULT = ("ticker", "composite", "factor_coverage_pct", "bargain_score", "consensus_label", "implied_upside_pct", "is_good_buy")


def _aligned(p: Pipeline) -> DataFrame:
    return p._stage("aligned", lambda: overlay.align_with_universe(_analysis(p), _scored_universe(p), LIVE_GATE))


@query
def live_scores(p: Pipeline) -> DataFrame:
    """Scores over the overlaid universe, before alignment with the stored one."""
    return screens.with_good_buy(_analysis(p), LIVE_GATE).select(*RESULT)


@query
def aligned_scores(p: Pipeline) -> DataFrame:
    return overlay.align_with_universe(_analysis(p), _scored_universe(p), LIVE_GATE).select(*RESULT)


def _watchlist(p: Pipeline) -> DataFrame:
    return p.view("universe").filter(F.col("industry") < "NATION_15").select("ticker")


@query
def good_buys(p: Pipeline) -> DataFrame:
    return screens.good_buys(_aligned(p), _watchlist(p), LIVE_GATE).select(*RESULT)


@query
def scorecard(p: Pipeline) -> DataFrame:
    return positions(_aligned(p).select(*RESULT), screens.scorecard_order())


@query
def no_universe(p: Pipeline) -> DataFrame:
    return scoring.unscored(p.view("universe").select("ticker"))


@query
def numeric_coercion(p: Pipeline) -> DataFrame:
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.col("o_orderpriority")).when(kind == 1, "NaN")
        .when(kind == 2, F.col("o_totalprice").cast("string")).otherwise(F.concat(F.lit(" "), F.col("o_custkey"), F.lit(" ")))
    )
    orders = p.spark.read.parquet(f"{p.sf_dir}/orders.parquet")
    return orders.select("o_orderkey", to_double(text).alias("amount"))


@query
def scorecard_counts(p: Pipeline) -> DataFrame:
    return screens.scorecard_counts(_aligned(p))


@query
def top20(p: Pipeline) -> DataFrame:
    return screens.top_by_composite(_scored_universe(p), 20).select("ticker", "composite")


@query
def display_fields(p: Pipeline) -> DataFrame:
    """Names and sectors shown for a ticker: live, else stored."""
    live = _fresh_rows(p).select("ticker", F.col("name").alias("_n"), F.col("sector").alias("_s"))
    both = live.join(_snapshot(p).select("ticker", "name", "sector"), "ticker", "left")
    t = F.col("ticker")
    return both.select(
        "ticker",
        overlay.display_field(F.col("_n"), F.col("name"), t, is_name=True).alias("name"),
        overlay.display_field(F.col("_s"), F.col("sector"), t).alias("sector"),
    )


@query
def score_bands(p: Pipeline) -> DataFrame:
    s = p.scored.withColumn("_below", prices.pct_below(F.col("price"), F.col("fifty_two_week_high")))
    return s.select(
        "quarter_end", "ticker",
        screens.percentile_band(F.col("pct_value")).alias("value_band"),
        screens.gauge_band(F.col("composite")).alias("gauge"),
        screens.proximity_band(F.col("_below")).alias("proximity"),
        *[v.alias(k) for k, v in screens.radar_values(params.HISTORICAL_FAMILIES).items()],
    )


# Selections and portfolio ---------------------------------------------------------------------


@query
def top_quintile(p: Pipeline) -> DataFrame:
    return screens.top_fraction(p.scored.select("quarter_end", "ticker", "composite"))


@query
def top_n(p: Pipeline) -> DataFrame:
    return screens.top_n(p.scored.select("quarter_end", "ticker", "composite"))


@query
def gated_top_n(p: Pipeline) -> DataFrame:
    rows = p.scored.select("quarter_end", "ticker", "composite", "bargain_score")
    one = screens.gated_top_n(rows, GATE, order=["composite"]).withColumn("rule", F.lit("composite"))
    return one.unionByName(screens.gated_top_n(rows, GATE).withColumn("rule", F.lit("composite_bargain")))


@query
def holdings_months(p: Pipeline) -> DataFrame:
    """Six holding months, so that consecutive quarters overlap."""
    picks = screens.top_fraction(p.scored.select("quarter_end", "ticker", "composite"))
    return backtest.holding_months(picks, 6)


def _held(p: Pipeline) -> DataFrame:
    rows = p.scored.select("quarter_end", "ticker", "composite")
    return p._stage("held", lambda: backtest.with_holding_returns(rows, p.monthly, p.delisted))


def _port(p: Pipeline) -> DataFrame:
    return p._stage("port", lambda: backtest.portfolio_returns(screens.top_fraction(_held(p))))


@query
def portfolio_returns(p: Pipeline) -> DataFrame:
    held = backtest.with_holding_returns(p.scored.select("quarter_end", "ticker", "composite"), p.monthly, p.delisted)
    port = backtest.portfolio_returns(screens.top_fraction(held))
    return port.join(backtest.benchmark_returns(p.monthly), "month", "left")


@query
def member_portfolio(p: Pipeline) -> DataFrame:
    """All members held, the delisted ones too: every month without a return costs the penalty."""
    picks = p.members.select("quarter_end", "ticker")
    return backtest.portfolio_returns(backtest.with_holding_returns(picks, p.monthly, p.delisted))


def _aligned_months(p: Pipeline) -> DataFrame:
    return _port(p).join(backtest.benchmark_returns(p.monthly), "month")


@query
def rolling_excess(p: Pipeline) -> DataFrame:
    return backtest.rolling_excess(_aligned_months(p))


@query
def portfolio_metrics(p: Pipeline) -> DataFrame:
    """Growth, drawdown, win rate and median rolling excess of the top-quintile portfolio."""
    series = _aligned_months(p).select(F.lit("top_quintile").alias("run"), "month", "port", "bench")
    return (
        series.groupBy("run").agg(backtest.cagr("port").alias("cagr"), backtest.cagr("bench").alias("benchmark_cagr"))
        .join(backtest.drawdown(series, ["run"]), "run")
        .join(backtest.win_rate(backtest.rolling_excess(series, ["run"]), ["run"]), "run")
    )


@query
def information_coefficient(p: Pipeline) -> DataFrame:
    return backtest.quarterly_ics(p.scored, p.forward)


@query
def horizon_ics(p: Pipeline) -> DataFrame:
    ics = backtest.quarterly_ics(p.scored, p.forward).withColumn("score", F.lit("composite"))
    other = backtest.quarterly_ics(p.scored, p.forward, "bargain_score").withColumn("score", F.lit("bargain_score"))
    return backtest.mean_horizon_ics(ics.unionByName(other), ["score"])


@query
def run_backtest(p: Pipeline) -> DataFrame:
    rows = _held(p)
    return backtest.run_backtest(rows, p.monthly, p.forward, p.delisted, samples.WINDOWS)


# Periodic investment ------------------------------------------------------------------------


def _picks(p: Pipeline) -> DataFrame:
    rows = p.scored.select("quarter_end", "ticker", "composite", "bargain_score")
    return p._stage("picks", lambda: screens.gated_top_n(rows, GATE).select("quarter_end", "ticker"))


@query
def dca_wealth(p: Pipeline) -> DataFrame:
    """Wealth path of both strategies and the benchmark."""
    market = dca.benchmark_picks(p.grid)
    parts = [
        dca.wealth_path(_picks(p), p.grid, p.quarters, p.delisted).withColumn("strategy", F.lit("buy_and_hold")),
        dca.wealth_path(_picks(p), p.grid, p.quarters, p.delisted, strategy="rebalance").withColumn("strategy", F.lit("rebalance")),
        dca.wealth_path(market, p.grid, p.quarters, p.delisted).withColumn("strategy", F.lit("benchmark")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("strategy", "quarter_end", "wealth")


@query
def dca_buy_hold(p: Pipeline) -> DataFrame:
    return dca.simulate(_picks(p), p.grid, p.quarters, p.delisted)


@query
def dca_rebalance(p: Pipeline) -> DataFrame:
    return dca.simulate(_picks(p), p.grid, p.quarters, p.delisted, strategy="rebalance")


@query
def dca_benchmark(p: Pipeline) -> DataFrame:
    return dca.simulate(dca.benchmark_picks(p.grid), p.grid, p.quarters, p.delisted)


@query
def dca_holdings_log(p: Pipeline) -> DataFrame:
    return dca.holdings_log(_picks(p), p.grid).withColumn("bought", F.array_join("bought", ","))


OLD_GATE = params.Thresholds(composite_min=50.0, bargain_min=50.0)


def _scenario_picks(p: Pipeline) -> DataFrame:
    """Old and new weights under their own thresholds."""
    names = params.named_candidates()
    weights = {"old": names["legacy_tuned"], "new": names["evidence_based"]}
    rows = candidates.with_candidate_scores(p.scored, weights).select("candidate", "quarter_end", "ticker", "composite", "bargain_score")
    keys = ["candidate", "quarter_end"]
    old = screens.gated_top_n(rows.filter(F.col("candidate") == "old"), OLD_GATE, keys=keys)
    new = screens.gated_top_n(rows.filter(F.col("candidate") == "new"), GATE, keys=keys)
    return p._stage("scenario_picks", lambda: old.unionByName(new).select(*keys, "ticker"))


@query
def dca_sensitivity(p: Pipeline) -> DataFrame:
    """Old and new weights under three penalties for delisted names, against the benchmark."""
    by = ["candidate", "delist_return"]
    scenarios = _scenario_picks(p).withColumn("delist_return", F.explode(F.array(F.lit(0.0), F.lit(-0.5), F.lit(-1.0))))
    runs = dca.simulate(scenarios, p.grid, p.quarters, p.delisted, by, delist_return=F.col("delist_return"))
    market = dca.simulate(dca.benchmark_picks(p.grid), p.grid, p.quarters, p.delisted)
    one = market.select(
        F.explode(F.array(F.lit("old"), F.lit("new"))).alias("candidate"),
        *[F.col(c).alias(f"spy_{c}") for c in ("terminal_wealth", "total_return", "cagr")],
    )
    return runs.join(one, "candidate").select(
        *by, "terminal_wealth", "total_return", "cagr", "spy_terminal_wealth", "spy_total_return", "spy_cagr",
        (F.col("terminal_wealth") - F.col("spy_terminal_wealth")).alias("vs_spy_wealth_delta"),
    )


#: Days after which a carried price counts as lost; all names of the given tables end before the calendar does.
LOST_AFTER = 120


@query
def dca_delisting(p: Pipeline) -> DataFrame:
    """Held names that lose their prices, under three penalties and both strategies."""
    grid = asof.prices_at_quarters(p.prices, p.quarters, LOST_AFTER)
    gone = ingest.ended_catalog(p.prices, p.quarters[-1], LOST_AFTER)
    picks = _picks(p).withColumn("delist_return", F.explode(F.array(F.lit(0.0), F.lit(-0.5), F.lit(-1.0))))
    runs = [
        dca.simulate(picks, grid, p.quarters, gone, ["delist_return"], strategy, F.col("delist_return")).withColumn("strategy", F.lit(strategy))
        for strategy in ("buy_and_hold", "rebalance")
    ]
    return runs[0].unionByName(runs[1]).select("strategy", "delist_return", "terminal_wealth", "total_return", "cagr", "max_drawdown")


@query
def dca_comparison(p: Pipeline) -> DataFrame:
    runs = p._stage("dca_runs", lambda: dca.simulate(_scenario_picks(p), p.grid, p.quarters, p.delisted, ["candidate"]))
    market = dca.simulate(dca.benchmark_picks(p.grid), p.grid, p.quarters, p.delisted)
    old, new = runs.filter(F.col("candidate") == "old"), runs.filter(F.col("candidate") == "new")
    vs_market = dca.compare(runs, market, F.concat(F.col("candidate"), F.lit("_vs_spy")), True)
    return vs_market.unionByName(dca.compare(new, old, F.lit("new_vs_old"), False))


# Validation ---------------------------------------------------------------------------------


@query
def fold_excess(p: Pipeline) -> DataFrame:
    k = dca.fold_excess(_picks(p), p.grid, validation.quarter_folds(p.quarters), p.delisted).withColumn("kind", F.lit("contiguous"))
    e = dca.fold_excess(_picks(p), p.grid, validation.expanding_folds(p.quarters), p.delisted).withColumn("kind", F.lit("expanding"))
    return k.unionByName(e)


@query
def bootstrap_ci(p: Pipeline) -> DataFrame:
    """Interval of the mean monthly excess return."""
    values = _aligned_months(p).select((F.round(F.col("port") - F.col("bench"), 9)).alias("v"))
    return validation.bootstrap_ci(values, "v")


@query
def weight_search(p: Pipeline) -> DataFrame:
    # Closes of the given tables jump by factors; their 20th root moves like a share price.
    monthly = p.monthly.withColumn("return", F.pow(F.col("return") + 1.0, F.lit(0.05)) - 1.0)
    return validation.search_weights(p.scored, monthly, p.forward, p.delisted, _search(500), samples.WINDOWS, SEARCH_MONTHS)


@query
def cv_search(p: Pipeline) -> DataFrame:
    return validation.search_weights_cv(p.scored, p.grid, p.quarters, p.delisted, _search(200))


@query
def compare_candidates(p: Pipeline) -> DataFrame:
    return validation.compare_candidates(p.scored, p.grid, p.forward, p.quarters, p.delisted, params.named_candidates(), GATE)


@query
def bargain_validation(p: Pipeline) -> DataFrame:
    return validation.validate_bargain_weights(p.panel, p.forward)


@query
def score_buckets(p: Pipeline) -> DataFrame:
    c = validation.score_buckets(p.scored, p.forward, "composite", "excess_3y").withColumn("score", F.lit("composite"))
    b = validation.score_buckets(p.scored, p.forward, "bargain_score", "excess_3y").withColumn("score", F.lit("bargain_score"))
    return c.unionByName(b)


@query
def calibrate_thresholds(p: Pipeline) -> DataFrame:
    return validation.calibrate_thresholds(p.scored, p.forward)



