"""One statement per registered query."""

from __future__ import annotations

from oracles.ctes import FAMILIES, LIVE_FAMILIES, SIGNALS, dca_summary

FINALS: dict[str, str] = {}
HORIZONS = ("1q", "1y", "3y", "5y")


def rounding(x: str) -> str:
    """Six decimals, three from a million on and ten significant digits from 1e10 on (half to even)."""
    scale = f"pow(10.0::double, floor(log10(abs({x}))) - 9)"
    return (f"case when abs({x}) >= 1e10 then round_even({x} / {scale}, 0) * {scale} when abs({x}) >= 1e6 then round_even({x} * 1e3, 0) / 1e3 "
            f"else round_even({x} * 1e6, 0) / 1e6 end")


def significant(x: str) -> str:
    """Ten significant digits."""
    scale = f"pow(10.0::double, floor(log10(abs({x}))) - 9)"
    return f"case when ({x}) = 0 then 0.0::double else round_even(({x}) / {scale}, 0) * {scale} end"


def final(name: str, sql: str, *doubles: str) -> None:
    """Register a statement; ``doubles`` are rounded."""
    if doubles or sql.strip().startswith("with"):
        replaced = " replace (" + ", ".join(f"{rounding(d)} as {d}" for d in doubles) + ")" if doubles else ""
        sql = f"select *{replaced} from ({sql.strip()})"
    FINALS[name] = sql


def spearman(pairs: str, keys: str, a: str, b: str) -> str:
    """Rank correlation per group with average ranks; NULL below ten pairs or for a constant."""
    return f"""
      select {keys}, case when count(*) >= 10 and min(ra) < max(ra) and min(rb) < max(rb) then corr(ra, rb) end as ic from (
        select {keys}, rank() over (partition by {keys} order by {a}) + (count(*) over (partition by {keys}, {a}) - 1) / 2.0::double as ra,
               rank() over (partition by {keys} order by {b}) + (count(*) over (partition by {keys}, {b}) - 1) / 2.0::double as rb
        from {pairs}) group by {keys}"""


def mean_ics(ics: str, key: str) -> str:
    return f"select {key}, " + ", ".join(
        f"coalesce(avg(ic) filter (horizon = '{h}'), 0) as ic_{h}" for h in HORIZONS
    ) + f" from ({ics}) group by {key}"


final("monthly_returns", "select month, ticker, ret from v_monthly", "ret")
final("quarter_end_prices", """
    select t.ticker, quarter_end, close as price from (select distinct ticker from v_prices) t cross join v_quarters
    asof join v_prices p on p.ticker = t.ticker and p.trade_date <= v_quarters.quarter_end""", "price")
final("asof_statement_prices", """
    select f.ticker, f.field, f.filed, f.period, p.trade_date, p.close from v_fundamentals f
    asof left join v_prices p on p.ticker = f.ticker and p.trade_date <= f.filed""", "close")
final("asof_fresh_prices", """
    select f.ticker, f.field, f.filed, f.period, case when date_diff('day', p.trade_date, f.filed) <= 10 then p.trade_date end as trade_date,
      case when date_diff('day', p.trade_date, f.filed) <= 10 then p.close end as close
    from v_fundamentals f
    asof left join v_prices p on p.ticker = f.ticker and p.trade_date <= f.filed""", "close")
_FWD = [f"{k}_{h}" for k in ("fwd", "excess") for h in HORIZONS]
final("forward_returns", f"select as_of_quarter, ticker, {', '.join(_FWD)} from v_fwd", *_FWD)
final("next_quarter_returns", """
    select n.quarter_end, ticker, fwd_1q as fwd_return from v_fwd f join v_pq n on n.q = f.q + 1 where fwd_1q is not null""", "fwd_return")
_PIT = [
    "total_assets", "total_liabilities", "current_assets", "current_liabilities", "long_term_debt", "shares_outstanding",
    "gross_profit", "net_income", "ebit", "revenue", "operating_cashflow", "dividends_paid", "repurchase_of_stock",
    "retained_earnings", "total_cash", "book_equity",
]
_PIT_ALL = _PIT + [f"{f}_prior" for f in _PIT] + ["book_value", "total_debt"]
final("pit_fundamentals", f"select quarter_end, ticker, {', '.join(_PIT_ALL)} from v_members left join v_pit using (quarter_end, ticker)", *_PIT_ALL)

_BEST = "filed desc, ddate desc, tag desc, adsh desc, amount desc"
for _name, _first in (("normalize_filings", "instant desc"), ("normalize_filings_quarterly", "instant asc")):
    final(_name, f"""
        select ticker, cik, field, amount, period, filed, form, tag, qtrs from v_filed where amount is not null
        qualify row_number() over (partition by cik, field, period order by {_first}, {_BEST}) = 1""", "amount")
final("filing_sets", f"""
    with one as (select * from v_filed where amount is not null
      qualify row_number() over (partition by dataset_quarter, cik, field, period order by instant desc, {_BEST}) = 1)
    select ticker, cik, field, amount, period, filed, form, tag, qtrs, dataset_quarter from one
    qualify row_number() over (partition by ticker, field, period, filed order by dataset_quarter desc) = 1""", "amount")
final("membership_panel", "select quarter_end, ticker, snapshot_date from v_members")
final("members_as_of", "select distinct ticker from v_members where quarter_end = date '2001-12-31'")
final("delisted_catalog", "select ticker from v_delisted")
final("benchmark_check", "select ticker, count(*) as n, max(trade_date) as last_date from v_prices group by ticker")
final("daily_closes", """
    select concat('S', cast(l_suppkey as varchar)) as ticker, cast(l_shipdate as date) as trade_date, max(l_extendedprice) as close
    from lineitem group by 1, 2""", "close")
final("usable_quotes", """
    select ticker, name as long_name, case when k % 3 <> 0 then abs(bal) end as current_price,
      case when k % 9 <> 0 then abs(bal) + 1.0::double end as regular_market_price
    from v_universe where (k % 3 <> 0 and bal <> 0) or k % 9 <> 0""", "current_price", "regular_market_price")
final("statement_latest_prior", "select ticker, field, metric, latest, prior, stale from v_statement_values", "latest", "prior")
final("statement_warnings", """
    select ticker, string_agg(distinct metric, '|' order by metric) as data_warnings from v_statement_values where stale group by 1""")

# Price analytics
final("price_momentum", "select quarter_end, ticker, price, momentum_12_1 from v_metrics", "price", "momentum_12_1")
final("price_volatility", "select quarter_end, ticker, volatility_12m from v_metrics", "volatility_12m")
final("price_drawdown", "select quarter_end, ticker, max_drawdown, downside_deviation from v_metrics", "max_drawdown", "downside_deviation")
final("price_rsi", "select quarter_end, ticker, rsi_14 from v_metrics", "rsi_14")
final("price_52w", """
    select quarter_end, ticker, price, fifty_two_week_high, fifty_two_week_low, all_time_high,
      greatest(0, 1 - price / fifty_two_week_high) as below_52w_high, greatest(0, 1 - price / all_time_high) as below_ath,
      case when fifty_two_week_high > fifty_two_week_low then
        least(1, greatest(0, (price - fifty_two_week_low) / (fifty_two_week_high - fifty_two_week_low))) end as range_position
    from v_metrics""", "price", "fifty_two_week_high", "fifty_two_week_low", "all_time_high", "below_52w_high", "below_ath", "range_position")
final("all_time_highs", "select ticker, max(close) as all_time_high from v_prices group by 1", "all_time_high")
final("moving_average", """
    select ticker, trade_date, close, case when count(*) over w = 20 then avg(close) over w end as sma from v_prices
    window w as (partition by ticker order by trade_date rows between 19 preceding and current row)""", "close", "sma")
_SINCE = {"1M": "1 month", "3M": "3 month", "6M": "6 month", "1Y": "12 month", "2Y": "24 month", "5Y": "60 month"}
final("price_range_slice", " union all ".join(
    f"""select ticker, count(*) as n, min(trade_date) as first_date, min(close) as low, max(close) as high, '{n}' as price_range
        from v_prices join (select ticker, max(trade_date) as last from v_prices group by 1) using (ticker) where trade_date >= {e} group by 1"""
    for n, e in {**{k: f"last - interval {v}" for k, v in _SINCE.items()}, "YTD": "date_trunc('year', last)", "All": "date '1900-01-01'"}.items()
), "low", "high")
_EY = """
    with w as (
      select ticker, period, max(amount) filter (field = 'ebit') as ebit, max(amount) filter (field = 'shares_outstanding') as shares,
        max(amount) filter (field = 'long_term_debt') as debt, max(amount) filter (field = 'total_cash') as cash
      from (select * from v_fundamentals qualify row_number() over (partition by ticker, field, period order by filed desc) = 1)
      group by 1, 2 qualify row_number() over (partition by ticker order by period desc) <= 20),
    h as (
      select w.ticker, period, ebit / (close * shares + coalesce(debt, 0) - coalesce(cash, 0)) as earnings_yield
      from w asof join v_prices p on p.ticker = w.ticker and p.trade_date <= w.period
      where shares > 0 and close > 0 and ebit is not null and close * shares + coalesce(debt, 0) - coalesce(cash, 0) > 0)"""
final("earnings_yield_history", _EY + " select * from h", "earnings_yield")
final("statement_yields", """
    select ticker, period, ebit / ev as earnings_yield from (
      select w.*, close * shares + coalesce(debt, 0) - coalesce(cash, 0) as ev from (
        select *, row_number() over (partition by ticker order by period desc) as i from (
          select ticker, period, max(value) filter (metric = 'EBIT') as ebit,
            max(value) filter (metric = 'Long Term Debt And Capital Lease Obligation') as debt,
            max(case when cast(ticker[2:] as integer) % 2 = 1 then value / 1000 when month(period) <> 6 then value / 500 end)
              filter (metric = 'Total Assets') as shares,
            max(case when cast(ticker[2:] as integer) % 3 <> 1 then value / 10 end) filter (metric = 'Total Assets') as cash
          from v_statements group by ticker, period)) w
      asof join v_prices p on p.ticker = w.ticker and p.trade_date <= w.period
      where i <= 20 and shares > 0 and close > 0 and ebit is not null) where ev > 0""", "earnings_yield")
final("valuation_vs_own_history", _EY + """
    select ticker, current as earnings_yield_current,
      case when count(*) >= 4 then 100.0::double * count(*) filter (earnings_yield <= current) / count(*) end as valuation_vs_history
    from h join (select ticker, arg_max(earnings_yield, period) as current from h group by 1) using (ticker) group by 1, 2""",
    "earnings_yield_current", "valuation_vs_history")

# Factors
def _factors(name: str, *cols: str) -> None:
    final(name, f"select quarter_end, ticker, {', '.join(cols)} from v_factors", *cols)


_factors("historical_inputs", "price", "market_cap", "enterprise_value", "trailing_eps", "trailing_pe", "earnings_growth",
         "dividend_yield", "debt_to_equity", "current_ratio_info", "book_value", "total_debt")
_factors("value_factors", "earnings_yield", "book_to_market", "fcf_yield", "graham_fair_value", "graham_ratio", "current_ratio")
_factors("quality_factors", "gross_profitability", "roe", "roa", "profit_margin", "accruals", "earnings_quality", "invested_capital", "roic")
_factors("risk_factors", "low_volatility", "downside_protection")
final("piotroski", """
    select quarter_end, ticker, case when checks > 0 then passed::double end as piotroski_f_score,
      passed * 9.0::double / nullif(checks, 0) as financial_strength from v_factors""", "piotroski_f_score", "financial_strength")
_factors("garp", "peg_ratio", "dividend_adjusted_peg", "garp")
_factors("balance_sheet", "net_cash", "net_cash_to_mcap", "low_leverage", "altman_z")
final("capital_discipline", """
    select quarter_end, ticker, asset_growth, investment, bb as net_buybacks, returned as total_returned_to_shareholders, shareholder_yield
    from v_factors""", "asset_growth", "investment", "net_buybacks", "total_returned_to_shareholders", "shareholder_yield")
final("buybacks_as_payments", """
    select quarter_end, ticker, -bb as net_buybacks, returned_as_payment as total_returned_to_shareholders, payment_yield as shareholder_yield
    from v_factors""", "net_buybacks", "total_returned_to_shareholders", "shareholder_yield")
_PANEL = ["price", "market_cap", "fifty_two_week_high", *SIGNALS]
final("factor_panel", f"select quarter_end, ticker, {', '.join(_PANEL)} from v_panel", *_PANEL)

# Scores
final("winsor_bounds", """
    select quarter_end, signal, count(*) as n, quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.99) as hi
    from v_long where v is not null group by 1, 2""", "lo", "hi")
final("universe_zscore", "select quarter_end, ticker, pos::bigint as signal, zu as z from v_z_long join v_signals using (signal) where zu is not null", "z")
final("sector_zscore", "select quarter_end, ticker, pos::bigint as signal, z from v_z_long join v_signals using (signal) where z is not null", "z")
_PCT = [f"pct_{f}" for f in FAMILIES]
final("family_percentiles", f"select quarter_end, ticker, {', '.join(_PCT)} from v_pct", *_PCT)
final("composite", "select quarter_end, ticker, composite, coalesce(factor_coverage_pct, 0) as factor_coverage_pct from v_scored", "composite", "factor_coverage_pct")
final("theme_composites", """
    with shares(theme, theme_w, family, share) as (values ('cheap', 0.4::double, 'value', 2), ('cheap', 0.4::double, 'garp', 1), ('strong', 0.35::double, 'quality', 3),
      ('strong', 0.35::double, 'balance_sheet', 1), ('trend', 0.15::double, 'momentum', 1), ('trend', 0.15::double, 'low_volatility', 1), ('capital', 0.1::double, 'capital_discipline', 1)),
    w as (select 'grouped' as candidate, family, theme_w * share / sum(share) over (partition by theme) as w from shares
      union all select 'single', family, w from v_evidence),
    c as (select candidate, quarter_end, ticker, round(sum(pct * w) / sum(w), 9) as composite from v_fam join w using (family) group by all)
    select candidate, quarter_end, ticker, composite from v_panel cross join (select distinct candidate from w)
    left join c using (candidate, quarter_end, ticker)""", "composite")
final("candidate_composites", """
    select candidate, quarter_end, ticker, composite from v_panel cross join (select distinct candidate from v_named)
    left join v_named_scores using (candidate, quarter_end, ticker)""", "composite")
final("valuation_vs_history", "select quarter_end, ticker, valuation_vs_history from v_panel", "valuation_vs_history")
_B = ["b_mos", "valuation_vs_history", "b_52w"]
final("bargain_score", """
    select quarter_end, ticker, b_mos as bargain_margin_of_safety, valuation_vs_history as bargain_valuation_vs_history,
      b_52w as bargain_discount_52w, bargain_score from v_panel""",
    "bargain_margin_of_safety", "bargain_valuation_vs_history", "bargain_discount_52w", "bargain_score")
_BW = {"default_long_horizon": (0.40, 0.35, 0.25), "graham_heavy": (0.55, 0.30, 0.15), "equal": (1 / 3, 1 / 3, 1 / 3)}


def _bargain_under(weights: tuple[float, ...]) -> str:
    num = " + ".join(f"coalesce({c} * {w!r}::double, 0)" for c, w in zip(_B, weights))
    den = " + ".join(f"case when {c} is null then 0 else {w!r}::double end" for c, w in zip(_B, weights))
    return f"round(({num}) / nullif({den}, 0), 9)"


_REWEIGHTED = " union all ".join(
    f"select '{n}' as candidate, quarter_end, ticker, {_bargain_under(w)} as bargain_score from v_panel" for n, w in _BW.items()
)
final("bargain_reweighted", _REWEIGHTED, "bargain_score")

# Analysts
_TARGETS = """
    targets as (
      select ticker, case when bal > 0 then bal end as target,
        case k % 6 when 0 then 5 when 1 then 4 when 2 then 3 when 3 then 2 when 4 then 1 end::double as key_score, price, known
      from (select *, 1 as known from v_universe) full join (select ticker, arg_max(close, trade_date) as price from v_prices group by 1) using (ticker))"""
_LABEL = """case when coalesce(mean_rating_score, 0) = 0 then 'Unknown' when mean_rating_score >= 4.5 then 'Strong Buy' when mean_rating_score >= 3.5 then 'Buy'
      when mean_rating_score >= 2.5 then 'Hold' when mean_rating_score >= 1.5 then 'Underperform' else 'Sell' end as consensus_label"""


def _consensus(counts: str, extra: str = "", mean: str = "cast(null as double)") -> str:
    """Consensus columns from counts (nb, nh, ns, up, down) per ticker."""
    return f"""
      with c as ({counts}), {_TARGETS},
      j as (select ticker, coalesce(nb, 0) as nb, coalesce(nh, 0) as nh, coalesce(ns, 0) as ns, coalesce(up, 0) as up, coalesce(down, 0) as down,
              {mean} as given, target, key_score, price {extra} from c full join targets using (ticker)),
      k as (select *, nb + nh + ns = 0 and key_score is not null as alone from j),
      v as (select * replace (case when alone then (key_score >= 4)::bigint else nb end as nb,
              case when alone then (key_score >= 3 and key_score < 4)::bigint else nh end as nh,
              case when alone then (key_score < 3)::bigint else ns end as ns) from k)
      select ticker, coalesce(given, (nb * 4.5::double + nh * 3.0::double + ns * 1.5::double) / nullif(nb + nh + ns, 0), key_score) as mean_rating_score,
        {_LABEL}, nb::bigint as buy_count, nh::bigint as hold_count, ns::bigint as sell_count, up::bigint as recent_upgrades, down::bigint as recent_downgrades,
        case when price > 0 then (nullif(target, 0) / price - 1) * 100 end as implied_upside_pct {extra} from v"""


_PERIODS = """
    select ticker, sb0 + b0 as nb, h0 as nh, s0 + ss0 as ns, mean0, mean0 - mean1 as shift,
      greatest(0, coalesce((sb0 + b0 - s0 - ss0) - (sb1 + b1 - s1 - ss1), 0)) as up,
      greatest(0, -coalesce((sb0 + b0 - s0 - ss0) - (sb1 + b1 - s1 - ss1), 0)) as down
    from (select *, (5 * sb0 + 4 * b0 + 3 * h0 + 2 * s0 + ss0)::double / nullif(sb0 + b0 + h0 + s0 + ss0, 0) as mean0,
                 (5 * sb1 + 4 * b1 + 3 * h1 + 2 * s1 + ss1)::double / nullif(sb1 + b1 + h1 + s1 + ss1, 0) as mean1
      from (select ticker, """ + ", ".join(
    f"coalesce(max({c}) filter (period = '0m'), max({c}) filter (period = '-1m')) as {c}0, max({c}) filter (period = '-1m') as {c}1" for c in ("sb", "b", "h", "s", "ss")
) + " from v_recs group by 1))"
final("analyst_consensus", _consensus(_PERIODS, mean="mean0"), "mean_rating_score", "implied_upside_pct")
final("analyst_actions", _consensus("""
    select ticker, count(*) filter (grade in ('Strong Buy', 'Outperform')) as nb, count(*) filter (grade = 'Hold') as nh,
      count(*) filter (grade in ('Underperform', 'Sell')) as ns, count(*) filter (action = 'up') as up, count(*) filter (action = 'down') as down,
      string_agg(concat(cast(day as varchar), ' ', grade, ' ', action), '|' order by seq) filter (back <= 10) as recent_actions
    from v_actions where back <= 50 group by 1""", ", recent_actions"), "mean_rating_score", "implied_upside_pct")
final("earnings_revisions", f"""
    select ticker, shift * 10 as from_periods, from_actions from ({_PERIODS}) full join (
      select ticker, (count(*) filter (action = 'up') - count(*) filter (action = 'down'))::double as from_actions from v_actions where back <= 20 group by 1)
    using (ticker)""", "from_periods", "from_actions")

# Live universe
_LIVE = ["price", "market_cap", "fifty_two_week_high", "fifty_two_week_low", "earnings_yield_current", *SIGNALS, "earnings_revisions"]
final("universe_snapshot", f"select ticker, name, sector, industry, {', '.join(_LIVE)} from v_live", *_LIVE)
_LIVE_PCT = [f"pct_{f}" for f in LIVE_FAMILIES]
final("score_universe", f"select ticker, {', '.join(_LIVE_PCT)}, composite, coalesce(factor_coverage_pct, 0) as factor_coverage_pct from v_live left join v_live_scored using (ticker)",
      *_LIVE_PCT, "composite", "factor_coverage_pct")
_MERGED = ["price", "market_cap", "momentum_12_1", "low_volatility", "roe", "earnings_yield"]
final("overlay_merge", f"select ticker, name, sector, industry, {', '.join(_MERGED)} from v_merged", *_MERGED)
_ANALYSIS = f"""
    cons as ({_consensus(_PERIODS, mean="mean0")}),
    hist as ({_EY} select * from h),
    val as (
      select ticker, case when count(*) >= 4 then 100.0::double * count(*) filter (earnings_yield <= cur) / count(*) end as vh
      from hist join (select ticker, coalesce(earnings_yield_current, earnings_yield) as cur from v_merged) using (ticker) where cur is not null group by 1),
    parts as (
      select ticker, case when graham_ratio > 0 then least(100, greatest(0, (graham_ratio - 0.30::double) / (1.30::double - 0.30::double) * 100)) end as b_mos,
        vh as valuation_vs_history, case when fifty_two_week_high > 0 and price > 0 then least(100, greatest(0, (1 - price / fifty_two_week_high) / 0.30::double * 100)) end as b_52w
      from v_merged left join val using (ticker)),
    an as (
      select ticker, s.composite, coalesce(s.factor_coverage_pct, 0) as factor_coverage_pct, {_bargain_under((0.40, 0.35, 0.25))} as bargain_score,
        coalesce(consensus_label, 'Unknown') as consensus_label, implied_upside_pct, l.ticker is not null as known, l.composite as lc, coalesce(l.factor_coverage_pct, 0) as lf
      from parts left join v_merged_scored s using (ticker) left join cons using (ticker)
      left join (select ticker, c.composite, c.factor_coverage_pct from v_live left join v_live_scored c using (ticker)) l using (ticker)),
    live as (select ticker, composite, factor_coverage_pct, bargain_score, consensus_label, implied_upside_pct,
        coalesce(composite >= 45 and bargain_score >= 20 and consensus_label <> 'Sell', false) as is_good_buy from an),
    aligned as (select ticker, case when known then lc else composite end as composite, case when known then lf else factor_coverage_pct end as factor_coverage_pct,
        bargain_score, consensus_label, implied_upside_pct,
        coalesce(case when known then lc else composite end >= 45 and bargain_score >= 20 and consensus_label <> 'Sell', false) as is_good_buy from an)"""
_RES = ("composite", "factor_coverage_pct", "bargain_score", "implied_upside_pct")
final("live_scores", f"with {_ANALYSIS} select * from live", *_RES)
final("aligned_scores", f"with {_ANALYSIS} select * from aligned", *_RES)
final("good_buys", f"with {_ANALYSIS} select * from aligned where is_good_buy and ticker in (select ticker from v_watch)", *_RES)
final("scorecard", f"with {_ANALYSIS} select *, row_number() over (order by is_good_buy desc, composite desc nulls last, ticker) as position from aligned", *_RES)
final("no_universe", "select ticker, " + ", ".join(f"cast(null as double) as pct_{f}" for f in LIVE_FAMILIES)
      + ", cast(null as double) as composite, 0.0::double as factor_coverage_pct, false as is_good_buy from v_universe")
final("numeric_coercion", """
    select o_orderkey, case when isnan(x) then null else x end as amount from (
      select o_orderkey, try_cast(case o_orderkey % 4 when 0 then o_orderpriority when 1 then 'NaN' when 2 then cast(o_totalprice as varchar)
        else concat(' ', o_custkey, ' ') end as double) as x from orders)""", "amount")
final("scorecard_counts", f"with {_ANALYSIS} select count(*) filter (is_good_buy) as buy_count, count(*) as total_count from aligned")
final("top20", "select ticker, composite from v_live_scored where composite is not null order by composite desc, ticker limit 20", "composite")
final("display_fields", """
    select f.ticker, case when f.name <> f.ticker and lower(trim(f.name)) not in ('', 'unknown') then f.name
        when s.name is not null then s.name when f.name <> f.ticker then f.name end as name,
      case when lower(trim(f.sector)) not in ('', 'unknown') then f.sector when s.sector is not null then s.sector else f.sector end as sector
    from v_fresh f left join v_live s using (ticker)""")

# Selections and portfolio
final("score_bands", """
    select quarter_end, ticker,
      case when pct_value is null then 'none' when pct_value <= 30 then 'low' when pct_value <= 70 then 'middle' else 'high' end as value_band,
      case when composite is null then 'N/A' when composite >= 50 then 'Good' when composite <= 25 then 'Weak' else 'Fair' end as gauge,
      case when fifty_two_week_high is null then 'none' when 1 - price / fifty_two_week_high <= 0.10 then 'near'
        when 1 - price / fifty_two_week_high <= 0.25 then 'moderate' else 'discounted' end as proximity, """
    + ", ".join(f"coalesce(pct_{f}, list_avg([{', '.join(_PCT)}]), 50) as radar_{f}" for f in FAMILIES) + " from v_scored",
    *[f"radar_{f}" for f in FAMILIES])
final("top_quintile", "select quarter_end, ticker, composite from v_quintile", "composite")
final("top_n", """
    select quarter_end, ticker, composite, row_number() over (partition by quarter_end order by composite desc, ticker) as pick
    from v_scored where composite is not null qualify pick <= 5""", "composite")
final("gated_top_n", " union all ".join(f"""
    (select quarter_end, ticker, composite, bargain_score, row_number() over (partition by quarter_end order by {o}) as pick, '{n}' as rule
     from v_scored where composite >= 45 and bargain_score >= 40 qualify pick <= 5)"""
    for n, o in (("composite", "composite desc, ticker"), ("composite_bargain", "composite desc, bargain_score desc, ticker"))),
    "composite", "bargain_score")
final("holdings_months", """
    with h as (select quarter_end, ticker, last_day(cast(date_trunc('month', quarter_end) + to_months(cast(k as integer)) as date)) as month
      from v_quintile cross join (select unnest([1, 2, 3, 4, 5, 6]) as k))
    select quarter_end, ticker, month from h qualify quarter_end = max(quarter_end) over (partition by month)""")
final("portfolio_returns", "select month, port, bench from v_port left join v_bench using (month)", "port", "bench")
final("member_portfolio", """
    select month, avg(coalesce(ret, case when ticker in (select ticker from v_delisted) then -0.5::double end)) as port
    from (select ticker, last_day(cast(date_trunc('month', quarter_end) + to_months(cast(k as integer)) as date)) as month
          from v_members cross join (select unnest([1, 2, 3]) as k))
    left join v_monthly using (ticker, month) group by month having count(ret) > 0""", "port")
final("rolling_excess", "select month, excess from v_rolling", "excess")
final("portfolio_metrics", """
    select 'top_quintile' as run, pow(product(1 + port), 12.0::double / count(*)) - 1 as cagr, pow(product(1 + bench), 12.0::double / count(*)) - 1 as benchmark_cagr,
      min(dd) as max_drawdown, (select avg((excess > 0)::integer::double) from v_rolling) as rolling_win_rate, (select median(excess) from v_rolling) as median_excess
    from (select *, w / max(w) over (order by month) - 1 as dd from (select *, product(1 + port) over (order by month) as w from v_both))""",
    "cagr", "benchmark_cagr", "max_drawdown", "rolling_win_rate", "median_excess")
_COMP_IC = spearman("(select * from v_ic_pairs where composite is not null)", "horizon, quarter_end", "composite", "fwd")
_BARG_IC = spearman("(select * from v_ic_pairs where bargain_score is not null)", "horizon, quarter_end", "bargain_score", "fwd")
final("information_coefficient", _COMP_IC, "ic")
_ICS = [f"ic_{h}" for h in HORIZONS]
final("horizon_ics", mean_ics(f"select *, 'composite' as score from ({_COMP_IC}) union all select *, 'bargain_score' as score from ({_BARG_IC})", "score"), *_ICS)


def backtest(scores: str, key: str, months: int = 36, returns: str = "v_monthly", bench: str = "v_bench") -> str:
    """Backtest of a table (key, quarter_end, ticker, composite): one row per key and window."""
    return f"""
      with sc as ({scores}),
      runs as (select {key}, v_windows.* from (select distinct {key} from sc) cross join v_windows),
      top as (select * from sc where composite is not null
        qualify row_number() over (partition by {key}, quarter_end order by composite desc, ticker)
          <= greatest(1, ceil(count(*) over (partition by {key}, quarter_end) * 0.2::double))),
      p as (select {key}, "window", month, avg(coalesce(ret, case when ticker in (select ticker from v_delisted) then -0.5::double end)) as port
        from (select {key}, "window", ticker, last_day(cast(date_trunc('month', quarter_end) + to_months(cast(k as integer)) as date)) as month
              from top join v_windows on quarter_end between w_start and w_end cross join (select unnest([1, 2, 3]) as k))
        left join {returns} using (ticker, month) group by all having count(ret) > 0),
      b as (select "window", month, bench from {bench} join v_windows on month between last_day(w_start)
              and last_day(cast(date_trunc('month', w_end) + interval 3 month as date))),
      roll as (select {key}, "window", product(1 + port) over w - product(1 + bench) over w as excess, count(*) over w as n
        from p join b using ("window", month) window w as (partition by {key}, "window" order by month rows between {months - 1} preceding and current row)),
      wins as (select {key}, "window", avg((excess > 0)::integer::double) as rolling_win_rate, median(excess) as median_excess from roll where n = {months} group by all),
      dd as (select {key}, "window", min(x) as max_drawdown, pow(product(1 + port), 12.0::double / count(*)) - 1 as cagr from (
          select *, w / max(w) over (partition by {key}, "window" order by month) - 1 as x from (
            select *, product(1 + port) over (partition by {key}, "window" order by month) as w from p)) group by all),
      bc as (select "window", pow(product(1 + bench), 12.0::double / count(*)) - 1 as benchmark_cagr from b group by all),
      pairs as (select {key}, quarter_end, horizon, composite, fwd from sc join (select quarter_end as qe, ticker, horizon, fwd from v_ic_pairs) f using (ticker)
        where f.qe = quarter_end and composite is not null),
      ic as ({spearman("pairs", f"{key}, horizon, quarter_end", "composite", "fwd")}),
      ics as (select {key}, "window", avg(ic) filter (horizon = '1q' and quarter_end < (select max(quarter_end) from v_pq where v_pq.quarter_end <= w_end)) as mean_ic,
          {", ".join(f"avg(ic) filter (horizon = '{h}') as ic_{h}" for h in HORIZONS)}
        from ic join v_windows on quarter_end between w_start and w_end group by all)
      select {key}, "window", coalesce(rolling_win_rate, 0) as rolling_win_rate, coalesce(median_excess, 0) as median_excess, coalesce(cagr, 0) as cagr,
        coalesce(benchmark_cagr, 0) as benchmark_cagr, coalesce(max_drawdown, 0) as max_drawdown, coalesce(mean_ic, 0) as mean_ic,
        {", ".join(f"coalesce(ic_{h}, 0) as ic_{h}" for h in HORIZONS)}
      from runs left join wins using ({key}, "window") left join dd using ({key}, "window") left join bc using ("window") left join ics using ({key}, "window")"""


_METRICS = ["rolling_win_rate", "median_excess", "cagr", "benchmark_cagr", "max_drawdown", "mean_ic", *_ICS]
final("run_backtest", f"select * exclude (run) from ({backtest("select 1 as run, quarter_end, ticker, composite from v_scored", "run")})", *_METRICS)

# Periodic investment
final("dca_wealth", """
    select 'buy_and_hold' as strategy, quarter_end, wealth from v_hold_path union all select 'rebalance', quarter_end, wealth from v_rebalance_path
    union all select 'benchmark', quarter_end, wealth from v_market_path""", "wealth")
_RESULT = ["terminal_wealth", "max_drawdown", "total_invested", "total_return", "cagr"]
for _n, _t in (("dca_buy_hold", "v_hold_result"), ("dca_rebalance", "v_rebalance_result"), ("dca_benchmark", "v_market_result")):
    final(_n, f"select * from {_t}", *_RESULT)
final("dca_holdings_log", "select quarter_end, string_agg(ticker, ',' order by ticker) as bought, 20000.0::double as invested from v_lots group by 1")


def _scenario(name: str, lo: float, bargain: float) -> str:
    return f"""
      {name}_picks as (select quarter_end, ticker from (select candidate, quarter_end, ticker, n.composite, bargain_score
          from v_named_scores n join v_panel using (quarter_end, ticker)) where candidate = '{dict(old="legacy_tuned", new="evidence_based")[name]}'
          and composite >= {lo} and bargain_score >= {bargain}
        qualify row_number() over (partition by quarter_end order by composite desc, bargain_score desc, ticker) <= 5),
      {name}_path as (select s.q, s.quarter_end, coalesce(sum(shares * g.price), 0) as wealth from v_pq s left join (
          (select q, ticker, amount / (price * 1.001::double) as shares from (select *, 20000.0::double / count(*) over (partition by quarter_end) as amount
             from {name}_picks) join v_grid using (ticker, quarter_end)) l
          join v_grid g on g.ticker = l.ticker and g.q >= l.q) on g.q = s.q group by 1, 2),
      {name}_result as ({dca_summary(f"{name}_path", f"select count(distinct quarter_end) from {name}_picks")})"""


_SCENARIOS = f"with {_scenario('old', 50, 50)}, {_scenario('new', 45, 40)}"
final("dca_sensitivity", _SCENARIOS + """
    select candidate, delist_return, r.terminal_wealth, r.total_return, r.cagr, m.terminal_wealth as spy_terminal_wealth, m.total_return as spy_total_return,
      m.cagr as spy_cagr, r.terminal_wealth - m.terminal_wealth as vs_spy_wealth_delta
    from (select 'old' as candidate, * from old_result union all select 'new', * from new_result) r cross join v_market_result m
    cross join (select unnest([0.0::double, -0.5::double, -1.0::double]) as delist_return)""",
    "terminal_wealth", "total_return", "cagr", "spy_terminal_wealth", "spy_total_return", "spy_cagr", "vs_spy_wealth_delta")


def _lost(name: str, loss: str, held: str) -> str:
    """Wealth path where a name without a price in 120 days counts at cost less a penalty. A lot ends by the strategy."""
    return f"""
      {name}_path as (
        select s.q, s.quarter_end, coalesce(h.held, 0) + coalesce((select sum(sold) from {held}_sold x where x.loss = {loss}::double and x.q <= s.q), 0) as wealth
        from v_pq s left join (select q, sum(coalesce(shares * price, cost * (1 + {loss}::double))) as held
          from (select l.q as q0, s2.q, l.ticker, l.shares, l.cost from {held} l join v_pq s2 on s2.q between l.q and l.until) left join fresh using (ticker, q) group by 1) h using (q))"""


_NAMES = {f"{k}{i}": (k, x) for k in ("hold", "swap") for i, x in enumerate(("0.0", "-0.5", "-1.0"))}
final("dca_delisting", """
    with fresh as (select t.ticker, v_pq.quarter_end, v_pq.q, close as price from (select distinct ticker from v_prices) t cross join v_pq
        asof join v_prices p on p.ticker = t.ticker and p.trade_date <= v_pq.quarter_end where date_diff('day', p.trade_date, v_pq.quarter_end) <= 120),
    last as (select max(q) as q from v_pq),
    bought as (select ticker, v_pq.q, 20000.0::double / count(*) over (partition by quarter_end) as amount from v_picks join v_pq using (quarter_end)),
    lots as (select b.ticker, b.q, case when price > 0 then amount / (price * 1.001::double) end as shares, case when price > 0 then amount end as cost
      from bought b left join fresh using (ticker, q)),
    spells as (select *, q - row_number() over (partition by ticker order by q) as spell from lots),
    hold as (select ticker, q, coalesce(lead(q) over w - 1, (select q from last)) as until, sum(shares) over w as shares, sum(cost) over w as cost
      from lots window w as (partition by ticker order by q)),
    swap as (select ticker, q, coalesce(lead(q) over w - 1, q) as until, lead(q) over w is null as open, sum(shares) over w as shares, sum(cost) over w as cost
      from spells window w as (partition by ticker, spell order by q)),
    hold_sold as (select 0.0::double as loss, 0 as q, 0.0::double as sold where false),
    swap_sold as (select loss, s.q + 1 as q, coalesce(shares * price, cost * (1 + loss)) * 0.999::double as sold
      from swap s cross join (select unnest([0.0::double, -0.5::double, -1.0::double]) as loss) left join fresh f on f.ticker = s.ticker and f.q = s.q + 1
      where open and s.q < (select q from last) and shares is not null),
    """ + ", ".join(_lost(n, x, k) for n, (k, x) in _NAMES.items()) + " select * from (" + " union all ".join(
    f"select '{dict(hold='buy_and_hold', swap='rebalance')[k]}' as strategy, {x}::double as delist_return, terminal_wealth, total_return, cagr, max_drawdown from ("
    + dca_summary(f"{n}_path", "select count(distinct quarter_end) from v_picks") + ")" for n, (k, x) in _NAMES.items()) + ")",
    "terminal_wealth", "total_return", "cagr", "max_drawdown")
final("dca_comparison", _SCENARIOS + """,
    pairs as (
      select 'old_vs_spy' as label, true as market, a.*, b.terminal_wealth as bw, b.total_return as br, b.cagr as bc from old_result a, v_market_result b
      union all select 'new_vs_spy', true, a.*, b.terminal_wealth, b.total_return, b.cagr from new_result a, v_market_result b
      union all select 'new_vs_old', false, a.*, b.terminal_wealth, b.total_return, b.cagr from new_result a, old_result b)
    select label, terminal_wealth - bw as terminal_wealth_delta, case when bw > 0 then (terminal_wealth - bw) / bw end as terminal_wealth_delta_pct,
      total_return - br as total_return_delta, cagr - bc as cagr_delta,
      case when market then total_return > br else terminal_wealth > bw end as beat_benchmark, total_return > br as beat_on_roi, terminal_wealth > bw as beat_on_wealth
    from pairs""", "terminal_wealth_delta", "terminal_wealth_delta_pct", "total_return_delta", "cagr_delta")


def fold_excess(picks: str, key: str, kind: str) -> str:
    """Fold excess of a pick table (key, quarter_end, ticker)."""
    return f"""
      select {key}, fold, roi - market as excess from (
        select {key}, fold, sum(coalesce(amount / (price * 1.001::double) * e.p, 0)) / sum(amount) - 1 as roi from (
          select {key}, f.fold, ticker, price, f.last, 20000.0::double / count(*) over (partition by {key}, quarter_end) as amount
          from ({picks}) join v_grid using (ticker, quarter_end)
          join (select *, max(q) over (partition by fold) as last from v_folds where kind = '{kind}') f using (quarter_end)) l
        left join (select ticker, q as last, price as p from v_grid) e using (ticker, last) group by all)
      join (select fold, avg(e.p / (b.price * 1.001::double)) - 1 as market from (select *, max(q) over (partition by fold) as last from v_folds where kind = '{kind}') f
        join v_grid b on b.ticker = 'SPY' and b.q = f.q join (select ticker, q as last, price as p from v_grid) e on e.ticker = 'SPY' and e.last = f.last group by fold)
      using (fold)"""


_PICKS = "select 1 as run, quarter_end, ticker from v_picks"
final("fold_excess", f"""
    select fold, excess, 'contiguous' as kind from ({fold_excess(_PICKS, "run", "contiguous")})
    union all select fold, excess, 'expanding' from ({fold_excess(_PICKS, "run", "expanding")})""", "excess")


def bootstrap(values: str, key: str) -> str:
    """Bootstrap interval of the mean per key of (key, v)."""
    return f"""
      (with val as ({values}),
      num as (select {key}, v, row_number() over (partition by {key} order by v) as i, count(*) over (partition by {key}) as n from val where v is not null),
      draw as (select {key}, n, rep, 1 + floor((((concat('0x', substr(md5(concat('42:', cast(rep as varchar), ':', cast(pos as varchar))), 1, 8)))::bigint
            + 0.5::double) / 4294967296.0::double) * n) as i
        from (select distinct {key}, n from num) cross join (select unnest(range(1000)) as rep) join (select unnest(range(1, 1001)) as pos) on pos <= n),
      means as (select {key}, rep, avg(v) as m from draw join num using ({key}, i) group by all)
      select {key}, n, mean, ci_low, ci_high from (select {key}, count(*) as n, avg(v) as mean from num group by all)
      join (select {key}, quantile_cont(m, 0.025) as ci_low, quantile_cont(m, 0.975) as ci_high from means group by all) using ({key}))"""


final("bootstrap_ci", "select n, mean, ci_low, ci_high from " + bootstrap("select 1 as run, round(port - bench, 9) as v from v_both", "run"), "mean", "ci_low", "ci_high")

_W = ("train", "valid", "test")
_SM = ("rolling_win_rate", "median_excess", "mean_ic", "cagr", "benchmark_cagr", "max_drawdown")
_WEIGHTS = [f"weight_{f}" for f in FAMILIES]
_WEIGHT_ROWS = "(select candidate, " + ", ".join(f"max(w) filter (family = '{f}') as weight_{f}" for f in FAMILIES) + " from v_search group by 1)"
final("weight_search", f"""
    with r as ({backtest("select candidate, quarter_end, ticker, composite from v_search_scores", "candidate", 12, "v_root_monthly", "v_root_bench")}),
    w as (select candidate, {", ".join(f"max({m}) filter ({chr(34)}window{chr(34)} = '{n}') as {n}_{m}" for n in _W for m in _SM)} from r group by 1),
    o as (select *, {significant("least(valid_median_excess, test_median_excess) - 0.5::double * greatest(0, valid_median_excess - test_median_excess)")} as robust_score,
        {significant("least(valid_rolling_win_rate, test_rolling_win_rate)")} as worst_win_rate, {significant("(valid_mean_ic + test_mean_ic) * 0.5::double")} as mean_ic from w),
    k as (select *, row_number() over (order by robust_score desc, worst_win_rate desc, mean_ic desc, candidate) as rank from o)
    select k.*, case when (select (a.robust_score, a.worst_win_rate, a.mean_ic) > (b.robust_score, b.worst_win_rate, b.mean_ic)
        from k a, k b where a.rank = 1 and b.candidate = 'baseline') then rank = 1 else candidate = 'baseline' end as is_winner, {", ".join(_WEIGHTS)} from k join {_WEIGHT_ROWS} using (candidate)""",
    *[f"{n}_{m}" for n in _W for m in _SM], "robust_score", "worst_win_rate", "mean_ic", *_WEIGHTS)
final("cv_search", f"""
    with e as ({fold_excess('''select candidate, quarter_end, ticker from v_search_scores where candidate = 'baseline' or try_cast(substr(candidate, 8) as integer) < 200
        qualify row_number() over (partition by candidate, quarter_end order by composite desc, ticker) <= 5''', "candidate", "contiguous")}),
    o as (select candidate, {significant("avg(excess) - stddev_pop(excess)")} as cv_score, {significant("min(excess)")} as worst_fold,
        {significant("avg((excess > 0)::integer::double)")} as frac_folds_positive, count(*) as folds from e group by 1),
    k as (select *, row_number() over (order by cv_score desc, worst_fold desc, frac_folds_positive desc, candidate) as rank from o)
    select k.*, case when (select (a.cv_score, a.worst_fold, a.frac_folds_positive) > (b.cv_score, b.worst_fold, b.frac_folds_positive)
        from k a, k b where a.rank = 1 and b.candidate = 'baseline') then rank = 1 else candidate = 'baseline' end as is_winner, {", ".join(_WEIGHTS)} from k join {_WEIGHT_ROWS} using (candidate)""",
    "cv_score", "worst_fold", "frac_folds_positive", *_WEIGHTS)
final("compare_candidates", f"""
    with sc as (select candidate, quarter_end, ticker, n.composite, bargain_score from v_named_scores n join v_panel using (quarter_end, ticker)),
    e as ({fold_excess('''select candidate, quarter_end, ticker from sc where composite >= 45 and bargain_score >= 40
        qualify row_number() over (partition by candidate, quarter_end order by composite desc, ticker) <= 5''', "candidate", "expanding")}),
    ci as (select * from {bootstrap("select candidate, excess as v from e", "candidate")}),
    pairs as (select candidate, quarter_end, horizon, sc.composite, fwd from sc join (select quarter_end as qe, ticker, horizon, fwd from v_ic_pairs) f using (ticker) where qe = quarter_end),
    ics as ({mean_ics(spearman("pairs", "candidate, horizon, quarter_end", "composite", "fwd"), "candidate")}),
    r as (select candidate, {", ".join(f"coalesce(ic_{h}, 0) as ic_{h}" for h in HORIZONS)}, coalesce(n, 0) as folds, mean as excess_mean, ci_low as excess_ci_low,
        ci_high as excess_ci_high, coalesce((select avg((excess > 0)::integer::double) from e where e.candidate = ics.candidate), 0) as frac_folds_positive,
        coalesce(ic_3y, 0) as primary_ic from ics left join ci using (candidate)),
    k as (select *, row_number() over (order by {significant("excess_mean")} desc nulls last, list_position(['evidence_based', 'legacy_tuned', 'equal'], candidate)) as rank from r),
    o as (select k.*, coalesce(t.excess_ci_low <= k.excess_ci_high and k.excess_ci_low <= t.excess_ci_high, false) as indistinguishable from k, k t where t.rank = 1)
    select *, case when (select indistinguishable from o where candidate = 'evidence_based') then candidate = 'evidence_based' else rank = 1 end as recommended from o""",
    *_ICS, "excess_mean", "excess_ci_low", "excess_ci_high", "frac_folds_positive", "primary_ic")
final("bargain_validation", f"""
    with sc as ({_REWEIGHTED}),
    pairs as (select candidate, quarter_end, horizon, sc.bargain_score, fwd from sc join (select quarter_end as qe, ticker, horizon, fwd from v_ic_pairs) f using (ticker)
      where qe = quarter_end and sc.bargain_score is not null),
    r as (select *, ic_3y as primary_ic from ({mean_ics(spearman("pairs", "candidate, horizon, quarter_end", "bargain_score", "fwd"), "candidate")})),
    b as (select *, row_number() over (order by {significant("primary_ic")} desc, list_position(['default_long_horizon', 'graham_heavy', 'equal'], candidate)) = 1 as best from r)
    select * exclude (best), case when (select max(primary_ic) filter (best) - max(primary_ic) filter (candidate = 'default_long_horizon') from b) < 0.01
      then candidate = 'default_long_horizon' else best end as is_winner from b""", *_ICS, "primary_ic")


def buckets(score: str) -> str:
    return f"""
      select quarter_end, (greatest(len([x for x in edges if x < {score}]) - 1, 0))::bigint as bucket, min({score}) as score_min, max({score}) as score_max,
        avg(excess_3y) as mean_fwd_return, count(*) as n, '{score}' as score
      from v_scored join (select quarter_end, list_distinct(quantile_cont({score}, [{", ".join(f"{i / 10!r}::double" for i in range(11))}])) as edges from v_scored
        where {score} is not null group by 1 having count(*) >= 30) using (quarter_end)
      join v_fwd f using (ticker) where f.as_of_quarter = quarter_end and excess_3y is not null and {score} is not null and len(edges) > 1 group by 1, 2"""


final("score_buckets", buckets("composite") + " union all " + buckets("bargain_score"), "score_min", "score_max", "mean_fwd_return")


def _threshold(score: str) -> str:
    return f"""
      (with a as (select bucket, avg(score_min) as lo, avg(mean_fwd_return) as ret from ({buckets(score)}) group by 1),
      t as (select min(bucket) filter (ret > 0) as first, max(bucket) as last from a)
      select least(greatest(coalesce((select lo from a, t where first is not null and bucket = least(greatest(7, first), last)), 50), 30), 80))"""


final("calibrate_thresholds", f"""
    select '3y' as horizon, 'excess_3y' as return_column, {_threshold("composite")} as composite_min, {_threshold("bargain_score")} as bargain_min""",
    "composite_min", "bargain_min")
