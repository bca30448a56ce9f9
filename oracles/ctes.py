"""Named expressions. Names start with ``v_`` so that a plain word search finds the references."""

from __future__ import annotations

# Coefficients of W. J. Cody's rational approximations of erf (1969).
_A = "3.16112374387056560e00 1.13864154151050156e02 3.77485237685302021e02 3.20937758913846947e03 1.85777706184603153e-1".split()
_B = "2.36012909523441209e01 2.44024637934444173e02 1.28261652607737228e03 2.84423683343917062e03".split()
_C = ("5.64188496988670089e-1 8.88314979438837594e0 6.61191906371416295e01 2.98635138197400131e02 8.81952221241769090e02 "
      "1.71204761263407058e03 2.05107837782607147e03 1.23033935479799725e03 2.15311535474403846e-8").split()
_D = ("1.57449261107098347e01 1.17693950891312499e02 5.37181101862009858e02 1.62138957456669019e03 3.29079923573345963e03 "
      "4.36261909014324716e03 3.43936767414372164e03 1.23033935480374942e03").split()
_P = ("3.05326634961232344e-1 3.60344899949804439e-1 1.25781726111229246e-1 1.60837851487422766e-2 6.58749161529837803e-4 "
      "1.63153871373020978e-2").split()
_Q = "2.56852019228982242e00 1.87295284992346725e00 5.27905102951428412e-1 6.05183413124413191e-2 2.33520497626869185e-3".split()


def _poly(x: str, lead: str, rest: list[str]) -> str:
    text = f"({lead}*{x})"
    for a in rest[:-1]:
        text = f"(({text}+{a})*{x})"
    return f"({text}+{rest[-1]})"


def phi(z: str) -> str:
    """Standard normal distribution function of a SQL expression."""
    x = f"({z}/sqrt(2.0::double))"
    y, z2 = f"abs{x}", f"({x}*{x})"
    small = f"{x}*{_poly(z2, _A[4], _A[:4])}/{_poly(z2, '1e0', _B)}"
    mid = f"sign{x}*(1-exp(-{z2})*{_poly(y, _C[8], _C[:8])}/{_poly(y, '1e0', _D)})"
    w = f"(1/nullif({z2},0))"
    far = f"sign{x}*(1-exp(-{z2})*(0.56418958354775628695e0-{w}*{_poly(w, _P[5], _P[:5])}/{_poly(w, '1e0', _Q)})/nullif({y},0))"
    return f"(0.5e0*(1+case when {y}<=0.46875 then {small} when {y}<=4 then {mid} else {far} end))"


FAMILIES = {
    "value": ["earnings_yield", "fcf_yield", "book_to_market", "graham_ratio"],
    "garp": ["garp"],
    "quality": ["gross_profitability", "roe", "roa", "profit_margin", "roic", "earnings_quality", "financial_strength"],
    "balance_sheet": ["net_cash_to_mcap", "low_leverage", "altman_z"],
    "momentum": ["momentum_12_1"],
    "low_volatility": ["low_volatility"],
    "capital_discipline": ["shareholder_yield", "investment"],
}
LIVE_FAMILIES = {**FAMILIES, "earnings_revisions": ["earnings_revisions"]}
SIGNALS = [s for f in FAMILIES.values() for s in f]
EVIDENCE = {"value": 0.25, "garp": 0.10, "quality": 0.25, "balance_sheet": 0.10, "momentum": 0.075,
            "low_volatility": 0.05, "capital_discipline": 0.125}
LEGACY = {"value": 0.0286, "garp": 0.4131, "quality": 0.1042, "balance_sheet": 0.1365, "momentum": 0.0688,
          "low_volatility": 0.1321, "capital_discipline": 0.0667}


def _values(rows: list[tuple], names: str) -> str:
    def lit(v: object) -> str:
        return f"'{v}'" if isinstance(v, str) else f"{v!r}::double" if isinstance(v, float) else str(v)

    return f"select * from (values {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) t({names})"


def _signal_rows(families: dict[str, list[str]]) -> list[tuple]:
    signals = [(f, s) for f, ss in families.items() for s in ss]
    return [(f, s, i, float({**EVIDENCE, "earnings_revisions": 0.05}[f])) for i, (f, s) in enumerate(signals)]


def _long(source: str, keys: str, signals: list[str]) -> str:
    return " union all ".join(f"select {keys}, '{s}' as signal, {s} as v from {source}" for s in signals)


def _zscores(long: str, key: str) -> dict[str, str]:
    """z-scores of a long table (key, ticker, sector, signal, v): whole cross-section and by sector."""
    z = f"v_z_{long[2:]}"
    return {
        f"{z}_w": f"""
            select l.*, case when v is not null then least(greatest(v, lo), hi) end as w from {long} l left join
              (select {key}, signal, quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.99) as hi from {long} where v is not null group by all) b
              using ({key}, signal)""",
        f"{z}_u": f"""
            select {key}, signal, count(w) as n, avg(w) as m, case when min(w) = max(w) then 0 else stddev_samp(w) end as s
            from {z}_w group by all""",
        f"{z}_b": f"""
            select {key}, sector, signal, quantile_cont(w, 0.01) as lo, quantile_cont(w, 0.99) as hi
            from {z}_w where w is not null and sector is not null group by all having count(*) >= 5""",
        f"{z}_s": f"""
            select {key}, sector, signal, avg(x) as m, case when min(x) = max(x) then 0 else stddev_samp(x) end as s
            from (select {key}, sector, signal, least(greatest(w, lo), hi) as x from {z}_w join {z}_b using ({key}, sector, signal) where w is not null)
            group by all""",
        z: f"""
            select {key}, ticker, signal,
              case when u.n >= 3 then case when u.s = 0 then 0 else (w - u.m) / u.s end end as zu,
              coalesce(case when s.s = 0 then 0 when s.s is not null then (case when w is not null then least(greatest(w, b.lo), b.hi) end - s.m) / s.s end,
                       case when w is not null and u.n >= 3 then case when u.s = 0 then 0 else (w - u.m) / u.s end end) as z
            from {z}_w
            left join {z}_u u using ({key}, signal) left join {z}_b b using ({key}, sector, signal) left join {z}_s s using ({key}, sector, signal)""",
    }


def _metrics(slice_: str) -> str:
    """Price metrics of a table of trailing closes (quarter_end, ticker, close, rn, back)."""
    return """
        with y as (
          select *, close / lag(close) over w - 1 as r, close / max(close) over (w rows unbounded preceding) - 1 as dd
          from v_slice where back <= 252 window w as (partition by quarter_end, ticker order by rn)),
        yearly as (
          select quarter_end, ticker, max(close) as high, min(close) as low,
            case when count(*) >= 60 then stddev_samp(r) * sqrt(252.0::double) end as vol,
            case when count(*) >= 60 then min(dd) end as mdd,
            case when count(*) >= 60 then case when count(*) filter (r < 0) = 0 then 0 else stddev_samp(r) filter (r < 0) * sqrt(252.0::double) end end as down
          from y group by 1, 2),
        d as (
          select *, close - lag(close) over w as chg, row_number() over w as pos, count(*) over (partition by quarter_end, ticker) as n
          from v_slice window w as (partition by quarter_end, ticker order by rn)),
        ew as (
          select quarter_end, ticker, max(n) as n,
            sum(greatest(chg, 0) * wt) as gain, sum(greatest(-chg, 0) * wt) as loss
          from (select *, case when pos = 2 then pow(13.0::double / 14, n - 2) else pow(13.0::double / 14, n - pos) / 14 end as wt from d where pos >= 2)
          group by 1, 2),
        whole as (
          select quarter_end, ticker, max(close) filter (back = 1) as price, max(close) as ath, count(*) as n,
            max(close) filter (back = 22) as e, max(close) filter (back = 252) as s
          from v_slice group by 1, 2)
        select quarter_end, ticker, price, case when s > 0 then e / s - 1 end as momentum_12_1, vol as volatility_12m, mdd as max_drawdown,
          down as downside_deviation,
          case when ew.n >= 15 then case when loss = 0 then case when gain > 0 then 100 else 50 end else 100 - 100 / (1 + gain / loss) end end as rsi_14,
          high as fifty_two_week_high, low as fifty_two_week_low, ath as all_time_high
        from whole join yearly using (quarter_end, ticker) left join ew using (quarter_end, ticker)""".replace("v_slice", slice_)


def _factors(raw: str) -> str:
    """Factor formulas over a table of inputs."""
    return """
        with a as (
          select *, case when trailing_eps > 0 and book_value > 0 then sqrt(22.5 * trailing_eps * book_value) end as graham_fair_value,
            case when abs(earnings_growth) > 1 then earnings_growth else earnings_growth * 100 end as g,
            case when abs(dividend_yield) > 1 then dividend_yield else dividend_yield * 100 end as dy,
            case when total_assets > 0 then total_assets end as ta, book_value * shares_outstanding as eq,
            -repurchase_of_stock as bb,
            nullif(total_assets, 0) as ta0, nullif(total_assets_prior, 0) as tap, nullif(current_assets, 0) / nullif(current_liabilities, 0) as cr,
            nullif(current_assets_prior, 0) / nullif(current_liabilities_prior, 0) as crp,
            case when revenue > 0 then revenue end as sa, case when revenue_prior > 0 then revenue_prior end as sap
          from v_raw),
        b as (
          select *,
            [net_income / ta > 0, operating_cashflow > 0, net_income / ta0 > net_income_prior / tap, operating_cashflow > net_income,
             long_term_debt / ta0 <= long_term_debt_prior / tap, cr >= crp, shares_outstanding <= shares_outstanding_prior,
             nullif(gross_profit, 0) / sa >= nullif(gross_profit_prior, 0) / sap,
             nullif(revenue, 0) / ta0 >= nullif(revenue_prior, 0) / tap] as tests,
            case when market_cap > 0 and (dividends_paid is not null or bb > 0) then abs(coalesce(dividends_paid, 0)) + case when bb > 0 then bb else 0 end end as returned,
            case when market_cap > 0 and (dividends_paid is not null or -bb > 0) then abs(coalesce(dividends_paid, 0)) + case when -bb > 0 then -bb else 0 end end as returned_as_payment,
            case when total_debt + eq is not null then greatest(total_debt + eq - coalesce(total_cash, 0), abs(eq) * 0.01, 1.0) end as invested_capital,
            case when trailing_pe > 0 and (g > 0 or dy > 0) then (case when g > 0 then g else 0 end + case when dy > 0 then dy else 0 end) / trailing_pe end as dividend_adjusted_peg,
            coalesce(case when trailing_pe > 0 and g > 0 then trailing_pe / g end, trailing_peg_ratio) as peg_ratio,
            [1.2 * (current_assets - current_liabilities) / ta, 1.4 * retained_earnings / ta, 3.3 * ebit / ta,
             case when ta is not null and total_liabilities > 0 then 0.6 * market_cap / total_liabilities end, 1.0 * revenue / ta] as zs
          from a)
        select *, ebit / nullif(enterprise_value, 0) as earnings_yield, cast(null as double) as fcf_yield, eq / nullif(market_cap, 0) as book_to_market,
          graham_fair_value / nullif(price, 0) as graham_ratio,
          coalesce(current_ratio_info, case when current_liabilities > 0 then nullif(current_assets, 0) / current_liabilities end) as current_ratio,
          coalesce(dividend_adjusted_peg, case when peg_ratio > 0 then 1 / peg_ratio end) as garp,
          gross_profit / nullif(total_assets, 0) as gross_profitability, net_income / nullif(eq, 0) as roe,
          net_income / nullif(total_assets, 0) as roa, net_income / nullif(revenue, 0) as profit_margin,
          ebit / invested_capital as roic, (net_income - operating_cashflow) / ta as accruals, -(net_income - operating_cashflow) / ta as earnings_quality,
          list_sum([cast(t as integer) for t in tests if t is not null]) as passed, len([t for t in tests if t is not null]) as checks,
          total_cash - total_debt as net_cash, (total_cash - total_debt) / nullif(market_cap, 0) as net_cash_to_mcap,
          case when debt_to_equity <= 0 then 1 when debt_to_equity > 0 then 1 / (1 + debt_to_equity) end as low_leverage,
          list_sum([x for x in zs if x is not null]) * 7.5 / nullif(
            case when zs[1] is not null then 1.2 else 0 end + case when zs[2] is not null then 1.4 else 0 end + case when zs[3] is not null then 3.3 else 0 end
            + case when zs[4] is not null then 0.6 else 0 end + case when zs[5] is not null then 1.0 else 0 end, 0)::double as altman_z,
          case when volatility_12m > 0 then 1 / volatility_12m end as low_volatility,
          returned / nullif(market_cap, 0) as shareholder_yield, returned_as_payment / nullif(market_cap, 0) as payment_yield,
          total_assets / nullif(total_assets_prior, 0) - 1 as asset_growth, -(total_assets / nullif(total_assets_prior, 0) - 1) as investment,
          case when max_drawdown is null then 1 / (1 + downside_deviation) when downside_deviation is null then -max_drawdown
               else (-max_drawdown + 1 / (1 + downside_deviation)) / 2 end as downside_protection
        from b""".replace("v_raw", raw)


CTES: dict[str, str] = {
    "v_trades": """
        select l_suppkey as k, concat('S', cast(l_suppkey as varchar)) as ticker, cast(l_shipdate as date) as trade_date,
               cast(l_extendedprice as decimal(18,2)) as px, cast(l_quantity as decimal(18,2)) as qty from lineitem""",
    "v_prices": """
        select ticker, trade_date, cast(sum(px) as double) / cast(sum(qty) as double) as close from v_trades group by 1, 2
        union all
        select 'SPY', trade_date, cast(sum(px) as double) / cast(sum(qty) as double) from v_trades group by trade_date""",
    "v_universe": """
        select concat('S', cast(s_suppkey as varchar)) as ticker, s_suppkey as k, s_name as name, r_name as sector, n_name as industry,
               case when s_suppkey % 20 = 0 then 'ETF' else 'EQUITY' end as quote_type, s_acctbal as bal
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "v_fundamentals": """
        with li as (
          select concat('S', cast(l_suppkey as varchar)) as ticker, l_suppkey,
                 last_day(cast(date_trunc('quarter', l_shipdate) + interval 2 month as date)) as period,
                 cast(l_extendedprice as decimal(18,2)) as px, cast(l_discount as decimal(6,2)) as disc, cast(l_tax as decimal(6,2)) as tax,
                 cast(l_quantity as decimal(18,2)) as qty, cast(p_retailprice as decimal(18,2)) as cost, l_returnflag as rf, l_linestatus as ls
          from lineitem join part on l_partkey = p_partkey),
        w as (
          select ticker, l_suppkey, period,
            cast(sum(px) as double) as total_assets,
            cast(sum(case when ls = 'O' then px else 0 end) as double) as total_liabilities,
            cast(sum(case when ls = 'F' then px else 0 end) as double) as current_assets,
            cast(sum(case when rf = 'R' then px else 0 end) as double) as current_liabilities,
            cast(sum(case when ls = 'O' and rf = 'R' then px else 0 end) as double) as long_term_debt,
            cast(sum(qty) as double) as shares_outstanding,
            cast(sum(px * (1 - disc)) - sum(qty * cost) as double) as gross_profit,
            cast(sum(px * (1 - disc)) - sum(qty * cost) - sum(px * tax) - sum(case when rf = 'N' then px else 0 end) as double) as net_income,
            cast(sum(px * (1 - disc)) - sum(qty * cost) - sum(px * tax) as double) as ebit,
            cast(sum(px * (1 - disc)) as double) as revenue,
            cast(sum(case when ls = 'F' then px * (1 - disc) - qty * cost else 0 end) as double) as operating_cashflow,
            cast(sum(px * disc) as double) as dividends_paid,
            cast(-sum(px * tax) as double) as repurchase_of_stock,
            cast(sum(case when rf = 'N' then px else 0 end) as double) as retained_earnings,
            cast(sum(case when rf = 'A' and ls = 'F' then px else 0 end) as double) as total_cash,
            cast(sum(case when ls = 'F' then px else 0 end) as double) as book_equity
          from li group by ticker, l_suppkey, period),
        u as (select * from w unpivot (amount for field in (total_assets, total_liabilities, current_assets, current_liabilities,
              long_term_debt, shares_outstanding, gross_profit, net_income, ebit, revenue, operating_cashflow, dividends_paid,
              repurchase_of_stock, retained_earnings, total_cash, book_equity)))
        select ticker, field, amount, period, cast(period + interval 45 day as date) as filed from u
        union all
        select ticker, field, amount * 1.0625::double, period, cast(period + interval 150 day as date) from u where l_suppkey % 5 = 0""",
    "v_list": """
        select cast(date_trunc('month', l_shipdate) as date) as day,
               case when l_suppkey % 7 = 0 then concat('S', cast(l_suppkey as varchar), '-B') else concat('S', cast(l_suppkey as varchar)) end as ticker
        from lineitem group by 1, 2 having sum(l_quantity) >= 150""",
    "v_quarters": """
        select last_day(cast(d as date)) as quarter_end
        from (select unnest(generate_series(timestamp '1995-03-01', timestamp '2001-12-01', interval 3 month)) as d)""",
    "v_members": """
        select quarter_end, ticker, day as snapshot_date
        from (select quarter_end, max(day) as day from v_quarters join (select distinct day from v_list) on day <= quarter_end group by 1)
        join v_list using (day)""",
    "v_delisted": """
        select distinct ticker from (select ticker from v_members union all select 'SPY') where ticker not in (select ticker from v_prices)""",
    "v_recs": """
        select concat('S', cast(user_id as varchar)) as ticker,
          case when ts >= timestamp '2024-01-16 00:00:00' then '0m' else '-1m' end as period,
          sum(case when event_type = 'signup' then 1 else 0 end) as sb, sum(case when event_type = 'purchase' then 1 else 0 end) as b,
          sum(case when event_type = 'view' then 1 else 0 end) as h, sum(case when event_type = 'click' then 1 else 0 end) as s,
          sum(case when event_type = 'error' then 1 else 0 end) as ss
        from events group by 1, 2""",
    "v_actions": """
        select event_id as seq, concat('S', cast(user_id as varchar)) as ticker, cast(ts as date) as day,
          case event_type when 'signup' then 'Strong Buy' when 'purchase' then 'Outperform' when 'view' then 'Hold'
               when 'click' then 'Underperform' else 'Sell' end as grade,
          case when value < 20 then 'down' when value > 60 then 'up' else 'main' end as action,
          row_number() over (partition by user_id order by event_id desc) as back
        from events""",
    "v_filed": """
        with sub as (
          select o_orderkey as adsh, o_custkey as cik,
            case o_orderpriority when '1-URGENT' then '10-K' when '2-HIGH' then '10-K/A' when '3-MEDIUM' then '10-Q'
                 when '4-NOT SPECIFIED' then '8-K' else '10-Q/A' end as form,
            last_day(cast(date_trunc('quarter', o_orderdate) + interval 2 month as date)) as period,
            cast(o_orderdate + interval 120 day as date) as filed
          from orders)
        select cik, concat('C', cast(cik as varchar)) as ticker, adsh, form, period, filed, cast(l_shipdate as date) as ddate,
          l_partkey % 5 as qtrs, l_extendedprice as amount,
          concat(cast(year(filed) as varchar), 'q', cast(quarter(filed) as varchar)) as dataset_quarter,
          case l_linenumber when 1 then 'Assets' when 2 then 'Revenues' when 3 then 'SalesRevenueNet' when 4 then 'NetIncomeLoss'
               when 5 then 'LongTermDebt' when 6 then 'LongTermDebtNoncurrent' end as tag,
          case l_linenumber when 1 then 'total_assets' when 2 then 'revenue' when 3 then 'revenue' when 4 then 'net_income'
               when 5 then 'long_term_debt' when 6 then 'long_term_debt' end as field,
          case when l_partkey % 5 in (1, 4) then 0 else 1 end as instant
        from lineitem join sub on l_orderkey = adsh
        where form <> '8-K' and l_linenumber <= 6 and cik in (select c_custkey from customer where c_custkey % 4 <> 0)""",
    "v_statements": """
        with f as (
          select l_suppkey as k, last_day(cast(date_trunc('quarter', l_shipdate) + interval 2 month as date)) as period,
                 cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as assets,
                 cast(sum(case when l_returnflag = 'A' then cast(l_extendedprice as decimal(18,2)) end) as double) as ebit,
                 cast(sum(case when l_linestatus = 'F' then cast(l_extendedprice as decimal(18,2)) end) as double) as sales,
                 cast(sum(case when l_linenumber = 1 then cast(l_extendedprice as decimal(18,2)) end) as double) as debt
          from lineitem group by 1, 2)
        select concat('S', cast(k as varchar)) as ticker, period, metric, field, prio, value from f, lateral (values
          ('Total Assets', 'total_assets', 0, assets),
          ('EBIT', 'ebit', 0, case when k % 3 <> 0 then ebit end),
          ('Operating Income', 'ebit', 1, ebit * 0.5::double),
          ('Operating Income', 'operating_income', 0, ebit * 0.5::double),
          (case when k % 2 = 0 then 'Total Revenue' else 'Operating Revenue' end, 'revenue', cast(k % 2 as integer), sales),
          ('Long Term Debt', 'long_term_debt', 0, case when k % 4 <> 0 then debt end),
          ('Long Term Debt And Capital Lease Obligation', 'long_term_debt', 1, debt * 2.0::double)) t(metric, field, prio, value)""",
    "v_statement_values": """
        with present as (select *, row_number() over (partition by ticker, field, prio order by period desc) as rn from v_statements where value is not null),
        best as (select ticker, field, min(prio) as prio from present group by 1, 2)
        select ticker, field, max(metric) as metric, max(value) filter (rn = 1) as latest, max(value) filter (rn = 2) as prior,
               max(period) < any_value(newest) as stale
        from present join best using (ticker, field, prio) join (select ticker, max(period) as newest from v_statements group by 1) using (ticker)
        group by ticker, field""",
    # Trailing closes -----------------------------------------------------------------------------
    "v_numbered": "select *, row_number() over (partition by ticker order by trade_date) as rn from v_prices",
    "v_slice": """
        select quarter_end, ticker, close, rn, rnq - rn + 1 as back
        from (select m.quarter_end, ticker, max(rn) as rnq from v_members m join v_numbered using (ticker) where trade_date <= quarter_end group by 1, 2)
        join v_numbered using (ticker) where rn between rnq - 399 and rnq""",
    "v_metrics": _metrics("v_slice"),
    # Point-in-time fundamentals ----------------------------------------------------------------------
    "v_known": """
        select quarter_end, ticker, field, amount, dense_rank() over (p order by period desc) as pr,
               row_number() over (partition by quarter_end, ticker, field, period order by filed desc) as fr
        from (select distinct quarter_end, ticker from v_members) join v_fundamentals using (ticker) where filed <= quarter_end
        window p as (partition by quarter_end, ticker, field)""",
    "v_pit": "select quarter_end, ticker, "
    + ", ".join(
        f"max(amount) filter (field = '{f}' and pr = 1 and fr = 1) as {f}, max(amount) filter (field = '{f}' and pr = 2 and fr = 1) as {f}_prior"
        for f in (
            "total_assets", "total_liabilities", "current_assets", "current_liabilities", "long_term_debt", "shares_outstanding",
            "gross_profit", "net_income", "ebit", "revenue", "operating_cashflow", "dividends_paid", "repurchase_of_stock",
            "retained_earnings", "total_cash", "book_equity",
        )
    )
    + ", book_equity / nullif(shares_outstanding, 0) as book_value, long_term_debt as total_debt from v_known group by 1, 2",
    "v_raw": """
        with a as (
          select m.*, f.* exclude (quarter_end, ticker), nullif(price, 0) * nullif(shares_outstanding, 0) as market_cap,
            net_income / nullif(shares_outstanding, 0) as trailing_eps, net_income / nullif(net_income_prior, 0) - 1 as earnings_growth,
            case when current_liabilities > 0 then current_assets / current_liabilities end as current_ratio_info,
            total_debt / nullif(book_equity, 0) * 100 as lev
          from v_metrics m left join v_pit f using (quarter_end, ticker))
        select *, case when abs(lev) > 10 then lev / 100 else lev end as debt_to_equity, cast(null as double) as trailing_peg_ratio,
          market_cap + coalesce(total_debt, 0) - coalesce(total_cash, 0) as enterprise_value,
          case when trailing_eps > 0 then nullif(price, 0) / trailing_eps end as trailing_pe,
          case when market_cap > 0 then abs(dividends_paid) / market_cap end as dividend_yield
        from a""",
    "v_factors": _factors("v_raw"),
    "v_panel": """
        with f as (select *, passed * 9.0::double / nullif(checks, 0) as financial_strength from v_factors),
        h as (
          select f.*, sector, list(earnings_yield) filter (earnings_yield is not null) over (partition by ticker order by quarter_end rows between 20 preceding and 1 preceding) as past
          from f left join v_universe u using (ticker)),
        v as (
          select * exclude (past), case when earnings_yield is not null and len(past) >= 4 then
              100.0::double * len([x for x in past if x <= earnings_yield]) / len(past) end as valuation_vs_history,
            case when graham_ratio > 0 then least(100, greatest(0, (graham_ratio - 0.30::double) / (1.30::double - 0.30::double) * 100)) end as b_mos,
            case when fifty_two_week_high > 0 and price > 0 then least(100, greatest(0, (1 - price / fifty_two_week_high) / 0.30::double * 100)) end as b_52w
          from h)
        select *, round((coalesce(b_mos * 0.40::double, 0) + coalesce(valuation_vs_history * 0.35::double, 0) + coalesce(b_52w * 0.25::double, 0)) / nullif(
            (case when b_mos is null then 0 else 0.40::double end + case when valuation_vs_history is null then 0 else 0.35::double end
             + case when b_52w is null then 0 else 0.25::double end), 0), 9) as bargain_score
        from v""",
    # Scores ------------------------------------------------------------------------------------------
    "v_signals": _values(_signal_rows(FAMILIES), "family, signal, pos, weight"),
    "v_long": _long("v_panel", "quarter_end, ticker, sector", SIGNALS),
    **_zscores("v_long", "quarter_end"),
    "v_fam": f"""
        select quarter_end, ticker, family, avg(100 * {phi("z")}) as pct from v_z_long join v_signals using (signal)
        where z is not null group by all""",
    "v_pct": "select quarter_end, ticker, "
    + ", ".join(f"max(pct) filter (family = '{f}') as pct_{f}" for f in FAMILIES)
    + ", from v_panel p left join v_fam using (quarter_end, ticker) group by 1, 2",
    "v_evidence": _values([(f, w) for f, w in EVIDENCE.items()], "family, w"),
    "v_comp": """
        select quarter_end, ticker, round(sum(pct * w) / sum(w), 9) as composite, sum(w) / 0.95::double * 100 as factor_coverage_pct
        from v_fam join v_evidence using (family) group by 1, 2""",
    "v_scored": "select * from v_panel left join v_comp using (quarter_end, ticker) left join v_pct using (quarter_end, ticker)",
    "v_named": _values(
        [("evidence_based", f, w) for f, w in EVIDENCE.items()] + [("legacy_tuned", f, w) for f, w in LEGACY.items()]
        + [("equal", f, 0.125) for f in FAMILIES],
        "candidate, family, w",
    ),
    "v_search": """
        with d as (
          select i, family, -ln(((concat('0x', substr(md5(concat('42:', cast(i as varchar), ':', family)), 1, 8)))::bigint + 0.5::double) / 4294967296.0::double) as e
          from (select unnest(range(500)) as i) cross join (select distinct family from v_signals))
        select concat('sample_', cast(i as varchar)) as candidate, family, e / sum(e) over (partition by i) as w from d
        union all select 'baseline', family, w from v_evidence""",
    "v_named_scores": """
        select candidate, quarter_end, ticker, round(sum(pct * w) / sum(w), 9) as composite from v_fam join v_named using (family) group by all""",
    "v_search_scores": """
        select candidate, quarter_end, ticker, round(sum(pct * w) / sum(w), 9) as composite from v_fam join v_search using (family) group by all""",
    # Returns -------------------------------------------------------------------------------------------
    "v_pq": "select quarter_end, row_number() over (order by quarter_end) - 1 as q from (select distinct quarter_end from v_panel)",
    "v_grid": """
        select t.ticker, quarter_end, q, close as price
        from (select distinct ticker from v_prices) t cross join v_pq asof join v_prices p on p.ticker = t.ticker and p.trade_date <= v_pq.quarter_end""",
    "v_fwd": """
        with g as (select a.ticker, a.q, a.quarter_end, a.price,
            max(b.price) filter (b.q = a.q + 1) / a.price - 1 as f1, max(b.price) filter (b.q = a.q + 4) / a.price - 1 as f4,
            max(b.price) filter (b.q = a.q + 12) / a.price - 1 as f12, max(b.price) filter (b.q = a.q + 20) / a.price - 1 as f20
          from v_grid a left join v_grid b on a.ticker = b.ticker and b.q in (a.q + 1, a.q + 4, a.q + 12, a.q + 20) and b.price > 0
          where a.price > 0 group by a.ticker, a.q, a.quarter_end, a.price)
        select g.quarter_end as as_of_quarter, g.ticker, g.q, g.f1 as fwd_1q, g.f4 as fwd_1y, g.f12 as fwd_3y, g.f20 as fwd_5y,
          g.f1 - m.f1 as excess_1q, g.f4 - m.f4 as excess_1y, g.f12 - m.f12 as excess_3y, g.f20 - m.f20 as excess_5y
        from g left join g m on m.ticker = 'SPY' and m.q = g.q
        where g.ticker <> 'SPY' and g.ticker in (select ticker from v_panel)""",
    "v_monthly": """
        with m as (select ticker, last_day(trade_date) as month, arg_max(close, trade_date) as close from v_prices group by 1, 2),
        s as (select ticker, last_day(cast(d as date)) as month from (
          select ticker, unnest(generate_series(date_trunc('month', min(month))::timestamp, max(month)::timestamp, interval 1 month)) as d from m group by ticker)),
        f as (select ticker, month, last_value(close ignore nulls) over (partition by ticker order by month) as c from s left join m using (ticker, month))
        select * from (select ticker, month, c / nullif(lag(c) over (partition by ticker order by month), 0) - 1 as ret from f) where ret is not null""",
    "v_root_monthly": "select * replace (pow(ret + 1, 0.05::double) - 1 as ret) from v_monthly",
    "v_root_bench": "select month, ret as bench from v_root_monthly where ticker = 'SPY'",
    "v_bench": "select month, ret as bench from v_monthly where ticker = 'SPY'",
    "v_quintile": """
        select quarter_end, ticker, composite from v_scored where composite is not null
        qualify row_number() over (partition by quarter_end order by composite desc, ticker) <= greatest(1, ceil(count(*) over (partition by quarter_end) * 0.2::double))""",
    "v_held": """
        select p.quarter_end, p.ticker, last_day(cast(date_trunc('month', quarter_end) + to_months(cast(k as integer)) as date)) as month
        from v_quintile p cross join (select unnest([1, 2, 3]) as k)""",
    "v_port": """
        select month, avg(coalesce(ret, case when ticker in (select ticker from v_delisted) then -0.5::double end)) as port
        from v_held left join v_monthly using (ticker, month) group by month having count(ret) > 0""",
    "v_both": "select month, port, bench from v_port join v_bench using (month)",
    "v_rolling": """
        select month, excess from (
          select month, product(1 + port) over w - product(1 + bench) over w as excess, count(*) over w as n
          from v_both window w as (order by month rows between 35 preceding and current row)) where n = 36""",
    "v_ic_pairs": """
        select quarter_end, ticker, composite, bargain_score, horizon, fwd
        from v_scored join (
          select as_of_quarter, ticker, '1q' as horizon, fwd_1q as fwd from v_fwd union all select as_of_quarter, ticker, '1y', fwd_1y from v_fwd
          union all select as_of_quarter, ticker, '3y', fwd_3y from v_fwd union all select as_of_quarter, ticker, '5y', fwd_5y from v_fwd) f
        using (ticker) where f.as_of_quarter = quarter_end and fwd is not null""",
    "v_windows": """
        select * from (values ('train', date '1995-03-31', date '1998-12-31'), ('valid', date '1999-03-31', date '2000-06-30'),
          ('test', date '2000-09-30', date '2001-12-31')) t("window", w_start, w_end)""",
    # Periodic investment ---------------------------------------------------------------------------------
    "v_picks": """
        select quarter_end, ticker from v_scored where composite >= 45 and bargain_score >= 40
        qualify row_number() over (partition by quarter_end order by composite desc, bargain_score desc, ticker) <= 5""",
    "v_lots": """
        select quarter_end, q, ticker, amount, amount / (price * 1.001::double) as shares
        from (select *, 20000.0::double / count(*) over (partition by quarter_end) as amount from v_picks) join v_grid using (ticker, quarter_end)""",
    "v_hold_path": """
        select s.q, s.quarter_end, coalesce(sum(shares * g.price), 0) as wealth
        from v_pq s left join (v_lots l join v_grid g on g.ticker = l.ticker and g.q >= l.q) on g.q = s.q group by 1, 2""",
    "v_exits": """
        select l.ticker, l.q, min(s.q) as out
        from v_lots l join v_pq s on s.q > l.q where not exists (select 1 from v_picks p where p.ticker = l.ticker and p.quarter_end = s.quarter_end)
        group by 1, 2""",
    "v_rebalance_path": """
        select s.q, s.quarter_end, coalesce(sum(case when x.out is null or s.q < x.out then shares * g.price else shares * o.price * 0.999::double end), 0) as wealth
        from v_pq s left join (v_lots l left join v_exits x using (ticker, q)) on l.q <= s.q
        left join v_grid g on g.ticker = l.ticker and g.q = s.q left join v_grid o on o.ticker = l.ticker and o.q = x.out group by 1, 2""",
    "v_market_path": """
        select s.q, s.quarter_end, sum(20000.0::double / (b.price * 1.001::double)) * any_value(m.price) as wealth
        from v_pq s join v_grid m on m.ticker = 'SPY' and m.q = s.q join v_grid b on b.ticker = 'SPY' and b.q <= s.q group by 1, 2""",
    "v_folds": """
        with n as (select count(*) as n from v_pq)
        select 'contiguous' as kind, ntile(5) over (order by q) - 1 as fold, quarter_end, q from v_pq
        union all
        select 'expanding', cast(floor((q - 20) / 8) as bigint), quarter_end, q from v_pq, n where n > 24 and q >= 20""",
}


def dca_summary(path: str, invested: str) -> str:
    """Result row of a wealth path (q, quarter_end, wealth) given the number of invested quarters."""
    return f"""
      select arg_max(wealth, q) as terminal_wealth, min(quarter_end) as period_start, max(quarter_end) as period_end,
        ({invested}) as quarters_invested, ({invested}) * 20000.0::double as total_invested,
        arg_max(wealth, q) / nullif(({invested}) * 20000.0::double, 0) - 1 as total_return,
        pow(arg_max(wealth, q) / nullif(({invested}) * 20000.0::double, 0), 365.25::double / (max(quarter_end) - min(quarter_end))) - 1 as cagr,
        coalesce(min(dd), 0) as max_drawdown
      from (select *, case when r is not null then wx / max(wx) over (order by q) - 1 end as dd from (
        select *, case when r is not null then product(r) over (order by q) end as wx from (
          select *, case when lag(wealth) over (order by q) > 0 then wealth / lag(wealth) over (order by q) end as r from {path})))"""


CTES["v_hold_result"] = dca_summary("v_hold_path", "select count(distinct quarter_end) from v_picks")
CTES["v_rebalance_result"] = dca_summary("v_rebalance_path", "select count(distinct quarter_end) from v_picks")
CTES["v_market_result"] = dca_summary("v_market_path", "select count(*) from v_grid where ticker = 'SPY'")


# Live universe --------------------------------------------------------------------------------------
def _scores(long: str, key: str, name: str) -> dict[str, str]:
    """Family percentiles and composites over the eight live families."""
    z = f"v_z_{long[2:]}"
    return {
        **_zscores(long, key),
        f"{name}_fam": f"select ticker, family, weight, avg(100 * {phi('z')}) as pct from {z} join v_live_signals using (signal) where z is not null group by all",
        name: "select ticker, " + ", ".join(f"max(pct) filter (family = '{f}') as pct_{f}" for f in LIVE_FAMILIES)
        + f", round(sum(pct * weight) / sum(weight), 9) as composite, sum(weight) * 100 as factor_coverage_pct from {name}_fam group by 1",
    }


_LIVE_SIGNALS = [s for ss in LIVE_FAMILIES.values() for s in ss]
_NOT_LIVE = ("total_liabilities", "current_assets", "current_assets_prior", "current_liabilities", "current_liabilities_prior",
             "net_income", "net_income_prior", "operating_cashflow", "dividends_paid", "repurchase_of_stock", "retained_earnings",
             "gross_profit", "gross_profit_prior", "shares_outstanding_prior")
CTES |= {
    "v_now_slice": """
        select date '2001-12-31' as quarter_end, ticker, close, rn, rnq - rn + 1 as back
        from (select ticker, max(rn) as rnq from v_numbered join v_universe using (ticker) where trade_date <= date '2001-12-31' group by 1)
        join v_numbered using (ticker) where rn between rnq - 399 and rnq""",
    "v_now_metrics": _metrics("v_now_slice"),
    "v_live_raw": """
        with st as (select ticker, """
    + ", ".join(f"max(latest) filter (field = '{f}') as {f}, max(prior) filter (field = '{f}') as {f}_prior" for f in ("total_assets", "ebit", "revenue", "long_term_debt"))
    + """ from v_statement_values group by 1)
        select u.ticker, k, name, sector, industry, date '2001-12-31' as quarter_end,
          coalesce(nullif(case when k % 3 <> 0 then abs(bal) end, 0), case when k % 9 <> 0 then abs(bal) + 1 end, m.price) as price,
          abs(bal) * 1000 as market_cap, case when k % 2 = 0 then abs(bal) * 1100 end as enterprise_value, abs(bal) / 2 as book_value,
          1000.0::double + k as shares_outstanding, 5.0::double + k % 30 as trailing_pe, abs(bal) / 20 as trailing_eps,
          (k % 7) / 20.0::double - 0.1::double as earnings_growth, (k % 5) / 100.0::double as dividend_yield,
          case when k % 4 = 0 then 1.5::double end as trailing_peg_ratio, abs(bal) * 10.0::double + 100.0::double * k as total_cash, abs(bal) * 30 as total_debt,
          (20.0::double + k) / 100 as debt_to_equity, 1.25::double as current_ratio_info,
          coalesce(case when k % 5 = 0 then abs(bal) * 1.5::double end, fifty_two_week_high) as fifty_two_week_high, fifty_two_week_low,
          momentum_12_1, volatility_12m, max_drawdown, downside_deviation, st.* exclude (ticker), """
    + ", ".join(f"cast(null as double) as {f}" for f in _NOT_LIVE)
    + """ from v_universe u left join st using (ticker) left join v_now_metrics m using (ticker) where quote_type <> 'ETF'""",
    "v_live_factors": _factors("v_live_raw"),
    "v_shift": """
        select ticker, 10 * (max(m) filter (period = '0m') - max(m) filter (period = '-1m')) as earnings_revisions
        from (select ticker, period, (5 * sb + 4 * b + 3 * h + 2 * s + ss)::double / nullif(sb + b + h + s + ss, 0) as m from v_recs) group by 1""",
    "v_live": """
        select f.*, passed * 9.0::double / nullif(checks, 0) as financial_strength, earnings_revisions,
          case when coalesce(enterprise_value, market_cap + total_debt - total_cash) > 0 then ebit / coalesce(enterprise_value, market_cap + total_debt - total_cash) end as earnings_yield_current
        from v_live_factors f left join v_shift using (ticker)""",
    "v_live_signals": _values(_signal_rows(LIVE_FAMILIES), "family, signal, pos, weight"),
    "v_live_long": _long("v_live", "1 as one, ticker, sector", _LIVE_SIGNALS),
    **_scores("v_live_long", "one", "v_live_scored"),
    "v_fresh": """
        with m as (select ticker, k, case when k % 4 = 0 then ticker when k % 4 = 1 then ' unknown ' else concat(name, ' Inc') end as name,
            case when k % 5 = 0 then '' else sector end as sector, case when k % 3 <> 0 then price * 1.25::double end as price, market_cap,
            momentum_12_1 + 0.5::double as momentum_12_1, low_volatility, roe + 1 as roe, earnings_revisions from v_live)
        select * from m union all select * replace (concat('n', ticker) as ticker) from m where k % 10 = 1""",
    "v_merged": """
        select coalesce(s.ticker, upper(f.ticker)) as ticker,
          case when s.ticker is null or (lower(trim(f.name)) not in ('', 'unknown') and f.name <> f.ticker) then f.name else s.name end as name,
          case when s.ticker is null or lower(trim(f.sector)) not in ('', 'unknown') then f.sector else s.sector end as sector, s.industry,
          case when s.ticker is null then f.price else coalesce(f.price, s.price) end as price,
          case when s.ticker is null then f.market_cap else coalesce(f.market_cap, s.market_cap) end as market_cap,
          case when s.ticker is null then f.momentum_12_1 else coalesce(f.momentum_12_1, s.momentum_12_1) end as momentum_12_1,
          case when s.ticker is null then f.low_volatility else coalesce(f.low_volatility, s.low_volatility) end as low_volatility,
          case when s.ticker is null then f.roe else s.roe end as roe,
          case when s.ticker is null then f.earnings_revisions else s.earnings_revisions end as earnings_revisions,
          s.* exclude (ticker, name, sector, industry, price, market_cap, momentum_12_1, low_volatility, roe, earnings_revisions)
        from v_live s full join v_fresh f on s.ticker = f.ticker""",
    "v_merged_long": _long("v_merged", "1 as one, ticker, sector", _LIVE_SIGNALS),
    **_scores("v_merged_long", "one", "v_merged_scored"),
    "v_watch": "select ticker from v_universe where industry < 'NATION_15'",
}
