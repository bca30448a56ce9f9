"""Market-shaped views over the given star-schema tables, so every operator runs on given data.

A supplier plays a listed company, its shipped line items play trades and statement entries, the
market as a whole plays the benchmark, orders play filings and events play analyst notes.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from pitscore.params import Window

# Calendar and evaluation windows that fit the dates of the given tables.
START, END = date(1995, 3, 31), date(2001, 12, 31)
WINDOWS = (
    Window("train", date(1995, 3, 31), date(1998, 12, 31)),
    Window("valid", date(1999, 3, 31), date(2000, 6, 30)),
    Window("test", date(2000, 9, 30), date(2001, 12, 31)),
)

# Names per part of a membership list; a list of any size is several rows of the same date.
LIST_PART = 100

_VIEWS = {
    "prices": """
        with d as (
          select l_suppkey, cast(l_shipdate as date) as trade_date, {cents(l_extendedprice)} as px, {cents(l_quantity)} as qty
          from {lineitem}),
        s as (select l_suppkey, trade_date, sum(px) as px, sum(qty) as qty from d group by l_suppkey, trade_date),
        m as (select trade_date, sum(px) as px, sum(qty) as qty from d group by trade_date)
        select concat('S', cast(l_suppkey as string)) as ticker, trade_date, {amount(px, 2)} / {amount(qty, 2)} as close from s
        union all
        select 'SPY', trade_date, {amount(px, 2)} / {amount(qty, 2)} from m
    """,
    "universe": """
        select concat('S', cast(s_suppkey as string)) as ticker, s_name as name, r_name as sector,
               n_name as industry, case when s_suppkey % 20 = 0 then 'ETF' else 'EQUITY' end as quote_type,
               case when s_acctbal > 0 then s_acctbal end as target_mean
        from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
    """,
    "fundamentals": """
        with li as (
          select l_suppkey, last_day(cast(date_trunc('quarter', l_shipdate) + interval 2 month as date)) as period,
                 {cents(l_extendedprice)} as px, {cents(l_discount)} as disc, {cents(l_tax)} as tax, {cents(l_quantity)} as qty,
                 {cents(p_retailprice)} as cost, l_returnflag as rf, l_linestatus as ls
          from {lineitem} join {part} on l_partkey = p_partkey),
        -- Sums of prices are in hundredths, sums of products in ten-thousandths.
        s as (
          select l_suppkey, period, sum(px) as px, sum(qty) as qty,
            sum(case when ls = 'O' then px else 0 end) as px_o, sum(case when ls = 'F' then px else 0 end) as px_f,
            sum(case when rf = 'R' then px else 0 end) as px_r, sum(case when ls = 'O' and rf = 'R' then px else 0 end) as px_or,
            sum(case when rf = 'N' then px else 0 end) as px_n, sum(case when rf = 'A' and ls = 'F' then px else 0 end) as px_af,
            sum(px * (100 - disc)) as net, sum(qty * cost) as cost, sum(px * tax) as tax, sum(px * disc) as disc,
            sum(case when ls = 'F' then px * (100 - disc) - qty * cost else 0 end) as flow
          from li group by l_suppkey, period),
        w as (
          select l_suppkey, period,
            {amount(px, 2)} as total_assets, {amount(px_o, 2)} as total_liabilities, {amount(px_f, 2)} as current_assets,
            {amount(px_r, 2)} as current_liabilities, {amount(px_or, 2)} as long_term_debt, {amount(qty, 2)} as shares_outstanding,
            {amount(net - cost, 4)} as gross_profit, {amount(net - cost - tax - px_n * 100, 4)} as net_income,
            {amount(net - cost - tax, 4)} as ebit, {amount(net, 4)} as revenue, {amount(flow, 4)} as operating_cashflow,
            {amount(disc, 4)} as dividends_paid, {amount(-tax, 4)} as repurchase_of_stock, {amount(px_n, 2)} as retained_earnings,
            {amount(px_af, 2)} as total_cash, {amount(px_f, 2)} as book_equity
          from s),
        u as (select * from w unpivot (amount for field in (
              total_assets, total_liabilities, current_assets, current_liabilities, long_term_debt,
              shares_outstanding, gross_profit, net_income, ebit, revenue, operating_cashflow, dividends_paid,
              repurchase_of_stock, retained_earnings, total_cash, book_equity)))
        select concat('S', cast(l_suppkey as string)) as ticker, field,
               case when restated then amount * 1.0625 else amount end as amount, period,
               date_add(period, case when restated then 150 else 45 end) as filed
        from u lateral view explode(case when l_suppkey % 5 = 0 then array(false, true) else array(false) end) r as restated
    """,
    "membership_history": """
        with m as (
          select cast(date_trunc('month', l_shipdate) as date) as date, l_suppkey
          from {lineitem} group by 1, 2 having sum(l_quantity) >= 150)
        select date, array_join(sort_array(collect_list(
                 case when l_suppkey % 7 = 0 then concat('s', cast(l_suppkey as string), '.B')
                      else concat('S', cast(l_suppkey as string)) end)), ',') as tickers
        from m group by date, l_suppkey div {part_size}
    """,
    "recs_period": """
        select concat('S', cast(user_id as string)) as ticker,
          case when ts >= timestamp_ntz '2024-01-16 00:00:00' then '0m' else '-1m' end as period,
          count_if(event_type = 'signup') as strong_buy, count_if(event_type = 'purchase') as buy,
          count_if(event_type = 'view') as hold, count_if(event_type = 'click') as sell,
          count_if(event_type = 'error') as strong_sell
        from {events} group by 1, 2
    """,
    "recs_actions": """
        select event_id as seq, concat('S', cast(user_id as string)) as ticker, cast(ts as date) as date,
          case event_type when 'signup' then 'Strong Buy' when 'purchase' then 'Outperform' when 'view' then 'Hold'
               when 'click' then 'Underperform' else 'Sell' end as to_grade,
          case when value < 20 then 'down' when value > 60 then 'up' else 'main' end as action
        from {events}
    """,
    "sub": """
        select o_orderkey as adsh, o_custkey as cik,
          case o_orderpriority when '1-URGENT' then '10-K' when '2-HIGH' then '10-K/A' when '3-MEDIUM' then '10-Q'
               when '4-NOT SPECIFIED' then '8-K' else '10-Q/A' end as form,
          last_day(cast(date_trunc('quarter', o_orderdate) + interval 2 month as date)) as period,
          cast(o_orderdate + interval 120 day as date) as filed
        from {orders}
    """,
    "num": """
        select l_orderkey as adsh,
          case l_linenumber when 1 then 'Assets' when 2 then 'Revenues' when 3 then 'SalesRevenueNet'
               when 4 then 'NetIncomeLoss' when 5 then 'LongTermDebt' when 6 then 'LongTermDebtNoncurrent'
               else 'Unmapped' end as tag,
          cast(l_shipdate as date) as ddate, l_partkey % 5 as qtrs, l_extendedprice as amount
        from {lineitem}
    """,
    "statements": """
        with f as (
          select l_suppkey as k, last_day(cast(date_trunc('quarter', l_shipdate) + interval 2 month as date)) as period,
                 cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as assets,
                 cast(sum(case when l_returnflag = 'A' then cast(l_extendedprice as decimal(18,2)) end) as double) as ebit,
                 cast(sum(case when l_linestatus = 'F' then cast(l_extendedprice as decimal(18,2)) end) as double) as sales,
                 cast(sum(case when l_linenumber = 1 then cast(l_extendedprice as decimal(18,2)) end) as double) as debt
          from {lineitem} group by 1, 2)
        select concat('S', cast(k as string)) as ticker, e.metric, period, e.value
        from f lateral view explode(array(
          named_struct('metric', 'Total Assets', 'value', assets),
          named_struct('metric', 'EBIT', 'value', case when k % 3 = 0 then null else ebit end),
          named_struct('metric', 'Operating Income', 'value', ebit * 0.5),
          named_struct('metric', case when k % 2 = 0 then 'Total Revenue' else 'Operating Revenue' end, 'value', sales),
          named_struct('metric', 'Long Term Debt', 'value', case when k % 4 = 0 then null else debt end),
          named_struct('metric', 'Long Term Debt And Capital Lease Obligation', 'value', debt * 2.0))) x as e
    """,
    "quotes": """
        select concat('S', cast(s_suppkey as string)) as ticker, s_name as long_name, cast(null as string) as short_name,
               r_name as sector, n_name as industry,
               case when s_suppkey % 20 = 0 then 'ETF' else 'EQUITY' end as quote_type,
               case when s_suppkey % 3 = 0 then null else abs(s_acctbal) end as current_price,
               case when s_suppkey % 9 = 0 then null else abs(s_acctbal) + 1.0 end as regular_market_price,
               abs(s_acctbal) * 1000.0 as market_cap,
               case when s_suppkey % 2 = 0 then abs(s_acctbal) * 1100.0 end as enterprise_value,
               abs(s_acctbal) / 2.0 as book_value, 1000.0D + s_suppkey as shares_outstanding,
               5.0D + s_suppkey % 30 as trailing_pe, abs(s_acctbal) / 20.0 as trailing_eps,
               (s_suppkey % 7) / 20.0D - 0.1D as earnings_growth, (s_suppkey % 5) / 100.0D as dividend_yield,
               case when s_suppkey % 4 = 0 then 1.5D end as trailing_peg_ratio,
               abs(s_acctbal) * 10.0 + 100.0D * s_suppkey as total_cash, abs(s_acctbal) * 30.0 as total_debt,
               20.0D + s_suppkey as debt_to_equity, 1.25D as current_ratio_info,
               case when s_suppkey % 5 = 0 then abs(s_acctbal) * 1.5 end as fifty_two_week_high,
               cast(null as double) as fifty_two_week_low,
               case when s_acctbal > 0 then s_acctbal end as target_mean,
               case s_suppkey % 6 when 0 then 'strong_buy' when 1 then 'buy' when 2 then 'hold' when 3 then 'underperform'
                    when 4 then 'sell' end as recommendation_key
        from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
    """,
    "cik_map": """
        select c_custkey as cik, concat('C', cast(c_custkey as string)) as ticker from {customer} where c_custkey % 4 <> 0
    """,
}

#: Hundredths as a long, equal to the decimal of two places: a double that is the nearest to whole hundredths is
#: read off by arithmetic, all others by the decimal. Sums of longs need no wide decimals.
_CENTS = """case when abs({x}) < 1e12 and rint({x} * 100) / 100 = {x} then cast(rint({x} * 100) as bigint)
            else cast(cast({x} as decimal(18,2)) * 100 as bigint) end"""
#: The double nearest to a long with so many decimal places, as the decimal gives it.
_AMOUNT = """case when abs({x}) < 9007199254740992 then cast({x} as double) / 1e{places}
             else cast(cast({x} as decimal(20,0)) / cast(1e{places} as decimal(5,0)) as double) end"""


def _filled(text: str) -> str:
    """The view with its ``{cents(x)}`` and ``{amount(x, places)}`` written out."""
    text = re.sub(r"\{cents\((\w+)\)\}", lambda m: "(" + _CENTS.replace("{x}", m[1]) + ")", text)
    return re.sub(r"\{amount\(([^,{}]+), (\d)\)\}", lambda m: "(" + _AMOUNT.replace("{x}", f"({m[1]})").replace("{places}", m[2]) + ")", text)


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One market-shaped view over the tables in ``sf_dir``."""
    text = _filled(_VIEWS[name]).replace("{part_size}", str(LIST_PART))
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)
