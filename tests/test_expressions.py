"""Known answers of column expressions, formulas and parameters."""

from __future__ import annotations

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from pitscore import params
from pitscore.functions import columns as C
from pitscore.operators import analysts, asof, bargain, factors, prices, scoring, screens, validation
from pitscore.sources import samples


def one(spark, expr, **values):
    """Value of an expression over one row."""
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'array<double>' if isinstance(v, list) else 'double'}" for k, v in values.items())
    row = [tuple(float(v) if isinstance(v, int) else v for v in values.values())] if values else [(1.0,)]
    return spark.createDataFrame(row, schema or "x double").select(expr.alias("r")).first()["r"]


def factor_row(spark, group, **values):
    df = factors.with_inputs(spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values)))
    return df.select(*[c.alias(k) for k, c in group().items()]).first()


def test_erf_matches_math(spark):
    xs = [i / 50 for i in range(-450, 451)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", C.erf(F.col("x")).alias("e"), C.norm_cdf(F.col("x")).alias("p")).collect()
    for r in rows:
        assert r.e == pytest.approx(math.erf(r.x), abs=1e-15)
        assert r.p == pytest.approx(0.5 * (1 + math.erf(r.x / math.sqrt(2))), abs=1e-15)


@pytest.mark.parametrize("raw,clean", [("brk.b", "BRK-B"), (" aapl ", "AAPL"), ("A.B.C", "A.B.C"), ("X.LONG", "X.LONG")])
def test_listing_ticker(spark, raw, clean):
    assert one(spark, C.listing_ticker("t"), t=raw) == clean


@pytest.mark.parametrize("raw,value", [("1.5", 1.5), ("abc", None), ("nan", None), ("", None)])
def test_to_double(spark, raw, value):
    assert one(spark, C.to_double("t"), t=raw) == value


def test_normalisers(spark):
    assert one(spark, C.leverage_ratio("v"), v=286.236) == pytest.approx(2.86236)
    assert one(spark, C.leverage_ratio("v"), v=2.5) == 2.5
    assert one(spark, C.percent_points("v"), v=0.15) == pytest.approx(15.0)
    assert one(spark, C.percent_points("v"), v=12.0) == 12.0
    assert one(spark, C.linear_score("v", 0.3, 1.3), v=0.3) == 0.0
    assert one(spark, C.linear_score("v", 0.3, 1.3), v=1.3) == pytest.approx(100.0)
    assert one(spark, C.linear_score("v", 1.0, 1.0), v=1.0) == 0.0


def test_piotroski_scales_to_available_tests(spark):
    r = factor_row(spark, factors.piotroski, net_income=10, total_assets=100, operating_cashflow=15, shares_outstanding=10, shares_prior=10)
    assert (r.piotroski_f_score, r.financial_strength) == (4.0, 9.0)
    empty = factor_row(spark, factors.piotroski, price=1)
    assert empty.piotroski_f_score is None and empty.financial_strength is None


def test_low_leverage_and_shareholder_yield(spark):
    assert factor_row(spark, factors.balance_sheet_factors, debt_to_equity=0.0).low_leverage == 1.0
    assert factor_row(spark, factors.balance_sheet_factors, debt_to_equity=1.0).low_leverage == 0.5
    assert factor_row(spark, factors.shareholder_yield, market_cap=1e6, dividends_paid=-50_000).shareholder_yield == pytest.approx(0.05)
    sold = factor_row(spark, factors.shareholder_yield, market_cap=1e6, repurchase_of_stock=10_000)
    assert sold.shareholder_yield is None


def test_graham_garp_roic_altman(spark):
    g = factor_row(spark, factors.graham_factors, price=50, trailing_eps=4, book_value=25)
    assert g.graham_ratio == pytest.approx(math.sqrt(22.5 * 100) / 50)
    p = factor_row(spark, factors.garp_factor, trailing_pe=20, earnings_growth=0.15, dividend_yield=0.02)
    assert (p.peg_ratio, p.garp) == (pytest.approx(20 / 15), pytest.approx(17 / 20))
    fallback = factor_row(spark, factors.garp_factor, trailing_peg_ratio=2.0)
    assert fallback.garp == 0.5
    r = factor_row(spark, factors.capital_efficiency, ebit=10, total_debt=50, book_value=5, shares_outstanding=10, total_cash=500)
    assert r.roic == pytest.approx(10.0)
    z = factor_row(spark, factors.altman_z, total_assets=100, revenue=50)
    assert z.altman_z == pytest.approx(0.5 * 7.5)


def test_history_percentile(spark):
    h = [0.05, 0.08, 0.10, 0.12, 0.15]
    assert one(spark, prices.history_percentile(F.col("c"), F.col("h")), c=0.10, h=h) == pytest.approx(60.0)
    assert one(spark, prices.history_percentile(F.col("c"), F.col("h")), c=0.10, h=h[:3]) is None


def test_rsi_momentum_drawdown(spark):
    falling = [100.0 - i for i in range(30)]
    assert one(spark, prices.wilder_rsi(F.col("h")), h=falling) < 50
    assert one(spark, prices.wilder_rsi(F.col("h")), h=[1.0, 2.0, 3.0]) is None
    assert one(spark, prices.wilder_rsi(F.col("h")), h=[float(i) for i in range(1, 30)]) == 100.0
    assert one(spark, prices.wilder_rsi(F.col("h")), h=[5.0] * 30) == 50.0
    xs = [float(i) for i in range(1, 253)]
    assert one(spark, prices.momentum(F.col("h")), h=xs) == pytest.approx(xs[-22] / xs[-252] - 1)
    assert one(spark, prices.momentum(F.col("h")), h=xs[1:]) is None
    assert one(spark, prices.max_drawdown(F.col("h")), h=[1.0, 4.0, 3.0, 5.0, 2.5]) == pytest.approx(-0.5)


@pytest.mark.parametrize("price,graham,high,history,low,top", [(50, 1.5, 80, 90, 70, 100), (95, 0.3, 98, 10, 0, 40), (50, None, 100, None, 100, 100)])
def test_bargain_bounds(spark, price, graham, high, history, low, top):
    df = spark.createDataFrame(
        [(float(price), None if graham is None else float(graham), float(high), None if history is None else float(history))],
        "price double, graham_ratio double, fifty_two_week_high double, valuation_vs_history double",
    )
    assert low <= bargain.with_bargain(df).first()["bargain_score"] <= top


def test_composite_and_coverage(spark):
    equal = {f: 0.125 for f in params.FAMILIES}
    cols = {f"pct_{f}": None for f in params.FAMILIES} | {"pct_value": 80.0}
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} double" for c in cols))
    r = scoring.with_composite(df, equal).first()
    assert (r.composite, r.factor_coverage_pct) == (80.0, 12.5)
    half = scoring.with_composite(df, {"value": 0.5, "momentum": 0.5}).first()
    assert (half.composite, half.factor_coverage_pct) == (80.0, 50.0)


@pytest.mark.parametrize(
    "label,score",
    [("Strong Buy", 5), ("Buy", 4), ("Outperform", 4), ("Market Perform", None), ("Sector Outperform", 4), ("Sell", 1), ("", None), ("Equal-Weight", 3), ("Strong Sell", 1), ("xyz", None)],
)
def test_rating_score(spark, label, score):
    assert one(spark, analysts.rating_score(F.col("t")), t=label) == score


def test_weights():
    named = params.named_candidates()
    assert all(sum(w.values()) == pytest.approx(0.95) for w in named.values())
    assert named["evidence_based"]["value"] == pytest.approx(0.25)
    assert params.scaled({"a": 1.0, "c": 9.0}, ("a", "b"), 0.5) == {"a": 0.5, "b": 0.0}
    assert params.historical_weights({})["value"] == 0.0
    draws = params.dirichlet_weights(3, 7, ("a", "b"))
    assert len(draws) == 3 and all(sum(w.values()) == pytest.approx(1.0) for w in draws.values())


def test_folds():
    qs = [date(2000 + i // 4, 3 * (i % 4) + 1, 1) for i in range(28)]
    sizes = [len(m) for m, _ in validation.quarter_folds(qs, 5)]
    assert sizes == [6, 6, 6, 5, 5]
    assert [len(m) for m, _ in validation.expanding_folds(qs)] == [8]
    assert validation.expanding_folds(qs[:24]) == []
    assert all(members == [end] for members, end in validation.comparison_folds(qs[:24]))


def test_gate(spark):
    rows = [("A", 60.0, 60.0, "Buy"), ("B", 60.0, 60.0, "Sell"), ("C", None, 60.0, "Buy"), ("D", 50.0, 60.0, "Buy"), ("E", 60.0, 60.0, None)]
    df = spark.createDataFrame(rows, "ticker string, composite double, bargain_score double, consensus_label string")
    good = {r.ticker for r in screens.with_good_buy(df, params.Thresholds()).filter("is_good_buy").collect()}
    assert good == {"A", "E"}


def test_theme_weights():
    single = params.theme_weights({"value": 0.3, "garp": 0.2, "unknown": 9.0})
    assert single == {f: {"value": 0.3, "garp": 0.2}.get(f, 0.0) for f in params.HISTORICAL_FAMILIES}
    grouped = params.theme_weights({"a": 0.6, "b": 0.4, "c": 1.0}, {"a": {"value": 2.0, "garp": 1.0}, "b": {"value": 5.0}, "c": {"quality": 0.0}})
    assert grouped["value"] == pytest.approx(0.8) and grouped["garp"] == pytest.approx(0.2) and grouped["quality"] == 0.0


def test_percentiles_of_a_batch_are_those_of_the_expression(spark):
    zs = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, *[i / 50 for i in range(-450, 451)], 40.0, -1e300]
    df = spark.createDataFrame([(1, zs), (2, []), (3, None), (4, zs[::-1])], "id int, z array<double>").coalesce(1)
    rows = df.select("id", scoring._percentiles("z").alias("p"), F.transform("z", lambda x: C.norm_cdf(x) * 100.0).alias("e")).collect()
    for r in rows:
        assert r.p is r.e is None or len(r.p) == len(r.e)
        for p, e in zip(r.p or [], r.e or []):
            assert p is e is None or (math.isnan(p) and math.isnan(e)) or p == pytest.approx(e, abs=1e-12)


def test_hundredths_are_those_of_the_decimal(spark):
    xs = [None, 0.0, -0.0, 0.01, 0.07, 0.29, 1.005, 2.675, 0.125, -0.125, -7.49, 104949.5, 0.1 + 0.2, 1e-9, 999999999999.99, 1e13 + 0.25, 90071992547409.93]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", F.expr(samples._filled("{cents(x)}")).alias("a"), F.expr("cast(cast(x as decimal(18,2)) * 100 as bigint)").alias("b")).collect()
    assert [(r.x, r.a) for r in rows] == [(r.x, r.b) for r in rows]
    vs = [None, 0, 1, -1, 12345, -99999, 2**53 - 1, 2**53 + 1, 2**62 + 12345, -(2**62) - 1]
    df = spark.createDataFrame([(v,) for v in vs], "v bigint")
    exact = lambda n: F.expr(f"cast(cast(v as decimal(20,0)) / cast({10**n} as decimal(5,0)) as double)")
    for n in (2, 4):
        for r in df.select("v", F.expr(samples._filled(f"{{amount(v, {n})}}")).alias("a"), exact(n).alias("b")).collect():
            assert r.a == r.b


def test_known_value_of_a_date_is_aggregated_by_hash(spark):
    right = spark.createDataFrame([("a", date(2020, 1, 1), 1.0), ("a", date(2020, 1, 1), 3.0), ("a", date(2020, 1, 3), None)], "k string, t date, v double")
    left = spark.createDataFrame([("a", date(2020, 1, 2)), ("a", date(2020, 1, 4)), ("a", date(2019, 1, 1))], "k string, d date")
    joined = asof.asof_join(left, right, ["k"], "d", "t", ["v"])
    assert "SortAggregate" not in joined._jdf.queryExecution().sparkPlan().toString()
    assert {r.d: (r.t, r.v) for r in joined.collect()} == {
        date(2020, 1, 2): (date(2020, 1, 1), 3.0), date(2020, 1, 4): (date(2020, 1, 3), None), date(2019, 1, 1): (None, None),
    }
