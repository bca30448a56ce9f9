"""Factor formulas as column expressions over one wide row per (ticker, date).

A NULL input or a zero denominator gives NULL. For some inputs zero also means "missing"; those
go through ``nonzero``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscore.functions.columns import leverage_ratio, mean_of, nonzero, percent_points, ratio
from pitscore.params import FAMILIES

c = F.col

# Inputs of the formulas; a frame that lacks one gets it as a typed NULL.
INPUTS = (
    "price", "market_cap", "enterprise_value", "book_value", "shares_outstanding", "shares_prior",
    "total_assets", "total_assets_prior", "total_liabilities", "current_assets", "current_liabilities",
    "current_assets_prior", "current_liabilities_prior", "long_term_debt", "long_term_debt_prior",
    "gross_profit", "gross_profit_prior", "net_income", "net_income_prior", "ebit", "revenue",
    "revenue_prior", "operating_cashflow", "free_cashflow", "dividends_paid", "repurchase_of_stock",
    "retained_earnings", "total_cash", "total_debt", "debt_to_equity", "current_ratio_info",
    "trailing_pe", "trailing_eps", "earnings_growth", "dividend_yield", "trailing_peg_ratio",
    "momentum_12_1", "volatility_12m", "max_drawdown", "downside_deviation",
)


def value_factors() -> dict[str, Column]:
    return {
        "earnings_yield": ratio("ebit", "enterprise_value"),
        "book_to_market": ratio(c("book_value") * c("shares_outstanding"), "market_cap"),
        "fcf_yield": ratio("free_cashflow", "market_cap"),
    }


def quality_factors() -> dict[str, Column]:
    equity = nonzero("book_value") * nonzero("shares_outstanding")
    return {
        "gross_profitability": ratio("gross_profit", "total_assets"),
        "roe": ratio("net_income", equity),
        "roa": ratio("net_income", "total_assets"),
        "profit_margin": ratio("net_income", "revenue"),
    }


def risk_factors() -> dict[str, Column]:
    return {"low_volatility": F.when(c("volatility_12m") > 0, ratio(F.lit(1.0), "volatility_12m"))}


def investment_factor() -> dict[str, Column]:
    growth = ratio("total_assets", "total_assets_prior") - 1.0
    return {"asset_growth": growth, "investment": -growth}


def piotroski() -> dict[str, Column]:
    """Nine tests; each counts only where its inputs exist. Returned rescaled to nine tests."""
    ta, ta0 = nonzero("total_assets"), nonzero("total_assets_prior")

    def rise(a: Column, b: Column, a0: Column, b0: Column) -> tuple[Column, Column]:
        return ratio(a, b), ratio(a0, b0)

    roa = rise(c("net_income"), ta, c("net_income_prior"), ta0)
    leverage = rise(c("long_term_debt"), ta, c("long_term_debt_prior"), ta0)
    liquidity = rise(
        nonzero("current_assets"), nonzero("current_liabilities"),
        nonzero("current_assets_prior"), nonzero("current_liabilities_prior"),
    )
    sales, sales0 = F.when(c("revenue") > 0, c("revenue")), F.when(c("revenue_prior") > 0, c("revenue_prior"))
    margin = rise(nonzero("gross_profit"), sales, nonzero("gross_profit_prior"), sales0)
    turnover = rise(nonzero("revenue"), ta, nonzero("revenue_prior"), ta0)
    tests = [
        ratio("net_income", F.when(c("total_assets") > 0, c("total_assets"))) > 0,
        c("operating_cashflow") > 0,
        roa[0] > roa[1],
        c("operating_cashflow") > c("net_income"),
        leverage[0] <= leverage[1],
        liquidity[0] >= liquidity[1],
        c("shares_outstanding") <= c("shares_prior"),
        margin[0] >= margin[1],
        turnover[0] >= turnover[1],
    ]
    # A test with a missing input is NULL: it adds neither to the score nor to the checks.
    passed = sum((F.coalesce(t.cast("int"), F.lit(0)) for t in tests), F.lit(0))
    checks = sum((t.isNotNull().cast("int") for t in tests), F.lit(0))
    return {
        "piotroski_f_score": F.when(checks > 0, passed.cast("double")),
        "financial_strength": ratio(passed.cast("double"), checks) * 9.0,
    }


def garp_factor() -> dict[str, Column]:
    """Growth at a reasonable price: (growth% + yield%) / PE, else the inverse PEG."""
    pe = F.when(c("trailing_pe") > 0, c("trailing_pe"))
    growth, payout = percent_points("earnings_growth"), percent_points("dividend_yield")
    peg = F.coalesce(ratio(pe, F.when(growth > 0, growth)), c("trailing_peg_ratio"))
    positive = [F.when(p > 0, p) for p in (growth, payout)]
    total = F.when(
        positive[0].isNotNull() | positive[1].isNotNull(),
        F.coalesce(positive[0], F.lit(0.0)) + F.coalesce(positive[1], F.lit(0.0)),
    )
    adjusted = ratio(total, pe)
    return {
        "peg_ratio": peg,
        "dividend_adjusted_peg": adjusted,
        "garp": F.coalesce(adjusted, F.when(peg > 0, ratio(F.lit(1.0), peg))),
    }


def balance_sheet_factors() -> dict[str, Column]:
    net_cash = c("total_cash") - c("total_debt")
    leverage = c("debt_to_equity")
    return {
        "net_cash": net_cash,
        "net_cash_to_mcap": ratio(net_cash, "market_cap"),
        "low_leverage": F.when(leverage <= 0, 1.0).when(leverage > 0, ratio(F.lit(1.0), leverage + 1.0)),
    }


def graham_factors() -> dict[str, Column]:
    ok = (c("trailing_eps") > 0) & (c("book_value") > 0)
    fair = F.when(ok, F.sqrt(c("trailing_eps") * 22.5 * c("book_value")))
    current = F.when(c("current_liabilities") > 0, ratio(nonzero("current_assets"), "current_liabilities"))
    return {
        "graham_fair_value": fair,
        "graham_ratio": ratio(fair, "price"),
        "current_ratio": F.coalesce("current_ratio_info", current),
    }


def downside_protection() -> dict[str, Column]:
    return {"downside_protection": mean_of([-c("max_drawdown"), ratio(F.lit(1.0), c("downside_deviation") + 1.0)])}


def earnings_quality() -> dict[str, Column]:
    accruals = ratio(c("net_income") - c("operating_cashflow"), F.when(c("total_assets") > 0, c("total_assets")))
    return {"accruals": accruals, "earnings_quality": -accruals}


def shareholder_yield(payment_sign: int = -1) -> dict[str, Column]:
    """Cash returned over market value. ``payment_sign`` is the sign that buy-backs carry in the
    input: -1 for cash-flow statements (default), 1 for payment tags."""
    buybacks = c("repurchase_of_stock") * float(payment_sign)
    paid, bought = F.abs(c("dividends_paid")), F.when(buybacks > 0, buybacks)
    total = F.when(
        (c("market_cap") > 0) & (paid.isNotNull() | bought.isNotNull()),
        F.coalesce(paid, F.lit(0.0)) + F.coalesce(bought, F.lit(0.0)),
    )
    return {
        "net_buybacks": buybacks,
        "total_returned_to_shareholders": total,
        "shareholder_yield": ratio(total, "market_cap"),
    }


def capital_efficiency() -> dict[str, Column]:
    equity = c("book_value") * c("shares_outstanding")
    invested = c("total_debt") + equity - F.coalesce("total_cash", F.lit(0.0))
    capital = F.when(invested.isNotNull(), F.greatest(invested, F.abs(equity) * 0.01, F.lit(1.0)))
    return {"invested_capital": capital, "roic": ratio("ebit", capital)}


# Weights of the five distress ratios.
ALTMAN_WEIGHTS = (1.2, 1.4, 3.3, 0.6, 1.0)


def altman_z() -> dict[str, Column]:
    """Weighted distress ratios; missing ones are made up for by rescaling the weights."""
    assets = F.when(c("total_assets") > 0, c("total_assets"))
    parts = [
        ratio(c("current_assets") - c("current_liabilities"), assets),
        ratio("retained_earnings", assets),
        ratio("ebit", assets),
        F.when(assets.isNotNull(), ratio("market_cap", F.when(c("total_liabilities") > 0, c("total_liabilities")))),
        ratio("revenue", assets),
    ]
    partial = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in zip(parts, ALTMAN_WEIGHTS)), F.lit(0.0))
    mass = sum((F.when(p.isNotNull(), w).otherwise(0.0) for p, w in zip(parts, ALTMAN_WEIGHTS)), F.lit(0.0))
    return {"altman_z": partial * ratio(F.lit(sum(ALTMAN_WEIGHTS)), mass)}


def factor_columns() -> dict[str, Column]:
    """All factors that need only the wide row (analyst revisions come from their own table)."""
    out: dict[str, Column] = {}
    for group in (
        value_factors, quality_factors, risk_factors, investment_factor, piotroski, garp_factor,
        balance_sheet_factors, graham_factors, downside_protection, earnings_quality, shareholder_yield,
        capital_efficiency, altman_z,
    ):
        out.update(group())
    return out


def with_inputs(df: DataFrame) -> DataFrame:
    missing = {name: F.lit(None).cast("double") for name in INPUTS if name not in df.columns}
    return df.withColumns(missing) if missing else df


def with_factors(df: DataFrame) -> DataFrame:
    return with_inputs(df).withColumns(factor_columns())


def historical_inputs(df: DataFrame) -> DataFrame:
    """Inputs of the formulas from point-in-time price and fundamentals (no quote data exists).

    Free cash flow is not in the filings and stays NULL. Leverage enters in percent, so a ratio
    below 0.10 keeps its hundredfold value after normalisation.
    """
    df = df.withColumns(
        {
            "market_cap": nonzero("price") * nonzero("shares_outstanding"),
            "trailing_eps": ratio("net_income", "shares_outstanding"),
            "shares_prior": c("shares_outstanding_prior"),
            "free_cashflow": F.lit(None).cast("double"),
            "trailing_peg_ratio": F.lit(None).cast("double"),
            "earnings_growth": ratio("net_income", "net_income_prior") - 1.0,
            "current_ratio_info": F.when(c("current_liabilities") > 0, ratio("current_assets", "current_liabilities")),
            "debt_to_equity": leverage_ratio(ratio("total_debt", "book_equity") * 100.0),
        }
    )
    return df.withColumns(
        {
            "enterprise_value": c("market_cap") + F.coalesce("total_debt", F.lit(0.0)) - F.coalesce("total_cash", F.lit(0.0)),
            "trailing_pe": F.when(c("trailing_eps") > 0, ratio(nonzero("price"), "trailing_eps")),
            "dividend_yield": F.when(c("market_cap") > 0, ratio(F.abs("dividends_paid"), "market_cap")),
        }
    )


# Statement fields of the live path, metric names by priority.
STATEMENT_NAMES = {
    "total_assets": ["Total Assets"],
    "total_liabilities": ["Total Liabilities Net Minority Interest", "Total Liabilities"],
    "current_assets": ["Current Assets"],
    "current_liabilities": ["Current Liabilities"],
    "long_term_debt": ["Long Term Debt", "Long Term Debt And Capital Lease Obligation"],
    "shares": ["Ordinary Shares Number", "Share Issued"],
    "gross_profit": ["Gross Profit"],
    "net_income": ["Net Income", "Net Income Common Stockholders"],
    "ebit": ["EBIT", "Operating Income"],
    "revenue": ["Total Revenue", "Operating Revenue"],
    "operating_income": ["Operating Income"],
    "operating_cashflow": ["Operating Cash Flow"],
    "free_cashflow": ["Free Cash Flow"],
    "dividends_paid": [
        "Cash Dividends Paid", "Common Stock Dividend Paid", "Payment Of Dividends", "Dividends Paid",
    ],
    "repurchase_of_stock": [
        "Repurchase Of Capital Stock", "Common Stock Payments", "Repurchase Of Common Stock", "Repurchase Of Stock",
    ],
    "retained_earnings": [
        "Retained Earnings", "Retained Earnings Total Equity", "Retained Earnings Accumulated Deficit",
    ],
}


def statement_columns(values: DataFrame) -> DataFrame:
    """``statement_values`` output as one wide row per ticker (fixed field list)."""
    wide = values.groupBy("ticker").pivot("field", list(STATEMENT_NAMES)).agg(
        F.first("latest").alias("latest"), F.first("prior").alias("prior")
    )
    latest = [c(f"{f}_latest").alias(f) for f in STATEMENT_NAMES if f != "shares"]
    prior = [c(f"{f}_prior") for f in STATEMENT_NAMES if f != "shares"]
    return wide.select("ticker", *latest, *prior, c("shares_prior"))


def live_inputs(quotes: DataFrame, statements: DataFrame, metrics: DataFrame) -> DataFrame:
    """Inputs of the formulas for one date from quotes, statements and price metrics, by ticker.

    Quote fields win over values derived from prices; earnings yield falls back to an enterprise
    value built from market value, debt and cash.
    """
    df = quotes.join(statements, "ticker", "left").join(
        metrics.select(
            "ticker", c("price").alias("_last"), "momentum_12_1", "volatility_12m", "max_drawdown",
            "downside_deviation", "rsi_14", c("fifty_two_week_high").alias("_high"), c("fifty_two_week_low").alias("_low"),
        ),
        "ticker", "left",
    )
    ev = F.coalesce(
        "enterprise_value",
        c("market_cap") + F.coalesce("total_debt", F.lit(0.0)) - F.coalesce("total_cash", F.lit(0.0)),
    )
    return df.withColumns(
        {
            "price": F.coalesce(nonzero("current_price"), c("regular_market_price"), c("_last")),
            "fifty_two_week_high": F.coalesce("fifty_two_week_high", "_high"),
            "fifty_two_week_low": F.coalesce("fifty_two_week_low", "_low"),
            "debt_to_equity": leverage_ratio("debt_to_equity"),
            "name": F.coalesce(F.nullif("long_name", F.lit("")), F.nullif("short_name", F.lit("")), c("ticker")),
            "earnings_yield_current": F.when(ev > 0, ratio("ebit", ev)),
        }
    ).drop("_last", "_high", "_low")


SIGNALS = tuple(s for family in FAMILIES.values() for s in family)
