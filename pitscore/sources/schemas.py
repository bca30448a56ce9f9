"""Fixed names of the filing data sets."""

from __future__ import annotations

# Columns of the public filing data sets that are used; an amount stands in either of two columns.
FILING_HEADER_COLUMNS = ("adsh", "cik", "form", "period", "filed")
FILING_NUMBER_COLUMNS = ("adsh", "tag", "ddate", "qtrs")
FILING_AMOUNT_COLUMNS = ("value", "uval")

# Accounting tag -> field.
TAG_FIELDS = {
    "Assets": "total_assets",
    "Liabilities": "total_liabilities",
    "AssetsCurrent": "current_assets",
    "LiabilitiesCurrent": "current_liabilities",
    "LongTermDebt": "long_term_debt",
    "LongTermDebtNoncurrent": "long_term_debt",
    "CommonStockSharesOutstanding": "shares_outstanding",
    "WeightedAverageNumberOfSharesOutstandingBasic": "shares_outstanding",
    "GrossProfit": "gross_profit",
    "NetIncomeLoss": "net_income",
    "OperatingIncomeLoss": "ebit",
    "Revenues": "revenue",
    "RevenueFromContractWithCustomerExcludingAssessedTax": "revenue",
    "SalesRevenueNet": "revenue",
    "NetCashProvidedByUsedInOperatingActivities": "operating_cashflow",
    "PaymentsOfDividends": "dividends_paid",
    "PaymentsOfDividendsCommonStock": "dividends_paid",
    "PaymentsForRepurchaseOfCommonStock": "repurchase_of_stock",
    "PaymentsForRepurchaseOfEquity": "repurchase_of_stock",
    "RetainedEarningsAccumulatedDeficit": "retained_earnings",
    "CashAndCashEquivalentsAtCarryingValue": "total_cash",
    "CashCashEquivalentsAndShortTermInvestments": "total_cash",
    "StockholdersEquity": "book_equity",
    "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest": "book_equity",
    "LongTermDebtAndCapitalLeaseObligations": "total_debt",
    "LongTermDebtAndCapitalLeaseObligationsCurrent": "total_debt_current",
    "LongTermDebtAndCapitalLeaseObligationsNoncurrent": "total_debt_noncurrent",
}
FIELDS = tuple(dict.fromkeys(TAG_FIELDS.values()))
PERIODIC_FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A")
