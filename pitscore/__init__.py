"""Point-in-time equity factor analytics on Spark: DataFrame in, DataFrame out."""

from pitscore.operators.analysts import action_summary, period_summary, with_consensus as analyst_summary
from pitscore.operators.asof import asof_join, prices_at_quarters
from pitscore.operators.backtest import quarterly_ics as information_coefficient
from pitscore.operators.backtest import run_backtest
from pitscore.operators.bargain import with_bargain as bargain_score
from pitscore.operators.dca import fold_excess, simulate as simulate_dca
from pitscore.operators.factors import factor_columns
from pitscore.operators.ingest import (
    daily_closes, delisted_catalog, membership_panel, normalize_filing_sets, normalize_filings, pit_fundamentals,
)
from pitscore.operators.live import score_names, universe_scorecard, universe_snapshot
from pitscore.operators.prices import price_metrics, statement_yields
from pitscore.operators.returns import forward_returns, monthly_returns
from pitscore.operators.scoring import score_cross_section, score_panel
from pitscore.operators.screens import good_buys, scorecard
from pitscore.operators.validation import (
    bootstrap_ci, calibrate_thresholds, compare_candidates, expanding_folds, quarter_folds, search_weights, search_weights_cv,
    validate_bargain_weights,
)
from pitscore.plans.increment import append_filings, append_quarters, stored_filings
from pitscore.plans.panel import factor_panel as build_factor_panel
from pitscore.sources.readers import (
    read_company_map, read_filing_headers, read_filing_numbers, read_membership_history, read_watchlist,
)

__all__ = [
    "action_summary", "analyst_summary", "append_filings", "append_quarters", "asof_join", "bargain_score", "bootstrap_ci", "build_factor_panel",
    "calibrate_thresholds", "compare_candidates", "daily_closes", "delisted_catalog", "expanding_folds", "factor_columns",
    "fold_excess", "forward_returns", "good_buys", "information_coefficient", "membership_panel", "monthly_returns",
    "normalize_filing_sets", "normalize_filings", "period_summary", "pit_fundamentals", "price_metrics",
    "prices_at_quarters", "quarter_folds", "read_company_map", "read_filing_headers", "read_filing_numbers",
    "read_membership_history", "read_watchlist", "run_backtest", "score_cross_section", "score_names", "score_panel",
    "scorecard", "search_weights", "search_weights_cv", "simulate_dca", "universe_scorecard", "universe_snapshot",
    "validate_bargain_weights",
    "statement_yields", "stored_filings",
]
