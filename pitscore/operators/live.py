"""The live universe: snapshot of all quoted names, scores against it, and analysis of fresh rows."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore import params
from pitscore.operators import analysts, bargain, factors, ingest, overlay, prices, scoring, screens
from pitscore.session import materialize

SNAPSHOT_COLUMNS = (
    "ticker", "name", "sector", "industry", "price", "market_cap", "fifty_two_week_high", "fifty_two_week_low",
    "earnings_yield_current", "volatility_12m", "max_drawdown", "downside_deviation", *factors.SIGNALS,
)


def universe_snapshot(quotes: DataFrame, statements: DataFrame, closes: DataFrame, recommendations: DataFrame, as_of: date) -> DataFrame:
    """Factors of one date for all quoted names that are no funds.

    ``quotes`` one row per name, ``statements`` long cells, ``closes`` daily prices, ``recommendations`` counts
    per rating and period.
    """
    names = quotes.select("ticker", F.lit(as_of).alias("quarter_end"))
    metrics = prices.price_metrics(names, closes)
    values = ingest.statement_values(statements, factors.STATEMENT_NAMES)
    wide = factors.live_inputs(ingest.without_funds(quotes), factors.statement_columns(values), metrics)
    revisions = analysts.revisions_from_periods(recommendations)
    return factors.with_factors(wide).join(revisions, "ticker", "left").select(*SNAPSHOT_COLUMNS)


def score_universe(snapshot: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Percentiles and composite of every name of one snapshot."""
    one = materialize(snapshot).withColumn("_one", F.lit(1))
    return scoring.score_cross_section(one, ["_one"], weights or params.factor_weights()).drop("_one")


def analyse(
    snapshot: DataFrame, fresh: DataFrame, yields: DataFrame, consensus: DataFrame, weights: Mapping[str, float] | None = None
) -> DataFrame:
    """Fresh rows scored over the snapshot they are laid upon, with bargain and analyst columns.

    All rows of ``fresh`` are laid upon the snapshot at once, so a name is scored against the other fresh
    rows; for one name against the stored universe only, pass its row alone. ``yields`` is the
    earnings-yield history, ``consensus`` has ``ticker, consensus_label, implied_upside_pct``.
    """
    scored = score_universe(overlay.overlay_live(snapshot, fresh), weights)
    current = scored.withColumn("earnings_yield_current", F.coalesce("earnings_yield_current", "earnings_yield"))
    valued = prices.valuation_vs_own_history(current, yields)
    return bargain.with_bargain(valued).join(consensus, "ticker", "left").fillna("Unknown", ["consensus_label"])


def score_names(
    names: DataFrame, snapshot: DataFrame, fresh: DataFrame, yields: DataFrame, consensus: DataFrame,
    gate: params.Thresholds = params.Thresholds(), weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """The analysis of some tickers (``names.ticker``) with composites of the stored universe and the good-buy gate."""
    rows = analyse(snapshot, fresh, yields, consensus, weights).join(names.select("ticker").distinct(), "ticker", "left_semi")
    return overlay.align_with_universe(rows, score_universe(snapshot, weights), gate)


def universe_scorecard(
    snapshot: DataFrame, fresh: DataFrame, yields: DataFrame, consensus: DataFrame,
    gate: params.Thresholds = params.Thresholds(), weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """Ordered scorecard of the whole universe."""
    return screens.scorecard(overlay.align_with_universe(analyse(snapshot, fresh, yields, consensus, weights), score_universe(snapshot, weights), gate))
