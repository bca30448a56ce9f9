"""Factor panel: members x point-in-time prices x point-in-time fundamentals, all quarters at once.

Three shuffles, all on ticker (closes, filings, members); the rest is narrow until the panel is
written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore.operators.bargain import enrich_panel
from pitscore.operators.factors import factor_columns, historical_inputs
from pitscore.operators.ingest import field_history, with_known_fundamentals
from pitscore.operators.prices import price_metrics
from pitscore.params import FAMILIES, HISTORICAL_FAMILIES
from pitscore.sources.schemas import FIELDS

SIGNALS = tuple(s for f in HISTORICAL_FAMILIES for s in FAMILIES[f])


def historical_raw(members: DataFrame, prices: DataFrame, fundamentals: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Inputs of the factor formulas per (quarter_end, ticker); members without a price are dropped."""
    keys = members.select("quarter_end", F.upper("ticker").alias("ticker")).distinct()
    # Both histories join on ticker alone, so that the partitioning of the first join serves the rest.
    joined = price_metrics(keys, prices).join(field_history(fundamentals, fields), "ticker", "left")
    return historical_inputs(with_known_fundamentals(joined, fields))


def factor_panel(members: DataFrame, prices: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Panel ``quarter_end, ticker, price, market_cap, fifty_two_week_high``, signals, bargain columns."""
    return panel_of(historical_raw(members, prices, fundamentals))


def panel_of(raw: DataFrame) -> DataFrame:
    """The panel from inputs that ``historical_raw`` has built."""
    return enrich_panel(signals_of(raw))


def signals_of(raw: DataFrame) -> DataFrame:
    """The panel before the columns that look back over a ticker's earlier quarters."""
    wide = raw.withColumns(factor_columns())
    return wide.select("quarter_end", "ticker", "price", "market_cap", "fifty_two_week_high", *SIGNALS)
