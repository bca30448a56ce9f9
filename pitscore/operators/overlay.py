"""Live rows over the stored universe, and alignment of single-name scores with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscore.functions.columns import clean_ticker, is_meaningful
from pitscore.operators.screens import with_good_buy
from pitscore.params import FAMILIES, Thresholds

# Columns that a live row refreshes; everything else stays as stored.
METADATA = ("name", "sector", "industry", "price", "market_cap")
PRICE_SENSITIVE = ("momentum_12_1", "low_volatility", "volatility_12m", "max_drawdown", "downside_deviation")
ZERO_IS_MISSING = ("earnings_revisions",)


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def overlay_live(universe: DataFrame, live: DataFrame) -> DataFrame:
    """Universe in which live rows replace their stored row.

    The stored value wins except for display metadata and price-sensitive signals, which take a
    meaningful live value; a name that only repeats the ticker is ignored. Tickers without a
    stored row keep their live row.
    """
    u = universe.withColumn("ticker", clean_ticker("ticker"))
    v = live.withColumn("ticker", clean_ticker("ticker"))
    columns = [c for c in dict.fromkeys([*universe.columns, *live.columns]) if c != "ticker"]

    def side(df: DataFrame, alias: str, name: str) -> Column:
        return F.col(f"{alias}.{name}") if name in df.columns else F.lit(None)

    def merged(name: str) -> Column:
        stored, fresh = side(universe, "u", name), side(live, "v", name)
        if name not in live.columns:
            return stored.alias(name)
        refresh = F.lit(False)
        if name in METADATA or name in PRICE_SENSITIVE:
            refresh = is_meaningful(fresh, _type(live, name), name in ZERO_IS_MISSING)
            if name == "name":
                refresh = refresh & ~fresh.eqNullSafe(F.col("v.ticker"))
        return F.when(F.col("u.ticker").isNull() | refresh, fresh).otherwise(stored).alias(name)

    joined = u.alias("u").join(v.alias("v"), F.col("u.ticker") == F.col("v.ticker"), "full_outer")
    return joined.select(F.coalesce("u.ticker", "v.ticker").alias("ticker"), *[merged(c) for c in columns])


def display_field(live: Column, stored: Column, ticker: Column, is_name: bool = False) -> Column:
    """Live text if meaningful, else stored text if meaningful, else what live holds."""
    fresh = F.when(~live.eqNullSafe(ticker), live) if is_name else live
    kept = F.when(is_meaningful(stored, "string"), stored).otherwise(fresh)
    if is_name:
        kept = F.when(stored == ticker, ticker).otherwise(kept)
    return F.when(is_meaningful(fresh, "string"), fresh).otherwise(kept)


def align_with_universe(analysis: DataFrame, scored_universe: DataFrame, thresholds: Thresholds) -> DataFrame:
    """Replace composite, coverage and percentiles by those of the scored universe and gate again."""
    replaced = [f"pct_{f}" for f in FAMILIES] + ["composite", "factor_coverage_pct"]
    stored = scored_universe.select("ticker", F.lit(True).alias("_known"), *[F.col(c).alias(f"_s_{c}") for c in replaced])
    joined = analysis.join(stored, "ticker", "left")
    aligned = joined.withColumns({c: F.when(F.col("_known"), F.col(f"_s_{c}")).otherwise(F.col(c)) for c in replaced})
    return with_good_buy(aligned.drop("_known", *[f"_s_{c}" for c in replaced]), thresholds)
