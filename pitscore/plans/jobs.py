"""Batch jobs over stored tables: build the panel store, validate weights, score a watchlist."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitscore import params
from pitscore.operators import asof, candidates, dca, ingest, live, overlay, returns, scoring, screens, validation
from pitscore.plans.panel import factor_panel
from pitscore.sources import writers


def read_store(spark: SparkSession, root: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{root}/{n}") for n in names]


def build_store(
    history: DataFrame,
    fundamentals: DataFrame,
    prices: DataFrame,
    universe: DataFrame,
    quarters: Sequence[date],
    root: str,
) -> None:
    """Write membership, fundamentals, prices, delisted names and the factor panel.

    Every step reads the written table of the step before, so a restart repeats one step only.
    """
    spark = history.sparkSession
    writers.write_table(ingest.membership_panel(history, quarters), f"{root}/membership")
    writers.write_table(fundamentals, f"{root}/fundamentals")
    writers.write_table(ingest.daily_closes(prices), f"{root}/prices")
    members, filed, closes = read_store(spark, root, "membership", "fundamentals", "prices")
    writers.write_table(ingest.delisted_catalog(members, closes), f"{root}/delisted")
    panel = ingest.first_sector(factor_panel(members, closes, filed), universe)
    writers.write_table(panel, f"{root}/panel", partition_by="quarter_end")


def validate_store(
    spark: SparkSession, root: str, gate: params.Thresholds = params.NEUTRAL_GATE
) -> dict[str, DataFrame]:
    """Candidate comparison, bargain weights, thresholds and the periodic-investment comparison of
    the current and the recommended weights; results are written as JSON under ``results``."""
    panel, prices, delisted = read_store(spark, root, "panel", "prices", "delisted")
    quarters = asof.panel_quarters(panel)
    named = params.named_candidates()
    writers.write_table(scoring.score_panel(panel, named["evidence_based"]), f"{root}/scored")
    writers.write_table(asof.prices_at_quarters(prices, quarters), f"{root}/grid")
    writers.write_table(returns.forward_returns(panel, prices, quarters), f"{root}/forward")
    scored, grid, forward = read_store(spark, root, "scored", "grid", "forward")
    results = {
        "weight_candidates": validation.compare_candidates(scored, grid, forward, quarters, delisted, named, gate),
        "bargain_weights": validation.validate_bargain_weights(panel, forward),
        "thresholds": validation.calibrate_thresholds(scored, forward),
        "dca": dca_validation(scored, grid, quarters, delisted, named["legacy_tuned"], named["evidence_based"], gate, gate),
    }
    for name, df in results.items():
        writers.write_result(df, f"{root}/results/{name}")
    return {name: spark.read.json(f"{root}/results/{name}") for name in results}


def search_store(
    spark: SparkSession,
    root: str,
    samples: int = 500,
    cv_samples: int = 200,
    seed: int = 42,
    windows: Sequence[params.Window] = params.PRODUCTION_WINDOWS,
    rolling_months: int = params.ROLLING_MONTHS,
    folds: int = 5,
    top: int = 10,
) -> dict[str, DataFrame]:
    """Weight search over windows and over quarter folds on the tables that ``validate_store`` wrote.

    Each result keeps the winner, the baseline and the first ``top`` sets with weights and measures, how many
    sets were tried and the penalty of the objective; the bounds of the folds are a result of their own.
    Results are written as JSON under ``results``.
    """
    prices, delisted, scored, grid, forward = read_store(spark, root, "prices", "delisted", "scored", "grid", "forward")
    quarters = asof.panel_quarters(grid)
    drawn = lambda n: {
        **params.dirichlet_weights(n, seed, params.HISTORICAL_FAMILIES),
        "baseline": params.historical_weights(params.EVIDENCE_WEIGHTS),
    }
    monthly = returns.monthly_returns(prices)
    searched = validation.search_weights(scored, monthly, forward, delisted, drawn(samples), windows, rolling_months)
    by_folds = validation.search_weights_cv(scored, grid, quarters, delisted, drawn(cv_samples), folds)
    results = {}
    for name, df, n, penalty in (
        ("weight_search", searched, samples, params.DEGRADATION_PENALTY),
        ("weight_search_cv", by_folds, cv_samples, params.DISPERSION_PENALTY),
    ):
        stored = df.filter((F.col("rank") <= top) | F.col("is_winner") | (F.col("candidate") == "baseline"))
        results[name] = stored.withColumns({"samples": F.lit(n), "penalty": F.lit(float(penalty))})
    bounds = [(i, held[0], end) for i, (held, end) in enumerate(validation.quarter_folds(quarters, folds))]
    results["folds"] = spark.createDataFrame(bounds, "fold int, start date, end date")
    for name, df in results.items():
        writers.write_result(df, f"{root}/results/{name}")
    return {name: spark.read.json(f"{root}/results/{name}") for name in results}


def dca_validation(
    scored: DataFrame,
    grid: DataFrame,
    quarters: Sequence[date],
    delisted: DataFrame,
    old: Mapping[str, float],
    new: Mapping[str, float],
    old_gate: params.Thresholds,
    new_gate: params.Thresholds,
    penalties: Sequence[float] = (0.0, params.DELIST_RETURN, -1.0),
) -> DataFrame:
    """Result rows of old and new weights per delisting penalty, and of the benchmark."""
    keys, by = ["candidate", "quarter_end"], ["candidate", "delist_return"]
    rows = candidates.with_candidate_scores(scored, {"old": old, "new": new})
    picks = screens.gated_top_n(rows.filter(F.col("candidate") == "old"), old_gate, keys=keys).unionByName(
        screens.gated_top_n(rows.filter(F.col("candidate") == "new"), new_gate, keys=keys)
    )
    market = dca.benchmark_picks(grid).withColumn("candidate", F.lit("benchmark"))
    scenarios = picks.select(*keys, "ticker").unionByName(market.select(*keys, "ticker")).withColumn(
        "delist_return", F.explode(F.array(*[F.lit(float(p)) for p in penalties]))
    )
    return dca.simulate(scenarios, grid, quarters, delisted, by, delist_return=F.col("delist_return"))


def build_snapshot(
    quotes: DataFrame, statements: DataFrame, closes: DataFrame, recommendations: DataFrame, as_of: date, path: str
) -> DataFrame:
    """Write the universe snapshot of a date, stamped with the time of writing, and read it back."""
    writers.write_snapshot(live.universe_snapshot(quotes, statements, closes, recommendations, as_of), path)
    return closes.sparkSession.read.parquet(path)


def watchlist_scorecard(
    snapshot: DataFrame, live: DataFrame, watchlist: DataFrame, analysts: DataFrame, config: params.Config = params.Config()
) -> DataFrame:
    """Ordered scorecard of a watchlist: live bargain and analyst columns, composite and percentiles
    of the stored universe. ``analysts`` has ``ticker, consensus_label, implied_upside_pct``;
    ``live`` has ``bargain_score``. Funds are left out upstream."""
    weights = params.factor_weights(config.factor_weights)
    sector = "sector" if config.sector_scoring else None
    stored = scoring.score_cross_section(snapshot.withColumn("_one", F.lit(1)), ["_one"], weights, sector=sector).drop("_one")
    rows = scoring.unscored(live).join(watchlist.select("ticker"), "ticker", "left_semi").join(analysts, "ticker", "left")
    aligned = overlay.align_with_universe(rows, stored, config.thresholds)
    return screens.scorecard(aligned)

