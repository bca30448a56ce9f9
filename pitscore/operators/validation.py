"""Folds, bootstrap, weight search, candidate comparison and threshold calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscore import params
from pitscore.functions.distributed import quantiles
from pitscore.operators import backtest, dca, screens
from pitscore.operators.candidates import with_candidate_scores
from pitscore.session import materialize

Fold = tuple[list[date], date]


def quarter_folds(quarters: Sequence[date], k: int = 5) -> list[Fold]:
    """``k`` contiguous folds; the first ``n mod k`` hold one quarter more."""
    qs, out, start = sorted(quarters), [], 0
    for i in range(k):
        size = len(qs) // k + (1 if i < len(qs) % k else 0)
        if size:
            out.append((qs[start : start + size], qs[start + size - 1]))
        start += size
    return out


def expanding_folds(quarters: Sequence[date], min_train: int = 20, block: int = 8) -> list[Fold]:
    """Test blocks after an expanding training window; none for a series that is too short."""
    qs = sorted(quarters)
    if len(qs) <= min_train + 4:
        return []
    blocks = [qs[i : i + block] for i in range(min_train, len(qs), block)]
    return [(b, b[-1]) for b in blocks]


def comparison_folds(quarters: Sequence[date]) -> list[Fold]:
    """Expanding test blocks; a short series falls back to the last quarter of each of five folds."""
    return expanding_folds(quarters) or [([end], end) for _, end in quarter_folds(quarters, 5)]


def uniform(*key: Column) -> Column:
    """Uniform in (0, 1) from md5, the same in every layout of the data."""
    digest = F.substring(F.md5(F.concat_ws(":", *key)), 1, 8)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / 4294967296.0


def bootstrap_ci(
    values: DataFrame,
    column: str,
    by: Sequence[str] = (),
    replicates: int = params.BOOTSTRAP_REPLICATES,
    level: float = params.BOOTSTRAP_LEVEL,
    seed: int = 42,
) -> DataFrame:
    """Mean and bootstrap interval of the mean: ``by, n, mean, ci_low, ci_high``.

    ``values`` has one row per fold, quarter or month of a run. Draws are hashed from (seed,
    replicate, position), so they do not depend on how the data is laid out.
    """
    keys = list(by)
    present = values.filter(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_v"))
    numbered = present.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy("_v")))
    size = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    draws = (
        size.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_rep"))
        .select(*keys, "n", "_rep", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_pos"))
        .withColumn("_i", (F.floor(uniform(F.lit(str(seed)), F.col("_rep").cast("string"), F.col("_pos").cast("string")) * F.col("n")) + 1).cast("int"))
    )
    means = draws.join(numbered, [*keys, "_i"]).groupBy(*keys, "_rep").agg(F.avg("_v").alias("_m"))
    tail = (1.0 - level) / 2.0
    interval = means.groupBy(*keys).agg(
        F.percentile("_m", F.lit(tail)).alias("ci_low"), F.percentile("_m", F.lit(1.0 - tail)).alias("ci_high")
    )
    if keys:
        return size.join(interval, keys)
    one = F.lit(1).alias("_1")
    return size.select("*", one).join(interval.select("*", one), "_1").drop("_1")


def robust_columns() -> dict[str, Column]:
    """Objective over the held-out windows (columns ``valid_*`` and ``test_*``)."""
    v, t = F.col("valid_median_excess"), F.col("test_median_excess")
    return {
        "robust_score": F.least(v, t) - F.greatest(F.lit(0.0), v - t) * params.DEGRADATION_PENALTY,
        "worst_win_rate": F.least("valid_rolling_win_rate", "test_rolling_win_rate"),
        "mean_ic": (F.col("valid_mean_ic") + F.col("test_mean_ic")) * 0.5,
    }


def significant(c: Column, digits: int = 10) -> Column:
    """Rounded to significant digits, so that the order of summation cannot decide, whatever the size."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - (digits - 1))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.rint(c / scale) * scale)


def _ranked(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number candidates by an objective; the baseline is kept unless strictly beaten.

    One row per candidate: the whole frame is as small as the candidate list.
    """
    df = df.withColumns({c: significant(F.col(c)) for c in order})
    best = W.orderBy(*[F.desc(c) for c in order], F.asc("candidate"))
    everything = W.partitionBy()
    base = {f"_b_{c}": F.max(F.when(F.col("candidate") == "baseline", F.struct(*order))).over(everything)[c] for c in order}
    ranked = df.withColumn("rank", F.row_number().over(best)).withColumns(base)
    beats = F.struct(*order) > F.struct(*[F.col(f"_b_{c}").alias(c) for c in order])
    first_beats = F.max(F.when(F.col("rank") == 1, beats)).over(everything)
    winner = F.when(first_beats, F.col("rank") == 1).otherwise(F.col("candidate") == "baseline")
    return ranked.withColumn("is_winner", winner).drop(*base)


def _with_weights(
    df: DataFrame, candidates: Mapping[str, Mapping[str, float]], names: Sequence[str] = params.HISTORICAL_FAMILIES
) -> DataFrame:
    """Add the weights of each candidate, so that a winner can be adopted from the result."""
    rows = [(c, *[float(w.get(n, 0.0)) for n in names]) for c, w in candidates.items()]
    schema = "candidate string, " + ", ".join(f"weight_{n} double" for n in names)
    return df.join(df.sparkSession.createDataFrame(rows, schema), "candidate")


def search_weights(
    scored: DataFrame,
    monthly: DataFrame,
    forward: DataFrame,
    delisted: DataFrame,
    candidates: Mapping[str, Mapping[str, float]],
    windows: Sequence[params.Window],
    rolling_months: int = params.ROLLING_MONTHS,
) -> DataFrame:
    """Evaluate weight sets (one named ``baseline``) on all windows and rank them by robustness
    over validation and test; ``weight_<family>`` are the candidate's weights. The windows must be
    longer than ``rolling_months``, or no month has a full trailing window and the objective is 0."""
    base = scored.select("quarter_end", "ticker", *[f"pct_{f}" for f in params.HISTORICAL_FAMILIES])
    held = materialize(backtest.with_holding_returns(base, monthly, delisted))
    listed = F.explode(F.array(*[F.lit(c) for c in candidates]))
    scored_in = materialize(base.select("quarter_end").distinct()).select(listed.alias("candidate"), "quarter_end")
    sums = materialize(backtest.candidate_sums(held, candidates))
    # The objective needs the next quarter's correlation only.
    ics = backtest.candidate_ics(base, forward, candidates, horizons=["1q"])
    runs = backtest.run_backtest(scored_in, monthly, None, delisted, windows, by=["candidate"], horizons=["1q"], rolling_months=rolling_months, ics=ics, sums=sums)
    metrics = ("rolling_win_rate", "median_excess", "mean_ic", "cagr", "benchmark_cagr", "max_drawdown")
    wide = runs.groupBy("candidate").agg(
        *[F.max(F.when(F.col("window") == w.name, F.col(m))).alias(f"{w.name}_{m}") for w in windows for m in metrics]
    )
    return _with_weights(_ranked(wide.withColumns(robust_columns()), ["robust_score", "worst_win_rate", "mean_ic"]), candidates)


def search_weights_cv(
    scored: DataFrame,
    grid: DataFrame,
    quarters: Sequence[date],
    delisted: DataFrame,
    candidates: Mapping[str, Mapping[str, float]],
    k: int = 5,
    n: int = params.DCA_TOP_N,
) -> DataFrame:
    """Rank weight sets by mean less population deviation of their fold excess; sets without any pick come last."""
    base = scored.select("quarter_end", "ticker", *[f"pct_{f}" for f in params.HISTORICAL_FAMILIES])
    picks = screens.top_n(with_candidate_scores(base, candidates), n, ["candidate", "quarter_end"])
    excess = dca.fold_excess(picks, grid, quarter_folds(quarters, k), delisted, ["candidate"])
    stats = excess.groupBy("candidate").agg(
        (F.avg("excess") - F.stddev_pop("excess") * params.DISPERSION_PENALTY).alias("cv_score"),
        F.min("excess").alias("worst_fold"),
        F.avg((F.col("excess") > 0).cast("double")).alias("frac_folds_positive"),
        F.count(F.lit(1)).alias("folds"),
    )
    listed = stats.sparkSession.createDataFrame([(c,) for c in candidates], "candidate string")
    stats = listed.join(stats, "candidate", "left").fillna(0, ["folds"])
    return _with_weights(_ranked(stats, ["cv_score", "worst_fold", "frac_folds_positive"]), candidates)


def compare_candidates(
    scored: DataFrame,
    grid: DataFrame,
    forward: DataFrame,
    quarters: Sequence[date],
    delisted: DataFrame,
    candidates: Mapping[str, Mapping[str, float]],
    gate: params.Thresholds = params.NEUTRAL_GATE,
    n: int = params.DCA_TOP_N,
) -> DataFrame:
    """Named weight sets by gated periodic investment and rank correlations, one row each.

    ``indistinguishable``: the interval overlaps the best one's. The evidence-based set is
    recommended when it cannot be told from the best.
    """
    base = scored.select("quarter_end", "ticker", "bargain_score", *[f"pct_{f}" for f in params.HISTORICAL_FAMILIES])
    expanded = with_candidate_scores(base, candidates)
    keys = ["candidate", "quarter_end"]
    picks = materialize(screens.gated_top_n(expanded, gate, n, keys, ["composite"]).select(*keys, "ticker"))
    excess = materialize(dca.fold_excess(picks, grid, comparison_folds(quarters), delisted, ["candidate"]))
    interval = bootstrap_ci(excess, "excess", ["candidate"]).withColumnsRenamed(
        {"n": "folds", "mean": "excess_mean", "ci_low": "excess_ci_low", "ci_high": "excess_ci_high"}
    )
    share = excess.groupBy("candidate").agg(F.avg((F.col("excess") > 0).cast("double")).alias("frac_folds_positive"))
    ics = backtest.mean_horizon_ics(backtest.candidate_ics(base, forward, candidates), ["candidate"])
    listed = scored.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in candidates])).alias("candidate"))
    rows = (
        listed.join(ics, "candidate", "left").join(interval, "candidate", "left").join(share, "candidate", "left")
        .fillna(0.0, ["frac_folds_positive", *[f"ic_{h}" for h in params.HORIZONS]])
        .fillna(0, ["folds"])
    )
    order = W.orderBy(F.desc_nulls_last(significant(F.col("excess_mean"))), F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("candidate")))
    everything = W.partitionBy()
    first = {f"_w_{c}": F.max(F.when(F.col("rank") == 1, F.col(c))).over(everything) for c in ("excess_ci_low", "excess_ci_high")}
    ranked = rows.withColumn("primary_ic", F.col(f"ic_{params.PRIMARY_HORIZON}")).withColumn("rank", F.row_number().over(order)).withColumns(first)
    overlap = F.coalesce(
        (F.col("_w_excess_ci_low") <= F.col("excess_ci_high")) & (F.col("excess_ci_low") <= F.col("_w_excess_ci_high")), F.lit(False)
    )
    ranked = ranked.withColumn("indistinguishable", overlap)
    evidence = F.max(F.when(F.col("candidate") == "evidence_based", F.col("indistinguishable"))).over(everything)
    chosen = F.when(F.coalesce(evidence, F.lit(False)), F.col("candidate") == "evidence_based").otherwise(F.col("rank") == 1)
    return ranked.withColumn("recommended", chosen).drop(*first)


def validate_bargain_weights(
    panel: DataFrame, forward: DataFrame, candidates: Mapping[str, Mapping[str, float]] = params.BARGAIN_ALTERNATIVES
) -> DataFrame:
    """Fixed weightings of the bargain components by rank correlation; the default one is kept
    unless another is better by at least 0.01 on the primary horizon."""
    names = tuple(params.BARGAIN_WEIGHTS)
    base = panel.select("quarter_end", "ticker", *[f"bargain_{n}" for n in names])
    ics = backtest.candidate_ics(base, forward, candidates, names, "bargain_")
    rows = backtest.mean_horizon_ics(ics, ["candidate"]).withColumn("primary_ic", F.col(f"ic_{params.PRIMARY_HORIZON}"))
    everything, default = W.partitionBy(), "default_long_horizon"
    listed = F.array(*[F.lit(c) for c in candidates])
    best = F.row_number().over(W.orderBy(F.desc(significant(F.col("primary_ic"))), F.array_position(listed, F.col("candidate")))) == 1
    rows = rows.withColumn("_best", best).withColumns(
        {
            "_top": F.max(F.when(F.col("_best"), F.col("primary_ic"))).over(everything),
            "_base": F.max(F.when(F.col("candidate") == default, F.col("primary_ic"))).over(everything),
        }
    )
    winner = F.when(F.col("_top") - F.col("_base") < 0.01, F.col("candidate") == default).otherwise(F.col("_best"))
    return rows.withColumn("is_winner", winner).drop("_best", "_top", "_base")


def score_buckets(
    scored: DataFrame, forward: DataFrame, score: str, returns: str, n_buckets: int = 10
) -> DataFrame:
    """Quantile buckets of a score per quarter and their mean return:
    ``quarter_end, bucket, score_min, score_max, mean_fwd_return, n``.

    Edges are exact interpolated quantiles, equal edges collapse, intervals are closed on the
    right and the lowest edge belongs to the first bucket. Quarters with fewer than three names
    per bucket are skipped.
    """
    probs = {f"e{i}": i / n_buckets for i in range(n_buckets + 1)}
    rows = scored.filter(F.col(score).isNotNull()).select("quarter_end", "ticker", F.col(score).alias("_s"))
    edges = materialize(
        quantiles(rows, ["quarter_end"], "_s", probs).filter(F.col("n") >= n_buckets * 3)
        .select("quarter_end", F.array_distinct(F.array(*probs)).alias("_edges"))
        .filter(F.size("_edges") > 1)
    )
    below = F.size(F.filter("_edges", lambda e: e < F.col("_s")))
    placed = rows.join(edges, "quarter_end").withColumn("bucket", F.greatest(below - 1, F.lit(0)))
    fwd = forward.filter(F.col(returns).isNotNull()).select(F.col("as_of_quarter").alias("quarter_end"), "ticker", F.col(returns).alias("_r"))
    return placed.join(fwd, ["quarter_end", "ticker"]).groupBy("quarter_end", "bucket").agg(
        F.min("_s").alias("score_min"), F.max("_s").alias("score_max"),
        F.avg("_r").alias("mean_fwd_return"), F.count(F.lit(1)).alias("n"),
    )


def bucket_threshold(buckets: DataFrame, target: int = 7, default: float = 50.0) -> DataFrame:
    """Mean lower score of the first bucket from ``target`` on with positive mean return, within
    [30, 80]; the default without positive buckets. One row."""
    per = buckets.groupBy("bucket").agg(F.avg("score_min").alias("_min"), F.avg("mean_fwd_return").alias("_ret"))
    # At most n_buckets entries.
    one = per.agg(
        F.min(F.when(F.col("_ret") > 0, F.col("bucket"))).alias("_first"),
        F.max("bucket").alias("_last"),
        F.map_from_entries(F.collect_list(F.struct("bucket", "_min"))).alias("_m"),
    )
    at = F.least(F.greatest(F.lit(target), F.col("_first")), F.col("_last"))
    value = F.when(F.col("_first").isNotNull(), F.try_element_at("_m", at))
    return one.select(F.least(F.greatest(F.coalesce(value, F.lit(default)), F.lit(30.0)), F.lit(80.0)).alias("threshold"))


def calibrate_thresholds(
    scored: DataFrame, forward: DataFrame, horizon: str = params.PRIMARY_HORIZON, target: int = 7
) -> DataFrame:
    """Lower bounds of composite and bargain score from long-horizon excess returns."""
    column = f"excess_{horizon}" if f"excess_{horizon}" in forward.columns else f"fwd_{horizon}"

    def one(score: str, name: str) -> DataFrame:
        t = bucket_threshold(score_buckets(scored, forward, score, column), target)
        return t.select(F.lit(1).alias("_1"), F.col("threshold").alias(name))

    both = one("composite", "composite_min").join(one("bargain_score", "bargain_min"), "_1")
    return both.select(F.lit(horizon).alias("horizon"), F.lit(column).alias("return_column"), "composite_min", "bargain_min")
