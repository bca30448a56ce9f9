"""Cross-sectional scoring: winsorised, sector-relative z-scores as percentiles, and composites.

A cross-section (quarter, or quarter x sector) can hold any share of the rows, so it is never
brought into one task: bounds come from distributed order statistics, means and deviations from
partial aggregates, and the small statistics tables are joined back by key. Panel rows themselves
are not shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitscore.functions.columns import available_mass, mean_of, norm_cdf_values, ratio, weighted_mean_of
from pitscore.functions.distributed import quantiles
from pitscore.params import FAMILIES, HISTORICAL_FAMILIES
from pitscore.session import materialize

_CLIP = {"lo": 0.01, "hi": 0.99}
MIN_SECTOR = 5
MIN_UNIVERSE = 3


def _clip(x: Column, lo: Column, hi: Column) -> Column:
    """Clip where bounds exist; NULL stays NULL (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def _as_arrays(stats: DataFrame, keys: Sequence[str], n_signals: int, columns: Sequence[str], name: str) -> DataFrame:
    """Per key an array (signal position -> struct of statistics); at most one entry per signal."""
    entry = F.struct(*columns)
    by_signal = F.map_from_entries(F.collect_list(F.struct("i", entry)))
    at = [F.try_element_at(F.col("_m"), F.lit(i)) for i in range(n_signals)]
    return stats.groupBy(*keys).agg(by_signal.alias("_m")).select(*keys, F.array(*at).alias(name))


def _long(df: DataFrame, keys: Sequence[str], values: str = "_x") -> DataFrame:
    return df.select(*keys, F.posexplode(values).alias("i", "v")).filter(F.col("v").isNotNull())


def _moments(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean and sample deviation per signal; a constant signal has deviation exactly 0."""
    spread = F.when(F.max("v") == F.min("v"), F.when(F.count("v") > 1, F.lit(0.0))).otherwise(F.stddev_samp("v"))
    return long.groupBy(*keys, "i").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), spread.alias("std"))


def universe_bounds(df: DataFrame, keys: Sequence[str], n_signals: int) -> DataFrame:
    """1st and 99th percentile of every signal per cross-section."""
    bounds = quantiles(_long(df, keys), [*keys, "i"], "v", _CLIP)
    return materialize(_as_arrays(bounds, keys, n_signals, ["lo", "hi"], "_u"))


def with_zscores(
    df: DataFrame,
    keys: Sequence[str],
    signals: Sequence[str],
    sector: str | None = "sector",
    out: str = "z",
) -> DataFrame:
    """Add the array ``out`` with the z-score of every signal and ``<out>_w`` with clipped values.

    With a sector: values are winsorised over the cross-section, again within a sector that has
    five values, and standardised there; rows left without a score fall back to the whole
    cross-section. A constant signal scores 0, also for rows without a value.
    """
    keys, n = list(keys), len(signals)
    df = df.withColumn("_x", F.array(*[F.nullif(F.col(s).cast("double"), F.lit(float("nan"))) for s in signals]))
    positions = F.sequence(F.lit(0), F.lit(n - 1))
    bounds = universe_bounds(df, keys, n)

    def clip_all(values: Column, limits: Column) -> Column:
        return F.transform(
            positions,
            lambda i: F.when(F.get(limits, i).isNull(), F.get(values, i)).otherwise(
                _clip(F.get(values, i), F.get(limits, i)["lo"], F.get(limits, i)["hi"])
            ),
        )

    w = df.join(bounds, keys, "left").withColumn(f"{out}_w", clip_all(F.col("_x"), F.col("_u"))).drop("_x", "_u")
    whole = materialize(_as_arrays(_moments(_long(w, keys, f"{out}_w"), keys), keys, n, ["n", "mean", "std"], "_all"))

    def z(value: Column, s: Column) -> Column:
        return F.when(s["std"] == 0, 0.0).otherwise(ratio(value - s["mean"], s["std"]))

    w = w.join(whole, keys, "left")
    universe_z = lambda i: F.when(
        F.get("_all", i)["n"] >= MIN_UNIVERSE, z(F.get(f"{out}_w", i), F.get("_all", i))
    )
    if sector is None or sector not in df.columns:
        return w.withColumn(out, F.transform(positions, universe_z)).drop("_all")

    skeys = [*keys, sector]
    in_sector = _long(w.filter(F.col(sector).isNotNull()), skeys, f"{out}_w")
    inner = materialize(
        _as_arrays(quantiles(in_sector, [*skeys, "i"], "v", _CLIP).filter(F.col("n") >= MIN_SECTOR), skeys, n, ["lo", "hi"], "_b")
    )
    clipped = (
        w.join(inner, skeys)
        .withColumn("_c", F.transform(positions, lambda i: F.when(
            F.get("_b", i).isNotNull(), _clip(F.get(f"{out}_w", i), F.get("_b", i)["lo"], F.get("_b", i)["hi"])
        )))
    )
    local = materialize(
        _as_arrays(_moments(_long(clipped, skeys, "_c"), skeys), skeys, n, ["n", "mean", "std"], "_s").join(inner, skeys)
    )

    def sector_z(i: Column) -> Column:
        s, b, x = F.get("_s", i), F.get("_b", i), F.get(f"{out}_w", i)
        return F.when(s.isNotNull(), z(_clip(x, b["lo"], b["hi"]), s))

    def combined(i: Column) -> Column:
        return F.coalesce(sector_z(i), F.when(F.get(f"{out}_w", i).isNotNull(), universe_z(i)))

    return (
        w.join(local, skeys, "left")
        .withColumn(out, F.transform(positions, combined))
        .drop("_all", "_s", "_b")
    )


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _percentiles(z: pa.Array) -> pa.Array:
    """Every element's share of the normal distribution in percent; all elements of a batch at once."""
    flat = z.flatten()
    share = norm_cdf_values(flat.to_numpy(zero_copy_only=False).astype(np.float64)) * 100.0
    missing = flat.is_null().to_numpy(zero_copy_only=False)
    sizes = z.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(share, pa.float64(), mask=missing), mask=z.is_null())


def score_cross_section(
    df: DataFrame,
    keys: Sequence[str],
    weights: Mapping[str, float],
    families: Sequence[str] = tuple(FAMILIES),
    sector: str | None = "sector",
) -> DataFrame:
    """Add ``pct_<family>``, ``composite`` and ``factor_coverage_pct`` per cross-section.

    A sub-signal column that is absent counts as NULL. The composite is rounded to nine decimals:
    partial aggregates merge in any order, and rankings must not hang on the last bit.
    """
    signals = [s for f in families for s in FAMILIES[f]]
    missing = {s: F.lit(None).cast("double") for s in signals if s not in df.columns}
    df = df.withColumns(missing) if missing else df
    scored = with_zscores(df, keys, signals, sector).withColumn(
        "_p", _percentiles("z")
    )
    place = {s: i for i, s in enumerate(signals)}
    scored = scored.withColumns(
        {f"pct_{f}": mean_of([F.get("_p", F.lit(place[s])) for s in FAMILIES[f]]) for f in families}
    )
    return with_composite(scored.drop("z", "z_w", "_p"), weights, families)


def with_composite(df: DataFrame, weights: Mapping[str, float], families: Sequence[str] = tuple(FAMILIES)) -> DataFrame:
    """Weighted mean of the family percentiles that exist, and the weight share they cover."""
    parts = {f"pct_{f}": float(weights.get(f, 0.0)) for f in families}
    total = sum(float(weights.get(f, 0.0)) for f in FAMILIES)
    coverage = available_mass(parts) / total * 100.0 if total > 0 else F.lit(0.0)
    return df.withColumns(
        {
            "composite": F.round(weighted_mean_of(parts), 9),
            "factor_coverage_pct": F.when(available_mass(parts) > 0, coverage).otherwise(0.0),
        }
    )


def score_panel(panel: DataFrame, weights: Mapping[str, float], sector: str | None = "sector") -> DataFrame:
    """Score every quarter of a factor panel with the seven historical families."""
    return score_cross_section(panel, ["quarter_end"], weights, HISTORICAL_FAMILIES, sector)


def unscored(df: DataFrame) -> DataFrame:
    """Result columns of names for which no universe exists: no composite, no coverage, no buy."""
    empty = {f"pct_{f}": F.lit(None).cast("double") for f in FAMILIES}
    return df.withColumns(
        {**empty, "composite": F.lit(None).cast("double"), "factor_coverage_pct": F.lit(0.0), "is_good_buy": F.lit(False)}
    )
