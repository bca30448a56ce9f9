"""Many weight sets at once: rows are expanded by a literal list of candidates.

Family percentiles do not depend on weights, so a panel is scored once. The list is a parameter
(a few hundred rows at most); expanding it next to the data shuffles nothing, and everything that
follows aggregates on the map side per (candidate, quarter).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscore.params import HISTORICAL_FAMILIES


def candidate_list(candidates: Mapping[str, Mapping[str, float]], names: Sequence[str]) -> Column:
    """Literal array of ``struct(candidate, <weight per name>)``."""
    rows = [{"candidate": k, **{n: float(w.get(n, 0.0)) for n in names}} for k, w in candidates.items()]
    schema = "array<struct<candidate: string, " + ", ".join(f"{n}: double" for n in names) + ">>"
    return F.from_json(F.lit(json.dumps(rows)), schema)


def _weighted(parts: list[tuple[Column, Column]]) -> Column:
    total, mass = F.lit(0.0), F.lit(0.0)
    for value, weight in parts:
        total = total + F.coalesce(value * weight, F.lit(0.0))
        mass = mass + F.when(value.isNotNull(), weight).otherwise(0.0)
    return nine_decimals(F.try_divide(total, mass))


def nine_decimals(c: Column) -> Column:
    """A score rounded half up, in double arithmetic: ``round`` goes through a decimal for every value.

    ``c`` is used once, so that the code generated for the many expanded rows stays small.
    """
    return F.floor(c * 1e9 + 0.5) / 1e9


def _numbers(df: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
    """``df`` with ``_p_<name>``: the values that are weighted, NULL for NaN; formed before rows are expanded."""
    return df.withColumns({f"_p_{n}": F.nullif(F.col(f"{prefix}{n}"), F.lit(float("nan"))) for n in names})


def with_candidate_scores(
    df: DataFrame,
    candidates: Mapping[str, Mapping[str, float]],
    names: Sequence[str] = HISTORICAL_FAMILIES,
    prefix: str = "pct_",
    out: str = "composite",
) -> DataFrame:
    """One row per input row and candidate, with ``candidate`` and the score under its weights."""
    expanded = _numbers(df, names, prefix).withColumn("_w", F.explode(candidate_list(candidates, names)))
    score = _weighted([(F.col(f"_p_{n}"), F.col(f"_w.{n}")) for n in names])
    return expanded.withColumns({"candidate": F.col("_w.candidate"), out: score}).drop("_w", *[f"_p_{n}" for n in names])


def score_groups(
    candidates: Mapping[str, Mapping[str, float]], names: Sequence[str] = HISTORICAL_FAMILIES, prefix: str = "pct_"
) -> list[tuple[list[str], Callable[[DataFrame], DataFrame], Column]]:
    """Candidates with the same weighted names, a function that adds one row per candidate (``pos``) with its score
    (``_a``), and where the scores are numbers.

    A score is NULL where all names that its candidate weighs are: so the scores of one group are numbers in the same rows.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for candidate, weights in candidates.items():
        groups.setdefault(tuple(n for n in names if weights.get(n, 0.0) > 0), []).append(candidate)
    out = []
    for weighed, members in groups.items():
        listed = candidate_list({c: candidates[c] for c in members}, names)

        def expand(df: DataFrame, listed: Column = listed) -> DataFrame:
            score = _weighted([(F.col(f"_p_{n}"), F.col(f"_w.{n}")) for n in names])
            return _numbers(df, names, prefix).select("*", F.posexplode(listed).alias("pos", "_w")).withColumn("_a", score).drop("_w")

        valid = F.lit(False)
        for n in weighed:
            valid = valid | F.col(f"{prefix}{n}").isNotNull()
        out.append((members, expand, valid))
    return out
