"""Cross-sections taken whole against rows expanded by weight set."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from pitscore import params
from pitscore.functions.distributed import rank_correlation
from pitscore.operators import backtest, crosssections, screens
from pitscore.operators.candidates import with_candidate_scores

NAMES = ("value", "quality", "momentum")
CANDIDATES = {**params.dirichlet_weights(9, 3, NAMES), "one": {"value": 1.0}, "none": {}, "odd": {"value": 2.0, "quality": -1.0, "momentum": 0.5}}
KIND = "quarter_end date, ticker string, " + ", ".join(f"pct_{n} double" for n in NAMES) + ", held array<struct<month: date, value: double, seen: boolean>>"


def _held(spark):
    rng = random.Random(8)
    rows = []
    for q, n in ((date(2001, 3, 31), 60), (date(2001, 6, 30), 7), (date(2001, 9, 30), 1)):
        for i in range(n):
            pct = [rng.choice((None, float("nan"), 50.0, 50.0, rng.uniform(0, 100), float(rng.randrange(4)))) for _ in NAMES]
            held = [(q.replace(day=28), rng.choice((None, rng.uniform(-1, 1))), rng.random() < 0.5) for _ in range(3)]
            ticker = rng.choice((None, f"T{rng.randrange(20)}", f"Ü{i}", f"t{i}"))
            rows += [(q, ticker, *pct, held)] * rng.choice((1, 1, 1, 2))
    df = spark.createDataFrame(rows, KIND)
    return df.withColumn("held", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(backtest.month_after(F.col("quarter_end"), k + 1).alias("month"), F.get("held", k)["value"].alias("value"), F.get("held", k)["seen"].alias("seen"))))


def _rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("group_rows", "block"), [(1000, 128), (1000, 4), (10, 5), (0, 128)])
def test_sums_of_the_best_are_those_of_expanded_rows(spark, monkeypatch, group_rows, block):
    monkeypatch.setattr(crosssections, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(crosssections, "BLOCK", block)
    held = _held(spark).localCheckpoint()
    expanded = with_candidate_scores(held, CANDIDATES, NAMES)
    expected = backtest.portfolio_sums(screens.top_fraction(expanded, ["candidate", "quarter_end"]), ["candidate"])
    got = backtest.candidate_sums(held, CANDIDATES, NAMES)
    assert sorted(got.columns) == sorted(expected.columns)
    found = _rows(got.select(*expected.columns))
    assert found == _rows(expected) and len(found) > 60


@pytest.mark.parametrize("group_rows", [1000, 20, 0])
def test_correlations_are_those_of_expanded_rows(spark, monkeypatch, group_rows):
    monkeypatch.setattr(crosssections, "GROUP_ROWS", group_rows)
    rng = random.Random(5)
    held = _held(spark).drop("held").filter("ticker is not null").localCheckpoint()
    keys = [(r.quarter_end, r.ticker) for r in held.select("quarter_end", "ticker").distinct().collect()]
    rows = [(q, t, *[rng.choice((None, float("nan"), 0.0, rng.uniform(-1, 1))) for _ in range(4)]) for q, t in sorted(keys)]
    forward = spark.createDataFrame(rows, "as_of_quarter date, ticker string, " + ", ".join(f"fwd_{h} double" for h in params.HORIZONS))
    got = backtest.candidate_ics(held, forward, CANDIDATES, NAMES).collect()
    returns = backtest._long_forward(forward, list(params.HORIZONS))
    expected = {}
    for candidate, weights in CANDIDATES.items():
        valid = F.lit(False)
        for n in NAMES:
            valid = valid | (F.col(f"pct_{n}").isNotNull() if weights.get(n, 0.0) > 0 else F.lit(False))
        scored = with_candidate_scores(held.filter(valid), {candidate: weights}, NAMES).join(returns, ["quarter_end", "ticker"])
        # A score that is no number is the least of its cross-section.
        scored = scored.fillna(-1e6, ["composite"])
        for r in rank_correlation(scored, ["horizon", "quarter_end"], "composite", "fwd").collect():
            expected[candidate, r.horizon, r.quarter_end] = r.ic
    assert len(got) == len(expected) > 50
    for r in got:
        assert r.ic == pytest.approx(expected[r.candidate, r.horizon, r.quarter_end], abs=1e-9), r


def test_a_weight_search_expands_no_rows(spark, monkeypatch):
    """The rows of a quarter are sent once for each block of weight sets, not for each weight set."""
    monkeypatch.setattr(crosssections, "BLOCK", 6)
    held = _held(spark)
    plan = backtest.candidate_sums(held, CANDIDATES, NAMES)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Window" not in plan
    assert plan.count("explode") == 1 and "_block" in plan and "from_json" not in plan
