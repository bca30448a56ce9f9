"""Batch jobs on the smallest data folder."""

from __future__ import annotations

from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitscore import params
from pitscore.operators import asof, ingest
from pitscore.plans import increment, jobs
from pitscore.plans.panel import factor_panel
from pitscore.sources import readers, samples

DATA = "/root/testdata/sf0.001"


def test_store_and_validation(spark, tmp_path):
    view = lambda n: samples.view(spark, DATA, n)
    quarters = asof.panel_quarters(asof.quarter_ends(spark, samples.START, samples.END))
    root = str(tmp_path)
    jobs.build_store(view("membership_history"), view("fundamentals"), view("prices"), view("universe"), quarters, root)
    results = jobs.validate_store(spark, root, params.Thresholds(composite_min=30.0, bargain_min=20.0))
    assert {r.candidate for r in results["weight_candidates"].collect()} == set(params.named_candidates())
    assert results["weight_candidates"].filter("recommended").count() == 1
    # Fewer than thirty names per quarter: no buckets, so both thresholds keep their default.
    t = results["thresholds"].first()
    assert (t.composite_min, t.bargain_min) == (50.0, 50.0)
    assert results["dca"].filter("candidate = 'benchmark'").count() == 3
    found = jobs.search_store(spark, root, samples=6, cv_samples=4, windows=samples.WINDOWS, rolling_months=12, folds=3, top=2)
    for name, n in (("weight_search", 6), ("weight_search_cv", 4)):
        rows = found[name].collect()
        assert sum(r.is_winner for r in rows) == 1 and {r.samples for r in rows} == {n}
        assert {1, 2} <= {r["rank"] for r in rows} and len(rows) <= 4
        base = next(r for r in rows if r.candidate == "baseline")
        weights = params.historical_weights(params.EVIDENCE_WEIGHTS)
        assert all(base[f"weight_{f}"] == pytest.approx(weights[f]) for f in params.HISTORICAL_FAMILIES)
    folds = found["folds"].orderBy("fold").collect()
    assert len(folds) == 3 and all(a.end < b.start for a, b in zip(folds, folds[1:]))


def test_watchlist_scorecard(spark):
    signals = {s: "double" for ss in params.FAMILIES.values() for s in ss}
    rows = [(t, "X", *[float(i) * k for k in range(1, len(signals) + 1)]) for i, t in enumerate("ABCDEF")]
    snapshot = spark.createDataFrame(rows, "ticker string, sector string, " + ", ".join(f"{s} double" for s in signals))
    live = snapshot.select("ticker", F.lit(80.0).alias("bargain_score")).union(spark.createDataFrame([("NEW", 80.0)], "ticker string, bargain_score double"))
    watch = spark.createDataFrame([("A",), ("F",), ("NEW",)], "ticker string")
    consensus = spark.createDataFrame([("A", "Buy", 1.0), ("F", "Buy", 1.0)], "ticker string, consensus_label string, implied_upside_pct double")
    out = jobs.watchlist_scorecard(snapshot, live, watch, consensus).collect()
    assert [r.ticker for r in out] == ["F", "A", "NEW"]
    assert [r.is_good_buy for r in out] == [True, False, False]
    assert out[2].composite is None and out[2].factor_coverage_pct == 0.0
    assert out[0].composite + out[1].composite == pytest.approx(100.0)


def test_live_chain(spark, tmp_path):
    """Snapshot job, one name and the whole universe scored through the public functions."""
    import pitscore as ps

    view = lambda n: samples.view(spark, DATA, n)
    closes = view("prices").cache()
    stored = jobs.build_snapshot(view("quotes"), view("statements"), closes, view("recs_period"), samples.END, str(tmp_path / "snapshot"))
    stored = stored.drop("snapshot_date")
    assert stored.count() == stored.select("ticker").distinct().count() > 1
    fresh = stored.select("ticker", "name", "sector", (F.col("price") * 1.1).alias("price"), "market_cap", "momentum_12_1")
    history = closes.select("ticker", F.col("trade_date").alias("period"), F.lit(0.05).alias("earnings_yield")).limit(0)
    consensus = stored.select("ticker", F.lit("Buy").alias("consensus_label"), F.lit(1.0).alias("implied_upside_pct"))
    name = stored.orderBy("ticker").select("ticker").limit(1)
    one = ps.score_names(name, stored, fresh, history, consensus).collect()
    assert len(one) == 1
    universe = ps.universe_scorecard(stored, fresh, history, consensus).collect()
    assert len(universe) == stored.count()
    same = [r for r in universe if r.ticker == one[0].ticker]
    assert same[0].composite == one[0].composite


def write_set(folder, label, rows):
    """Header and number files of a data set; rows are (filing, cik, filed, amount)."""
    (folder / label).mkdir(exist_ok=True)
    (folder / label / "sub.txt").write_text("adsh\tcik\tform\tperiod\tfiled\n" + "".join(f"{a}\t{c}\t10-Q\t20200331\t{d}\n" for a, c, d, _ in rows))
    (folder / label / "num.txt").write_text("adsh\ttag\tddate\tqtrs\tvalue\n" + "".join(f"{a}\tAssets\t20200331\t0\t{v}\n" for a, _, _, v in rows))


def test_data_sets_are_loaded_once(spark, tmp_path):
    files, root = tmp_path / "in", str(tmp_path / "store")
    files.mkdir()
    sub, num = str(files / "*" / "sub.txt"), str(files / "*" / "num.txt")
    ciks = spark.createDataFrame([(1, "A"), (2, "B")], "cik long, ticker string")

    def load(**kw):
        return increment.append_filings(spark, sub, num, ciks, root, **kw)

    def rows(df):
        return sorted(map(str, df.select("ticker", "cik", "field", "amount", "period", "filed", "form", "tag", "qtrs", "dataset_quarter").collect()))

    def whole():
        return ingest.normalize_filing_sets(readers.read_filing_headers(spark, sub), readers.read_filing_numbers(spark, num), ciks)

    write_set(files, "2020q2", [("x1", 1, "20200501", 5), ("x2", 2, "20200601", 6)])
    write_set(files, "2020q3", [("x3", 1, "20200801", 7)])
    assert load() == (["2020q2", "2020q3"], date(2020, 5, 1))
    assert load() == ([], None)
    # The same filing in a later set wins, a set whose files changed is replaced, an unfinished one waits.
    write_set(files, "2020q4", [("x1", 1, "20200501", 50), ("x4", 2, "20201101", 8)])
    assert load() == (["2020q4"], date(2020, 5, 1))
    assert rows(increment.stored_filings(spark, root)) == rows(whole())
    write_set(files, "2020q3", [("x5", 2, "20200901", 70)])
    assert load() == (["2020q3"], date(2020, 8, 1))
    assert rows(increment.stored_filings(spark, root)) == rows(whole())
    write_set(files, "2020q3", [])
    (files / "2021q1").mkdir()
    (files / "2021q1" / "sub.txt").write_text("adsh\tcik\tform\tperiod\tfiled\n")
    assert load() == (["2020q3"], date(2020, 8, 1))
    (files / "2021q1" / "sub.txt").write_text("adsh\tcik\tform\tperiod\tfiled\nx9\t1\t10-K\t20201231\t20210201\n")
    (files / "2021q1" / "num.txt").write_text("adsh\ttag\tddate\tqtrs\tvalue\nx9\tAssets\t20201231\t0\t9\n")
    assert load() == (["2021q1"], date(2021, 2, 1))
    assert rows(increment.stored_filings(spark, root)) == rows(whole())
    assert len(load(force=True)[0]) == 4
    assert rows(increment.stored_filings(spark, root)) == rows(whole())


def test_appended_quarters_equal_a_full_panel(spark, tmp_path):
    view = lambda n: samples.view(spark, DATA, n)
    quarters = asof.panel_quarters(asof.quarter_ends(spark, samples.START, samples.END))
    members = ingest.membership_panel(view("membership_history"), quarters).cache()
    closes, filed, universe, root = view("prices").cache(), view("fundamentals").cache(), view("universe"), str(tmp_path)
    cut = quarters[-5]
    early = [df.filter(F.col(c) <= cut) for df, c in ((closes, "trade_date"), (filed, "filed"))]
    assert increment.append_quarters(members, *early, universe, quarters[:-4], root) == quarters[:-4]
    assert increment.append_quarters(members, *early, universe, quarters[:-4], root) == []
    assert increment.append_quarters(members, closes, filed, universe, quarters[:-1], root) == quarters[-4:-1]
    assert increment.append_quarters(members, closes, filed, universe, quarters, root, changed_from=quarters[-2]) == quarters[-2:]
    full = ingest.first_sector(factor_panel(members, closes, filed), universe).toPandas()
    got = spark.read.parquet(f"{root}/panel").toPandas()[full.columns]
    key = ["quarter_end", "ticker"]
    pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True), full.sort_values(key, ignore_index=True), check_dtype=False)
    assert full["valuation_vs_history"].notna().any()
