"""Operators on small frames, checked against brute force or known answers."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitscore import params
from pitscore.functions import distributed
from pitscore.operators import analysts, asof, backtest, dca, ingest, overlay, prices, returns, scoring, screens, validation
from pitscore.sources import readers, writers


def skewed(n=600, seed=3):
    """Two groups, one holding most rows; ties, negatives, zeros, wide ranges and NULLs."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if i % 4 else "cold"
        v = rng.choice([None, 0.0, 1.0, 1.0, -rng.random(), rng.gauss(0, 1e6), 1 + rng.random() * 1e-9, rng.expovariate(1)])
        out.append((g, f"t{i:04d}", v))
    return out


def test_quantiles_match_numpy(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "g string, ticker string, v double")
    got = {r.g: r for r in distributed.quantiles(df, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.99, "d": 1.0, "e": 0.0}).collect()}
    for g in ("hot", "cold"):
        v = [x for k, _, x in rows if k == g and x is not None]
        assert got[g].n == len(v)
        assert [got[g][c] for c in "abcde"] == pytest.approx(np.quantile(v, [0.01, 0.5, 0.99, 1.0, 0.0]))


def test_ranks_and_rank_correlation_match_pandas(spark):
    rows = skewed(400)
    rng = random.Random(5)
    pdf = pd.DataFrame([(g, t, v, rng.choice([1.0, 2.0, rng.random()])) for g, t, v in rows], columns=["g", "ticker", "v", "w"])
    df = spark.createDataFrame([tuple(None if pd.isna(x) else x for x in r) for r in pdf.itertuples(index=False)], "g string, ticker string, v double, w double")
    ranks = {(r.g, r.v): r.avg_rank for r in distributed.average_ranks(df, ["g"], "v").collect()}
    expected = pdf.dropna().assign(r=pdf.dropna().groupby("g")["v"].rank())
    assert all(ranks[(x.g, x.v)] == x.r for x in expected.itertuples())
    ics = {r.g: r.ic for r in distributed.rank_correlation(df, ["g"], "v", "w").collect()}
    for g, part in pdf.dropna().groupby("g"):
        assert ics[g] == pytest.approx(np.corrcoef(part["v"].rank(), part["w"].rank())[0, 1])
    flat = distributed.rank_correlation(df.withColumn("w", F.lit(1.0)), ["g"], "v", "w").collect()
    assert all(r.ic is None for r in flat)


def test_top_fraction_with_ties(spark):
    rows = [(date(2020, 3, 31), f"t{i:03d}", 50.0 if i % 3 else float(i)) for i in range(101)]
    df = spark.createDataFrame(rows, "quarter_end date, ticker string, composite double")
    got = {r.ticker for r in screens.top_fraction(df).collect()}
    n = int(np.ceil(101 * 0.20))
    best = sorted(rows, key=lambda r: (-r[2], r[1]))[:n]
    assert got == {t for _, t, _ in best}


def test_asof_join(spark):
    left = spark.createDataFrame([("A", date(2020, 1, 5), 1), ("A", date(2020, 1, 5), 2), ("A", date(2019, 1, 1), 3), ("B", date(2020, 1, 9), 4)], "k string, d date, id int")
    right = spark.createDataFrame([("A", date(2020, 1, 1), 1.0), ("A", date(2020, 1, 5), 2.0), ("A", date(2020, 1, 6), 3.0), ("B", date(2020, 1, 1), 9.0)], "k string, t date, v double")
    got = {r.id: r.v for r in asof.asof_join(left, right, ["k"], "d", "t", ["v"]).collect()}
    assert got == {1: 2.0, 2: 2.0, 3: None, 4: 9.0}
    fresh = {r.id: r.v for r in asof.asof_join(left, right, ["k"], "d", "t", ["v"], max_staleness_days=3).collect()}
    assert fresh == {1: 2.0, 2: 2.0, 3: None, 4: None}


def test_prices_carry_forward(spark):
    qs = [date(2020, 3, 31), date(2020, 6, 30), date(2020, 12, 31)]
    df = spark.createDataFrame([("A", date(2020, 2, 1), 1.0), ("A", date(2020, 7, 1), 2.0), ("A", date(2020, 10, 1), 3.0), ("B", date(2021, 2, 1), 5.0)], "ticker string, trade_date date, close double")
    got = {(r.ticker, r.q): r.price for r in asof.prices_at_quarters(df, qs).collect()}
    assert got == {("A", 0): 1.0, ("A", 1): 1.0, ("A", 2): 3.0}


def test_monthly_returns_fill_gaps(spark):
    df = spark.createDataFrame([("A", date(2020, 1, 10), 100.0), ("A", date(2020, 1, 20), 110.0), ("A", date(2020, 4, 2), 121.0)], "ticker string, trade_date date, close double")
    got = {r.month: r["return"] for r in returns.monthly_returns(df).collect()}
    assert got == {date(2020, 2, 29): 0.0, date(2020, 3, 31): 0.0, date(2020, 4, 30): pytest.approx(0.1)}


def pandas_price_metrics(closes):
    s = pd.Series(closes).tail(400)
    year = s.tail(252)
    ret = year.pct_change().dropna()
    fallen = ret[ret < 0]
    d = s.diff()
    gain, loss = (x.clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean().iloc[-1] for x in (d, -d))
    enough = len(year) >= 60
    return {
        "price": s.iloc[-1],
        "volatility_12m": ret.std() * np.sqrt(252) if enough else None,
        "downside_deviation": (fallen.std() * np.sqrt(252) if len(fallen) else 0.0) if enough else None,
        "max_drawdown": (year / year.cummax() - 1).min() if enough else None,
        "momentum_12_1": s.iloc[-22] / s.iloc[-252] - 1 if len(s) >= 252 else None,
        "fifty_two_week_high": year.max(),
        "fifty_two_week_low": year.min(),
        "all_time_high": s.max(),
        "rsi_14": (100 - 100 / (1 + gain / loss) if loss else 100.0 if gain else 50.0) if len(s) >= 15 else None,
    }


def test_price_metrics_match_pandas(spark):
    """Every metric at dates on both sides of block, year and look-back limits, and between trading days."""
    rng = random.Random(1)
    day, close, rows = date(2020, 1, 1), 100.0, []
    for _ in range(700):
        day, close = day + timedelta(days=rng.choice((1, 1, 3))), close * (1 + rng.gauss(0, 0.02))
        rows.append(("A", day, close))
    rising = [("B", date(2020, 1, 1) + timedelta(days=i), 10.0 + i) for i in range(130)]
    df = spark.createDataFrame([*rows, *rising], "ticker string, trade_date date, close double")
    counts = [1, 2, 14, 15, 16, 59, 60, 61, 63, 64, 65, 66, 127, 128, 129, 192, 251, 252, 253, 254, 255, 256, 257,
              314, 315, 316, 317, 399, 400, 401, 447, 448, 449, 462, 463, 464, 465, 466, 512, 513, 576, 641, 699, 700]
    keys = [("A", rows[n - 1][1], n) for n in counts] + [("B", rising[n - 1][1], n) for n in (64, 65, 130)]
    keys += [("A", rows[-1][1] + timedelta(days=90), 700), ("A", date(2019, 12, 31), 0), ("C", date(2020, 12, 31), 0), ("A", None, 0)]
    found = prices.price_metrics(spark.createDataFrame(keys, "ticker string, quarter_end date, n int"), df).collect()
    assert sorted(r.n for r in found) == sorted(n for _, _, n in keys if n)
    for r in found:
        for name, value in pandas_price_metrics([c for _, _, c in (rows if r.ticker == "A" else rising)][: r.n]).items():
            assert r[name] == (None if value is None else pytest.approx(value, rel=1e-9, abs=1e-12)), (r.ticker, r.n, name)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_price_metrics_are_evaluated_as_matrices(spark):
    """No fold over a look-back per row; closes of zero give no return, peak or ratio."""
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(300)]
    closes = [0.0 if i in (0, 250, 280) else 10.0 + i % 7 for i in range(300)]
    df = spark.createDataFrame(list(zip(["Z"] * 300, days, closes)), "ticker string, trade_date date, close double")
    found = prices.price_metrics(spark.createDataFrame([("Z", days[-1])], "ticker string, quarter_end date"), df)
    assert plan_of(found).count("ArrowEvalPython") == 1 and "aggregate(" not in plan_of(found)
    year = closes[-252:]
    returns_ = [b / a - 1 for a, b in zip(year, year[1:]) if a]
    r = found.first()
    assert r.volatility_12m == pytest.approx(np.std(returns_, ddof=1) * np.sqrt(252)) and r.max_drawdown == -1.0 and r.fifty_two_week_low == 0.0


def test_filings_are_collected_once(spark):
    """One list per ticker and field, not a conditional list of each field over all rows."""
    fundamentals = spark.createDataFrame([("A", "ebit", 1.0, date(2020, 3, 31), date(2020, 5, 1))], "ticker string, field string, amount double, period date, filed date")
    history = ingest.field_history(fundamentals, ["ebit", "revenue"])
    assert plan_of(history).count("collect_list(") == 1
    assert history.first().asDict() == {"ticker": "A", "ebit": [(date(2020, 3, 31), date(2020, 5, 1), 1.0)], "revenue": []}


def test_candidate_scores_are_plain_arithmetic(spark):
    """No decimal rounding and no fold for each of many expanded rows; a NaN percentile counts as missing."""
    from pitscore.operators.candidates import score_groups, with_candidate_scores

    df = spark.createDataFrame([("A", 10.0, 0.0146484375), ("B", 20.0, float("nan")), ("C", None, None)], "ticker string, pct_x double, pct_y double")
    weights = {"both": {"x": 0.25, "y": 0.75}, "one": {"y": 1.0}}
    scored = with_candidate_scores(df, weights, ["x", "y"])
    assert " round(" not in plan_of(scored)
    got = {(r.ticker, r.candidate): r.composite for r in scored.collect()}
    assert got == {("A", "both"): 2.510986328, ("A", "one"): 0.014648438, ("B", "both"): 20.0, ("B", "one"): None, ("C", "both"): None, ("C", "one"): None}
    for members, expand, valid in score_groups(weights, ["x", "y"]):
        rows = expand(df.filter(valid))
        assert "transform(" not in plan_of(rows)
        assert {(r.ticker, members[r.pos]): r._a for r in rows.collect() if r._a is not None}.items() <= got.items()


def test_price_rows_hold_their_look_back_only(spark):
    days = [("A", date(1990, 1, 1) + timedelta(days=i), 50.0 + i % 7) for i in range(6000)]
    df = spark.createDataFrame(days, "ticker string, trade_date date, close double")
    keys = spark.createDataFrame([("A", days[i][1]) for i in range(100, 6000, 90)], "ticker string, quarter_end date")
    held = prices.with_price_blocks(keys, df).select(F.size("blocks").alias("n"), F.size(F.flatten(F.col("blocks.bars"))).alias("bars")).collect()
    assert len(held) == keys.count()
    assert max(r.n for r in held) == prices.BLOCK_REACH and max(r.bars for r in held) == prices.BLOCK_REACH * prices.BLOCK_ROWS


def test_pit_fundamentals_prior_and_restatement(spark):
    f = [("A", "net_income", 1.0, date(2020, 3, 31), date(2020, 5, 1)), ("A", "net_income", 2.0, date(2020, 6, 30), date(2020, 8, 1)),
         ("A", "net_income", 1.5, date(2020, 3, 31), date(2020, 9, 1)), ("A", "total_debt", 7.0, date(2020, 3, 31), date(2020, 5, 1)),
         ("A", "long_term_debt", 3.0, date(2020, 3, 31), date(2020, 8, 15))]
    fundamentals = spark.createDataFrame(f, "ticker string, field string, amount double, period date, filed date")
    keys = spark.createDataFrame([("A", d) for d in (date(2020, 6, 30), date(2020, 8, 10), date(2020, 9, 30))], "ticker string, quarter_end date")
    fields = ("net_income", "total_debt", "long_term_debt", "book_equity", "shares_outstanding", "total_debt_current", "total_debt_noncurrent")
    got = {r.quarter_end: (r.net_income, r.net_income_prior, r.total_debt) for r in ingest.pit_fundamentals(keys, fundamentals, fields).collect()}
    assert got == {date(2020, 6, 30): (1.0, None, 7.0), date(2020, 8, 10): (2.0, 1.0, 7.0), date(2020, 9, 30): (2.0, 1.5, 3.0)}


def test_statement_values(spark):
    rows = [("A", "EBIT", date(2022, 1, 1), None), ("A", "Operating Income", date(2020, 1, 1), 5.0), ("A", "Operating Income", date(2021, 1, 1), 6.0), ("A", "Net Income", date(2022, 1, 1), 9.0)]
    df = spark.createDataFrame(rows, "ticker string, metric string, period date, value double")
    got = {r.field: (r.metric, r.latest, r.prior, r.stale) for r in ingest.statement_values(df, {"ebit": ["EBIT", "Operating Income"], "net_income": ["Net Income"]}).collect()}
    assert got == {"ebit": ("Operating Income", 6.0, 5.0, True), "net_income": ("Net Income", 9.0, None, False)}


def test_sector_scores_match_pandas(spark):
    rng = random.Random(11)
    rows = [(f"t{i}", "big" if i < 30 else "mid" if i < 42 else "tiny" if i < 45 else None, None if i % 9 == 0 else rng.gauss(0, 1), 1.0 if i % 2 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "ticker string, sector string, a double, b double").withColumn("quarter_end", F.lit(date(2020, 3, 31)))
    got = {r.ticker: r.z for r in scoring.with_zscores(df, ["quarter_end"], ["a", "b"]).collect()}
    pdf = pd.DataFrame(rows, columns=["ticker", "sector", "a", "b"]).set_index("ticker")

    def clip(s):
        return s.clip(s.quantile(0.01), s.quantile(0.99))

    def z(s):
        return (s - s.mean()) / s.std()

    w = clip(pdf["a"])
    for sector, part in w.groupby(pdf["sector"]):
        expected = z(clip(part)) if part.count() >= 5 else z(w)[part.index]
        for t, e in expected.items():
            assert got[t][0] == (None if pd.isna(e) else pytest.approx(e))
    assert got["t49"][0] == pytest.approx(z(w)["t49"])
    # A constant signal scores 0, in a sector also where the value is missing.
    assert got["t0"][1] == 0.0 and got["t1"][1] == 0.0
    assert got["t44"][1] is None and got["t43"][1] == 0.0


def test_rebalance_and_drawdown_against_loop(spark):
    rng = random.Random(2)
    qs = [date(2018 + i // 4, (3, 6, 9, 12)[i % 4], (31, 30, 30, 31)[i % 4]) for i in range(10)]
    names = ["A", "B", "C", "D"]
    price = {(t, q): 10 + rng.random() * 10 for t in names for q in range(10)}
    picked = {q: rng.sample(names, rng.randint(0, 3)) for q in range(10)}
    grid = spark.createDataFrame([(t, qs[q], q, p) for (t, q), p in price.items()], "ticker string, quarter_end date, q int, price double")
    picks = spark.createDataFrame([(qs[q], t) for q, ts in picked.items() for t in ts], "quarter_end date, ticker string")
    gone = spark.createDataFrame([], "ticker string")
    for strategy in ("buy_and_hold", "rebalance"):
        cash, held, path = 0.0, {}, []
        for q in range(10):
            if strategy == "rebalance":
                for t in [t for t in held if t not in picked[q]]:
                    cash += held.pop(t) * price[t, q] * 0.999
            for t in picked[q]:
                held[t] = held.get(t, 0) + 20000 / len(picked[q]) / (price[t, q] * 1.001)
            path.append(cash + sum(s * price[t, q] for t, s in held.items()))
        got = [r.wealth for r in dca.wealth_path(picks, grid, qs, gone, strategy=strategy).orderBy("q").collect()]
        assert got == pytest.approx(path)


def test_holdings_and_portfolio(spark):
    picks = spark.createDataFrame([(date(2020, 3, 31), "A"), (date(2020, 3, 31), "Z"), (date(2020, 6, 30), "A")], "quarter_end date, ticker string")
    months = {(r.month, r.quarter_end) for r in backtest.holding_months(picks, 6).collect()}
    assert (date(2020, 7, 31), date(2020, 6, 30)) in months and (date(2020, 7, 31), date(2020, 3, 31)) not in months
    monthly = spark.createDataFrame([(date(2020, 4, 30), "A", 0.1), (date(2020, 6, 30), "A", 0.2)], "month date, ticker string, return double")
    gone = spark.createDataFrame([("Z",)], "ticker string")
    held = backtest.with_holding_returns(picks, monthly, gone)
    got = {r.month: r.port for r in backtest.portfolio_returns(held).collect()}
    assert got == {date(2020, 4, 30): pytest.approx(-0.2), date(2020, 6, 30): pytest.approx(-0.15)}


def test_bootstrap_is_bounded_and_repeatable(spark):
    df = spark.createDataFrame([(v,) for v in (0.1, 0.2, -0.1, 0.05, 0.15)], "v double")
    a, b = (validation.bootstrap_ci(df, "v", replicates=200).first() for _ in range(2))
    assert a == b and a.ci_low <= a["mean"] <= a.ci_high


def test_period_recommendations(spark):
    rows = [("A", "0m", 6, 10, 4, 0, 0), ("A", "-1m", 3, 8, 6, 1, 0), ("B", "0m", 5, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "ticker string, period string, strong_buy long, buy long, hold long, sell long, strong_sell long")
    got = {r.ticker: r for r in analysts.with_consensus(analysts.period_summary(df).withColumns({"price": F.lit(100.0), "target_mean": F.lit(120.0)})).collect()}
    assert got["A"].recent_upgrades == 6 and got["A"].recent_downgrades == 0
    assert (got["B"].mean_rating_score, got["B"].consensus_label, got["B"].implied_upside_pct) == (5.0, "Strong Buy", pytest.approx(20.0))
    assert got["B"].revision_score is None


def test_overlay(spark):
    stored = spark.createDataFrame([("A", "Alpha", "Tech", 10.0, 0.1, 0.5), ("B", "Beta", "Tech", 5.0, 0.2, 0.6)], "ticker string, name string, sector string, price double, momentum_12_1 double, roe double")
    live = spark.createDataFrame([("a", "A", " Unknown", 12.0, 0.3, 9.0), ("c", "Gamma", "Util", 7.0, None, 1.0)], stored.schema)
    got = {r.ticker: tuple(r)[1:] for r in overlay.overlay_live(stored, live).collect()}
    assert got == {"A": ("Alpha", "Tech", 12.0, 0.3, 0.5), "B": ("Beta", "Tech", 5.0, 0.2, 0.6), "C": ("Gamma", "Util", 7.0, None, 1.0)}


def test_thresholds_without_buckets(spark):
    empty = spark.createDataFrame([], "quarter_end date, bucket int, score_min double, score_max double, mean_fwd_return double, n long")
    assert validation.bucket_threshold(empty).first()["threshold"] == 50.0
    rows = [(date(2020, 3, 31), b, 10.0 * b, 10.0 * b + 9, 0.1 if b > 3 else -0.1, 5) for b in range(10)]
    assert validation.bucket_threshold(spark.createDataFrame(rows, empty.schema)).first()["threshold"] == 70.0


def test_scorecard_order(spark):
    df = spark.createDataFrame([("ZZZ", 80.0, False), ("AAA", 60.0, True), ("NNN", None, False)], "ticker string, composite double, is_good_buy boolean")
    assert [r.ticker for r in screens.scorecard(df).collect()] == ["AAA", "ZZZ", "NNN"]
    assert tuple(screens.scorecard_counts(df).first()) == (1, 3)


def test_readers(spark, tmp_path):
    (tmp_path / "2012q3").mkdir()
    (tmp_path / "2012q3" / "sub.txt").write_text("adsh\tcik\tname\tform\tperiod\tfiled\nx1\t12\tAcme\t10-K\t20120630\t20120801\nx2\tbad\tB\t10-Q\t2012\t20120801\n")
    (tmp_path / "2012q3" / "num.txt").write_text("adsh\ttag\tversion\tddate\tqtrs\tuom\tvalue\nx1\tAssets\tv\t20120630\t0\tUSD\t1.5\nx1\tAssets\tv\t20110630\t4\tUSD\t9\n")
    sub = readers.read_filing_headers(spark, str(tmp_path / "*" / "sub.txt"))
    num = readers.read_filing_numbers(spark, str(tmp_path / "*" / "num.txt"))
    rows = {r.adsh: r for r in sub.collect()}
    assert (rows["x1"].cik, rows["x1"].filed, rows["x1"].dataset_quarter) == (12, date(2012, 8, 1), "2012q3")
    assert rows["x2"].cik is None and rows["x2"].period is None
    (tmp_path / "map.json").write_text('{"0": {"cik_str": 12, "ticker": "acme ", "title": "Acme"}, "1": {"cik_str": 12, "ticker": "ACM2", "title": "x"}}')
    ciks = readers.read_company_map(spark, str(tmp_path / "map.json"))
    assert [tuple(r) for r in ciks.collect()] == [(12, "ACME", "Acme")]
    out = ingest.normalize_filing_sets(sub, num, ciks).collect()
    assert [(r.ticker, r.field, r.amount, r.qtrs, r.dataset_quarter) for r in out] == [("ACME", "total_assets", 1.5, 0, "2012q3")]
    (tmp_path / "watch").write_text("# note\n\n aapl\nMSFT \n")
    assert {r.ticker for r in readers.read_watchlist(spark, str(tmp_path / "watch")).collect()} == {"AAPL", "MSFT"}
    (tmp_path / "hist.csv").write_text('date,tickers\n2020-01-02,"BRK.B,AAPL"\nbad,"X"\n2020-05-01,"AAPL"\n')
    hist = readers.read_membership_history(spark, str(tmp_path / "hist.csv"))
    panel = {(r.quarter_end, r.ticker) for r in ingest.membership_panel(hist, [date(2020, 3, 31), date(2020, 6, 30)]).collect()}
    assert panel == {(date(2020, 3, 31), "BRK-B"), (date(2020, 3, 31), "AAPL"), (date(2020, 6, 30), "AAPL")}


def test_filing_sets_by_their_own_headers(spark, tmp_path):
    sets = {
        "2009q2": "adsh\ttag\tddate\tqtrs\tuom\tuval\na1\tAssets\t20090331\t0\tUSD\t7\n",
        "2015q1": "adsh\ttag\tversion\tddate\tqtrs\tuom\tvalue\na2\tAssets\tv\t20141231\t0\tUSD\t8\n",
        "2020q1": "tag\tadsh\tcoreg\tddate\tqtrs\tvalue\tuval\nAssets\ta3\tx\t20191231\t0\t\t9\nAssets\ta4\t\t20191231\t1\t10\t\n",
    }
    for label, text in sets.items():
        (tmp_path / label).mkdir()
        (tmp_path / label / "num.txt").write_text(text)
    rows = {r.adsh: (r.tag, r.ddate, r.qtrs, r.amount, r.dataset_quarter) for r in readers.read_filing_numbers(spark, str(tmp_path / "*" / "num.txt")).collect()}
    assert rows == {
        "a1": ("Assets", date(2009, 3, 31), 0, 7.0, "2009q2"),
        "a2": ("Assets", date(2014, 12, 31), 0, 8.0, "2015q1"),
        "a3": ("Assets", date(2019, 12, 31), 0, 9.0, "2020q1"),
        "a4": ("Assets", date(2019, 12, 31), 1, 10.0, "2020q1"),
    }
    (tmp_path / "2021q1").mkdir()
    (tmp_path / "2021q1" / "num.txt").write_text("adsh\ttag\tqtrs\tvalue\nb\tAssets\t0\t1\n")
    with pytest.raises(ValueError, match="ddate"):
        readers.read_filing_numbers(spark, str(tmp_path / "*" / "num.txt"))


def test_order_statistics_of_clustered_values(spark):
    n = 1_000_000
    # Most values lie within 0.1 of 50, a tenth is one single value, and a few are far away.
    v = F.when(F.col("id") % 10 == 3, 50.05).when(F.col("id") % 1000 == 7, F.col("id") * 1e6).otherwise(50 + F.col("id") * (0.1 / n))
    df = spark.range(n).select(F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 9 == 0, "b").otherwise("a").alias("g"), v.alias("v"))
    pdf = df.toPandas()
    probs = {"lo": 0.01, "q": 0.37, "q2": 0.3701, "m": 0.5, "hi": 0.99, "least": 0.0, "most": 1.0}
    found = distributed.quantiles(df, ["g"], "v", probs).collect()
    assert len(found) == 3
    for r in found:
        mine = pdf[pdf.g.isna() if r.g is None else pdf.g == r.g].v
        assert r.n == len(mine) and [r[k] for k in probs] == pytest.approx(list(np.quantile(mine, list(probs.values()))), rel=1e-14)


def test_large_groups_in_parts(spark, monkeypatch):
    monkeypatch.setattr(distributed, "PART_ROWS", 300)
    rng = random.Random(8)
    rows = [(rng.choice(("a", "a", "b", None)), f"t{i:05d}", rng.choice([rng.random(), 0.5, rng.gauss(0, 1e5)]), rng.choice([rng.random(), 0.25])) for i in range(6000)]
    df = spark.createDataFrame(rows, "quarter_end string, ticker string, composite double, w double").repartition(5)
    pdf = df.toPandas()
    group = pdf.groupby("quarter_end", dropna=False)
    pdf["r"], pdf["rw"] = group.composite.rank(), group.w.rank()
    ranks = {(r.quarter_end, r.composite): r.avg_rank for r in distributed.average_ranks(df, ["quarter_end"], "composite").collect()}
    assert all(ranks[None if pd.isna(x.quarter_end) else x.quarter_end, x.composite] == x.r for x in pdf.itertuples())
    both = distributed.rank_correlation(df, ["quarter_end"], F.array("composite", -F.col("composite"), "w"), "w").collect()
    assert len(both) == 9
    for r in both:
        part = pdf[pdf.quarter_end.isna() if r.quarter_end is None else pdf.quarter_end == r.quarter_end]
        expected = np.corrcoef(part.r, part.rw)[0, 1]
        assert r.ic == pytest.approx((expected, -expected, 1.0)[r.pos], abs=1e-12)
    got = sorted(r.ticker for r in screens.top_fraction(df).collect())
    best = [p.sort_values(["composite", "ticker"], ascending=[False, True]).head(int(np.ceil(len(p) * 0.2))) for _, p in group]
    assert got == sorted(t for p in best for t in p.ticker)


def test_positions(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 5000).alias("v")).repartition(7)
    assert all(r.position == r.v + 1 for r in distributed.positions(df, [F.asc("v")]).collect())
    assert distributed.positions(df.limit(0), [F.asc("v")]).collect() == []


def test_stage_of_a_rewritten_folder(spark, tmp_path):
    from pitscore.session import stage

    folder = str(tmp_path / "in")
    for n in (3, 4):
        spark.range(n).write.mode("overwrite").parquet(f"{folder}/t.parquet")
        rows = [stage(spark, (folder, "t"), lambda: spark.read.parquet(f"{folder}/t.parquet")) for _ in range(2)]
        assert rows[0] is rows[1] and rows[0].count() == n


def test_order_statistics_with_nan_and_infinity(spark):
    values = [float(i) for i in range(20)] + [float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([("x", f"t{i}", v) for i, v in enumerate(values)], "quarter_end string, ticker string, composite double")
    r = distributed.quantiles(df, ["quarter_end"], "composite", {"m": 0.5, "lo": 0.0, "hi": 1.0}).first()
    assert (r.n, r.m, r.lo, r.hi) == (22, 9.5, float("-inf"), float("inf"))
    ranks = {x.composite: x.avg_rank for x in distributed.average_ranks(df, ["quarter_end"], "composite").collect()}
    assert ranks[float("-inf")] == 1 and ranks[0.0] == 2 and ranks[float("inf")] == 22 and len(ranks) == 22
    assert {x.composite for x in screens.top_fraction(df).collect()} == {float("inf"), 19.0, 18.0, 17.0, 16.0}


def test_nan_closes_are_no_closes(spark):
    days = [("A", date(2020, 1, 30), 1.0), ("A", date(2020, 1, 31), float("nan")), ("A", date(2020, 2, 28), 2.0), ("A", date(2020, 3, 31), float("nan"))]
    px = spark.createDataFrame(days, "ticker string, trade_date date, close double")
    assert {r.month: r["return"] for r in returns.monthly_returns(px).collect()} == {date(2020, 2, 29): 1.0}
    assert [r.price for r in asof.prices_at_quarters(px, [date(2020, 3, 31)]).collect()] == [2.0]
    assert prices.all_time_highs(px).first().all_time_high == 2.0
    assert {r.trade_date.day: r.sma for r in prices.moving_average(px, 2).collect()}[28] is None


def test_undated_statement_cells_give_way(spark):
    cells = [("A", "x", date(2020, 1, 1), 5.0), ("A", "x", None, 99.0), ("B", "x", None, 7.0)]
    df = spark.createDataFrame(cells, "ticker string, metric string, period date, value double")
    got = {r.ticker: (r.latest, r.prior) for r in ingest.statement_values(df, {"f": ("x",)}, ["ticker"]).collect()}
    assert got == {"A": (5.0, None), "B": (7.0, None)}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(date(2020, 3, 31), "A", 1.0), (date(2020, 6, 30), "B", 2.0)], "quarter_end date, ticker string, v double")
    writers.write_table(df, str(tmp_path / "t"), "quarter_end")
    assert spark.read.parquet(str(tmp_path / "t")).filter(F.col("quarter_end") == date(2020, 6, 30)).count() == 1
    writers.write_snapshot(df, str(tmp_path / "s"))
    assert "T" in spark.read.parquet(str(tmp_path / "s")).first()["snapshot_date"]
    writers.write_result(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_benchmark_appended_only_when_absent(spark):
    stocks = spark.createDataFrame([("A", date(2020, 1, 1), 1.0)], "ticker string, trade_date date, close double")
    other = spark.createDataFrame([(params.BENCHMARK, date(2020, 1, 1), 3.0)], stocks.schema)
    assert ingest.with_benchmark(stocks, other).count() == 2
    assert ingest.with_benchmark(stocks.union(other), other.withColumn("close", F.lit(9.0))).filter("close = 9").count() == 0


def test_values_by_period_choose_names_per_key(spark):
    cells = [
        ("A", "EBIT", date(2020, 3, 31), None), ("A", "Operating Income", date(2020, 3, 31), 5.0),
        ("A", "EBIT", date(2020, 6, 30), 7.0), ("A", "Operating Income", date(2020, 6, 30), 6.0),
        ("B", "Operating Income", date(2020, 3, 31), 3.0), ("B", "Operating Income", None, 9.0),
        ("C", "EBIT", None, 1.0), ("C", "Operating Income", date(2020, 3, 31), 2.0),
        ("D", "EBIT", date(2020, 3, 31), float("nan")), ("D", "EBIT", date(2020, 3, 31), 4.0), ("E", "Sales", date(2020, 3, 31), 4.0),
    ]
    df = spark.createDataFrame(cells, "ticker string, metric string, period date, value double")
    got = {(r.ticker, r.period): r.ebit for r in ingest.values_by_period(df, {"ebit": ["EBIT", "Operating Income"], "none": ["x"]}).collect()}
    q1, q2 = date(2020, 3, 31), date(2020, 6, 30)
    assert got == {("A", q1): None, ("A", q2): 7.0, ("B", q1): 3.0, ("D", q1): 4.0}


def test_statement_yields_keep_income_periods(spark):
    """The newest periods are those of the income statement; cells of other periods or names do not fill in."""
    ends = [date(2000 + i // 4, (3, 6, 9, 12)[i % 4], 28) for i in range(30)]
    income = [("A", "EBIT", d, None if i == 29 else float(i + 1)) for i, d in enumerate(ends)]
    balance = [("A", "Share Issued", d, 10.0) for i, d in enumerate(ends) if i != 28] + [("A", "Total Debt", ends[27], 50.0)]
    balance += [("A", "Long Term Debt", d, 1e9) for d in ends] + [("A", "Share Issued", date(2010, 1, 1), 1.0)]
    schema = "ticker string, metric string, period date, value double"
    px = spark.createDataFrame([("A", date(1999, 1, 1), 2.0)], "ticker string, trade_date date, close double")
    got = {r.period: r.earnings_yield for r in prices.statement_yields(spark.createDataFrame(income, schema), spark.createDataFrame(balance, schema), px, 2).collect()}
    assert got == {d: (i + 1) / (70.0 if i == 27 else 20.0) for i, d in enumerate(ends) if 22 <= i <= 27}
