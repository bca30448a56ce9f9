"""Cleaning and reshaping of raw inputs into point-in-time tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscore.functions.columns import clean_ticker, listing_ticker, quarter_end
from pitscore.operators.asof import spine_literal
from pitscore.params import BENCHMARK
from pitscore.sources.schemas import PERIODIC_FORMS, TAG_FIELDS


def daily_closes(prices: DataFrame) -> DataFrame:
    """One row per (ticker, date), ticker upper-cased, NULL and NaN closes dropped.

    After this a ticker has at most one row per calendar day, whatever the input holds, which is
    the bound that the per-ticker operators rely on.
    """
    ok = F.col("close").isNotNull() & ~F.isnan("close")
    return prices.filter(ok).groupBy(clean_ticker("ticker").alias("ticker"), "trade_date").agg(F.max("close").alias("close"))


def membership_panel(history: DataFrame, quarters: Sequence[date]) -> DataFrame:
    """Members at each quarter-end from dated comma lists: ``quarter_end, ticker, snapshot_date``.

    The last list on or before the quarter-end counts. A list may be split over several rows of
    one date. The as-of step runs on the distinct dates only; the lists are joined afterwards.
    """
    spine = spine_literal(quarters)
    listed = history.filter(F.col("date").isNotNull())
    slot = F.size(F.filter(spine, lambda q: q < F.col("date")))
    snapshots = (
        listed.select("date").distinct()
        .withColumn("_slot", slot)
        .groupBy("_slot").agg(F.max("date").alias("date"))
        .withColumn("_until", F.coalesce(F.lead("_slot").over(W.orderBy("_slot")) - 1, F.lit(len(quarters) - 1)))
        .filter(F.col("_slot") <= F.col("_until"))
        .select("date", F.explode(F.transform(F.sequence("_slot", "_until"), lambda i: F.get(spine, i))).alias("quarter_end"))
    )
    return (
        listed.join(snapshots, "date")
        .select("quarter_end", F.explode(F.split("tickers", ",")).alias("_t"), F.col("date").alias("snapshot_date"))
        .filter(F.trim("_t") != "")
        .select("quarter_end", listing_ticker("_t").alias("ticker"), "snapshot_date")
        .distinct()
    )


def members_as_of(membership: DataFrame, as_of: date) -> DataFrame:
    return membership.filter(F.col("quarter_end") == F.lit(as_of)).select("ticker").distinct()


def delisted_catalog(membership: DataFrame, prices: DataFrame, benchmark: str = BENCHMARK) -> DataFrame:
    """Requested tickers (members and benchmark) that have no price row."""
    asked = membership.select(clean_ticker("ticker").alias("ticker")).distinct()
    asked = asked.union(asked.sparkSession.range(1).select(F.lit(benchmark).alias("ticker"))).distinct()
    return asked.join(prices.select("ticker").distinct(), "ticker", "left_anti")


def ended_catalog(prices: DataFrame, as_of: date, days: int) -> DataFrame:
    """Tickers whose last close is more than ``days`` before a date."""
    last = prices.groupBy("ticker").agg(F.max("trade_date").alias("_last"))
    return last.filter(F.datediff(F.lit(as_of), "_last") > days).select("ticker")


def with_benchmark(prices: DataFrame, other: DataFrame, benchmark: str = BENCHMARK) -> DataFrame:
    """Append the benchmark's rows from a second source when ``prices`` has none of them."""
    present = prices.filter(F.col("ticker") == benchmark).select("ticker").limit(1)
    extra = other.filter(F.col("ticker") == benchmark).join(present, "ticker", "left_anti")
    return prices.unionByName(extra.select(*prices.columns))


def _best_values(sub: DataFrame, num: DataFrame, cik_map: DataFrame, prefer_quarterly: bool, sets: list[str]) -> DataFrame:
    """The winning value per data set, cik, field and period, as struct ``r``, with the ticker."""
    field = F.create_map(*[F.lit(x) for pair in TAG_FIELDS.items() for x in pair])[F.col("tag")]
    headers = sub.filter(F.col("form").isin(*PERIODIC_FORMS)).select(*sets, "adsh", "cik", "period", "filed", "form")
    values = num.filter(F.col("tag").isin(*TAG_FIELDS)).withColumn("field", field)
    instant = ~F.coalesce(F.col("qtrs").isin(1, 4), F.lit(False))
    first = (~instant if prefer_quarterly else instant).alias("first")
    best = F.max(F.struct(first, "filed", "ddate", "tag", "adsh", "amount", "form", "qtrs")).alias("r")
    return (
        values.join(headers, [*sets, "adsh"])
        .dropna(subset=["field", "amount", "filed", "period"])
        .groupBy(*sets, "cik", "field", "period").agg(best)
        .join(cik_map.select("cik", clean_ticker("ticker").alias("ticker")).dropna(), "cik")
    )


def normalize_filings(
    sub: DataFrame, num: DataFrame, cik_map: DataFrame, prefer_quarterly: bool = False
) -> DataFrame:
    """Filed values as long fundamentals, one row per (cik, field, period).

    Among competing values a row that is not quarterly or annual (a balance-sheet instant) wins,
    then the latest filing; ``prefer_quarterly`` turns the first rule around. Remaining ties go to
    the latest ``ddate``, then tag, filing and amount, so the outcome does not depend on file
    order. One mergeable maximum per key does this: no key is ever sorted in one task.
    """
    return _best_values(sub, num, cik_map, prefer_quarterly, []).select(
        "ticker", "cik", "field", "r.amount", "period", "r.filed", "r.form", "r.tag", "r.qtrs"
    )


def normalize_filing_sets(
    sub: DataFrame, num: DataFrame, cik_map: DataFrame, prefer_quarterly: bool = False
) -> DataFrame:
    """Many quarterly data sets at once (``dataset_quarter`` column on ``sub`` and ``num``).

    Each set is normalised by itself, then one row per (ticker, field, period, filed) is kept:
    that of the latest data set.
    """
    return latest_of_sets(filings_by_set(sub, num, cik_map, prefer_quarterly))


def filings_by_set(sub: DataFrame, num: DataFrame, cik_map: DataFrame, prefer_quarterly: bool = False) -> DataFrame:
    """Every data set normalised by itself; rows without a ``dataset_quarter`` are left out."""
    return _best_values(sub, num, cik_map, prefer_quarterly, ["dataset_quarter"]).select(
        "ticker", "cik", "field", "r.amount", "period", "r.filed", "r.form", "r.tag", "r.qtrs", "dataset_quarter"
    )


def latest_of_sets(filings: DataFrame) -> DataFrame:
    """One row per (ticker, field, period, filed) of normalised data sets: that of the latest set."""
    label = "dataset_quarter"
    return (
        filings.groupBy("ticker", "field", "period", "filed")
        .agg(F.max(F.struct(label, "cik", "amount", "form", "tag", "qtrs")).alias("r"))
        .select("ticker", "r.cik", "field", "r.amount", "period", "filed", "r.form", "r.tag", "r.qtrs", f"r.{label}")
    )


def first_sector(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Attach the sector of the universe to a panel that has none (one sector per ticker)."""
    sectors = universe.groupBy(clean_ticker("ticker").alias("ticker")).agg(F.min("sector").alias("_sector"))
    if "sector" not in panel.columns:
        return panel.join(sectors, "ticker", "left").withColumnRenamed("_sector", "sector")
    known = F.coalesce(panel.agg(F.max(F.col("sector").isNotNull())).scalar(), F.lit(False))
    return panel.join(sectors, "ticker", "left").withColumn("sector", F.when(known, F.col("sector")).otherwise(F.col("_sector"))).drop("_sector")


def usable_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes that carry a price and a display name; zero counts as no price, blank as no name."""
    price = F.coalesce(F.nullif("current_price", F.lit(0.0)), F.col("regular_market_price"))
    name = F.coalesce(F.nullif("long_name", F.lit("")), F.nullif("short_name", F.lit("")))
    return quotes.filter(price.isNotNull() & ~F.isnan(price) & name.isNotNull())


def without_funds(universe: DataFrame) -> DataFrame:
    """Rows that are scored: funds (quote type ETF) are not."""
    return universe.filter(F.coalesce(F.upper("quote_type"), F.lit("")) != "ETF")


def values_by_period(statements: DataFrame, names: Mapping[str, Sequence[str]], keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """``keys, period`` and one column per field from long statements ``keys, metric, period, value``.

    A field takes the first of its metric names that the key's statement has at all. The choice holds for
    all periods: an empty cell of that name stays empty, and no other name fills it. Rows exist for dated
    periods with a cell of a chosen name; NaN is empty, of repeated cells the largest counts.
    """
    keys = list(keys)
    listed = F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.lit(field).alias("field"), F.lit(rank).alias("rank"))
        for field, metrics in names.items() for rank, metric in enumerate(metrics)
    ])
    cells = statements.select(
        *keys, "period", F.nullif("value", F.lit(float("nan"))).alias("_value"),
        F.explode(F.filter(listed, lambda x: x["metric"] == F.col("metric"))).alias("_name"),
    ).select(*keys, "period", "_value", F.col("_name.field").alias("_field"), F.col("_name.rank").alias("_rank"))
    # One cell per name and period first, so that the choice of names reads reduced rows.
    cells = cells.groupBy(*keys, "_field", "_rank", "period").agg(F.max("_value").alias("_value"))
    chosen = cells.withColumn("_first", F.min("_rank").over(W.partitionBy(*keys, "_field"))).filter("_rank = _first")
    dated = chosen.filter(F.col("period").isNotNull())
    return dated.groupBy(*keys, "period").agg(*[F.max(F.when(F.col("_field") == f, F.col("_value"))).alias(f) for f in names])


def statement_values(
    statements: DataFrame, names: Mapping[str, Sequence[str]], keys: Sequence[str] = ("ticker",)
) -> DataFrame:
    """Latest and prior value per field from long statements ``keys, metric, period, value``.

    A field lists metric names by priority; the first name with any value supplies both. Values
    are the newest and second newest that are not NULL; ``stale`` tells that the newest period of
    the statement (per key) is empty for that metric. Undated columns (NULL period) count only if
    a key has no dated one.

    Two mergeable maxima per metric (newest, then newest before it) replace a ranking window.
    """
    keys = list(keys)
    by_name = F.create_map(
        *[
            x
            for field, metrics in names.items()
            for rank, metric in enumerate(metrics)
            for x in (F.lit(f"{rank}|{field}"), F.lit(metric))
        ]
    )
    wanted = F.map_filter(by_name, lambda k, v: v == F.col("metric"))
    cells = statements.select(
        *keys, "metric", "period", F.nullif("value", F.lit(float("nan"))).alias("value")
    ).withColumn("_t", F.coalesce("period", F.lit("0001-01-01").cast("date")))
    # Undated cells count only for a key without any dated one.
    dated = cells.filter(F.col("period").isNotNull()).select(*keys).distinct().withColumn("_dated", F.lit(True))
    cells = cells.join(dated, keys, "left").filter(F.col("period").isNotNull() | F.col("_dated").isNull()).drop("_dated")
    newest = cells.groupBy(*keys).agg(F.max("_t").alias("_newest"))
    # Per metric and period one value (a statement has one cell), then the top two periods.
    per_period = (
        cells.filter(F.col("value").isNotNull())
        .groupBy(*keys, "metric", "_t").agg(F.max("value").alias("value"))
    )
    top = per_period.groupBy(*keys, "metric").agg(F.max(F.struct("_t", "value")).alias("_l"))
    second = (
        per_period.join(top, [*keys, "metric"])
        .groupBy(*keys, "metric")
        .agg(
            F.first("_l").alias("_l"),
            F.max(F.when(F.col("_t") < F.col("_l._t"), F.struct("_t", "value"))).alias("_p"),
        )
    )
    fields = (
        second.withColumn("_f", F.explode(F.map_keys(wanted)))
        .withColumn("field", F.split_part("_f", F.lit("|"), F.lit(2)))
        .withColumn("_rank", F.split_part("_f", F.lit("|"), F.lit(1)).cast("int"))
        .groupBy(*keys, "field")
        .agg(F.min_by(F.struct("metric", "_l", "_p"), "_rank").alias("_r"))
    )
    return fields.join(newest, keys).select(
        *keys,
        "field",
        F.col("_r.metric").alias("metric"),
        F.col("_r._l.value").alias("latest"),
        F.col("_r._p.value").alias("prior"),
        (F.col("_r._l._t") < F.col("_newest")).alias("stale"),
    )


def data_warnings(values: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Names of the metrics whose newest period was empty, per key (a handful of fields)."""
    return values.filter("stale").groupBy(*keys).agg(F.sort_array(F.collect_set("metric")).alias("data_warnings"))


def field_history(fundamentals: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per ticker with a sorted array of ``(period, filed, amount)`` per field.

    The EAV pivot for the point-in-time lookups: one shuffle on ticker. An array is bounded by the
    filings of one company (periods x restatements), which the key (ticker, field, period, filed)
    of the fundamentals guarantees.
    """
    # Both groupings share the shuffle on ticker; each filing is put into one array only.
    wanted = fundamentals.filter(F.col("field").isin(*fields)).select("ticker", "field", "period", "filed", "amount").repartition("ticker")
    per_field = wanted.groupBy("ticker", "field").agg(F.sort_array(F.collect_list(F.struct("period", "filed", "amount"))).alias("_e"))
    nothing = F.array().cast(per_field.schema["_e"].dataType)
    return per_field.groupBy("ticker").agg(
        *[F.coalesce(F.first(F.when(F.col("field") == f, F.col("_e")), ignorenulls=True), nothing).alias(f) for f in fields]
    )


def known_entries(entries: Column, as_of: Column) -> Column:
    """The entries filed by a date, of a sorted array of ``(period, filed, amount)``; the last one is the latest."""
    return F.filter(entries, lambda e: e["filed"] <= as_of)


def known_prior(known: Column, latest: Column) -> Column:
    """The last of the known entries among the periods before that of ``latest``."""
    return F.try_element_at(F.filter(known, lambda e: e["period"] < latest["period"]), F.lit(-1))


def with_derived_fundamentals(df: DataFrame) -> DataFrame:
    """Book value per share and total debt. Debt parts win; without them ``long_term_debt``
    replaces the debt tag; the debt tag alone remains where neither exists."""
    parts = F.when(
        F.col("total_debt_noncurrent").isNotNull() | F.col("total_debt_current").isNotNull(),
        F.coalesce("total_debt_noncurrent", F.lit(0.0)) + F.coalesce("total_debt_current", F.lit(0.0)),
    )
    return df.withColumns(
        {
            "book_value": F.try_divide("book_equity", "shares_outstanding"),
            "total_debt": F.coalesce(parts, F.col("long_term_debt"), F.col("total_debt")),
        }
    )


def with_known_fundamentals(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Replace the arrays of ``field_history`` by ``<field>`` and ``<field>_prior`` as known at
    ``quarter_end``, and add the derived fields."""
    others = [c for c in df.columns if c not in fields]
    as_of = F.col("quarter_end")
    looked = df.select(*others, *[known_entries(F.col(f), as_of).alias(f) for f in fields])
    looked = looked.withColumns({f"_{f}": F.try_element_at(f, F.lit(-1)) for f in fields})
    flat = looked.select(
        *others,
        *[F.col(f"_{f}.amount").alias(f) for f in fields],
        *[known_prior(F.col(f), F.col(f"_{f}"))["amount"].alias(f"{f}_prior") for f in fields],
    )
    missing = [f for f in ("total_debt", "total_debt_current", "total_debt_noncurrent") if f not in fields]
    flat = flat.withColumns({f: F.lit(None).cast("double") for f in missing}) if missing else flat
    return with_derived_fundamentals(flat)


def pit_fundamentals(keys: DataFrame, fundamentals: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fundamentals known at each (ticker, quarter_end) key, NULL before the first filing: ``<field>`` and
    ``<field>_prior``."""
    return with_known_fundamentals(keys.join(field_history(fundamentals, fields), "ticker", "left"), fields)
