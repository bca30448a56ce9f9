"""Analyst recommendations: consensus, sentiment shift, revisions, implied upside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscore.functions.columns import nonzero, ratio

# Rating label -> score. The order decides between several partial matches.
RATING_SCORES = {
    "strong_buy": 5,
    "buy": 4,
    "outperform": 4,
    "overweight": 4,
    "hold": 3,
    "neutral": 3,
    "market perform": 3,
    "equal-weight": 3,
    "underperform": 2,
    "sell": 1,
    "strong_sell": 1,
}

_BUCKETS = ("strong_buy", "buy", "hold", "sell", "strong_sell")


def rating_score(label: Column) -> Column:
    """Score of a rating label: exact after normalising, else the first key that contains the
    label or is contained in it; NULL for an empty label or no match."""
    key = F.replace(F.trim(F.lower(label)), F.lit(" "), F.lit("_"))
    exact = F.create_map(*[x for k, v in RATING_SCORES.items() for x in (F.lit(k), F.lit(float(v)))])[key]
    partial = F.lit(None).cast("double")
    for k, v in reversed(RATING_SCORES.items()):
        partial = F.when(F.contains(key, F.lit(k)) | F.contains(F.lit(k), key), float(v)).otherwise(partial)
    return F.when(label.isNotNull() & (label != ""), F.coalesce(exact, partial))


def score_label(score: Column) -> Column:
    return (
        F.when(score.isNull() | (score == 0), "Unknown")
        .when(score >= 4.5, "Strong Buy").when(score >= 3.5, "Buy")
        .when(score >= 2.5, "Hold").when(score >= 1.5, "Underperform").otherwise("Sell")
    )


def _mean(b: Column) -> Column:
    n = sum((b[k] for k in _BUCKETS), F.lit(0))
    points = sum((b[k] * w for k, w in zip(_BUCKETS, (5, 4, 3, 2, 1))), F.lit(0))
    return ratio(points.cast("double"), n.cast("double"))


def period_summary(recs: DataFrame) -> DataFrame:
    """Period-aggregate layout: consensus from period ``0m`` (else the ticker's first row by
    ``period``) and the shift against ``-1m``. A ticker has one row per period."""
    bucket = F.struct(*[F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k) for k in _BUCKETS])
    per = recs.groupBy("ticker").agg(
        F.max(F.when(F.col("period") == "0m", bucket)).alias("_0m"),
        F.max(F.when(F.col("period") == "-1m", bucket)).alias("_before"),
        F.min_by(bucket, "period").alias("_first"),
    ).withColumn("_now", F.coalesce("_0m", "_first"))
    now, before = F.col("_now"), F.col("_before")

    def bulls(b: Column) -> Column:
        return b["strong_buy"] + b["buy"] - b["sell"] - b["strong_sell"]

    change = F.coalesce(bulls(now) - bulls(before), F.lit(0))
    return per.select(
        "ticker",
        _mean(now).alias("mean_rating_score"),
        (now["strong_buy"] + now["buy"]).alias("buy_count"),
        now["hold"].alias("hold_count"),
        (now["sell"] + now["strong_sell"]).alias("sell_count"),
        (_mean(now) - _mean(before)).alias("revision_score"),
        F.greatest(F.lit(0), change).alias("recent_upgrades"),
        F.greatest(F.lit(0), -change).alias("recent_downgrades"),
    )


def _recent(actions: DataFrame, n: int) -> DataFrame:
    """Last ``n`` log entries per ticker; the rank filter is pushed below the shuffle."""
    latest = W.partitionBy("ticker").orderBy(F.desc("seq"))
    return actions.withColumn("_i", F.row_number().over(latest)).filter(F.col("_i") <= n)


def action_summary(actions: DataFrame) -> DataFrame:
    """Action-log layout (``seq, ticker, date, firm?, to_grade, action``): last 50 entries per ticker."""
    score, act = rating_score(F.col("to_grade")), F.lower("action")
    firm = F.col("firm") if "firm" in actions.columns else F.lit("")
    entry = F.struct("seq", F.col("date").cast("string").alias("date"), firm.alias("firm"), F.col("to_grade").alias("rating"), "action")
    out = _recent(actions, 50).groupBy("ticker").agg(
        F.count_if(score >= 4).alias("buy_count"),
        F.count_if((score >= 3) & (score < 4)).alias("hold_count"),
        F.count_if(score < 3).alias("sell_count"),
        F.count_if(act.contains("up") | act.contains("raise")).alias("recent_upgrades"),
        F.count_if(act.contains("down") | act.contains("lower")).alias("recent_downgrades"),
        F.slice(F.sort_array(F.collect_list(F.when(F.col("_i") <= 10, entry))), 1, 10).alias("recent_actions"),
    )
    return out.withColumn("recent_actions", F.transform("recent_actions", lambda a: a.dropFields("seq")))


def with_consensus(df: DataFrame) -> DataFrame:
    """Consensus columns from counts, an optional mean rating, a recommendation key, target and price.

    Without counts the key's rating stands in for one vote; without a mean rating one is derived
    from the counts.
    """
    for name, kind in (("mean_rating_score", "double"), ("recommendation_key", "string"), ("target_mean", "double"), ("price", "double")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    counts = [F.coalesce(F.col(f"{k}_count"), F.lit(0)) for k in ("buy", "hold", "sell")]
    df = df.withColumns({"_votes": counts[0] + counts[1] + counts[2], "_key": rating_score(F.col("recommendation_key"))})
    alone = (F.col("_votes") == 0) & F.col("_key").isNotNull()
    side = [F.col("_key") >= 4, (F.col("_key") >= 3) & (F.col("_key") < 4), F.col("_key") < 3]
    df = df.withColumns(
        {f"{k}_count": F.when(alone, s.cast("long")).otherwise(n) for k, s, n in zip(("buy", "hold", "sell"), side, counts)}
    )
    total = F.col("buy_count") + F.col("hold_count") + F.col("sell_count")
    derived = ratio(F.col("buy_count") * 4.5 + F.col("hold_count") * 3.0 + F.col("sell_count") * 1.5, total)
    upside = F.when(F.col("price") > 0, (ratio(nonzero("target_mean"), "price") - 1.0) * 100.0)
    df = df.withColumns({"mean_rating_score": F.coalesce("mean_rating_score", derived, "_key"), "implied_upside_pct": upside})
    return df.withColumn("consensus_label", score_label(F.col("mean_rating_score"))).drop("_votes", "_key")


def revisions_from_periods(recs: DataFrame) -> DataFrame:
    """Earnings-revision signal of the period layout: ten times the shift of the mean rating."""
    return period_summary(recs).select("ticker", (F.col("revision_score") * 10.0).alias("earnings_revisions"))


def revisions_from_actions(actions: DataFrame) -> DataFrame:
    """Earnings-revision signal of the action log: upgrades minus downgrades in the last 20 entries."""
    act = F.lower("action")
    return _recent(actions, 20).groupBy("ticker").agg(
        (F.count_if(act.rlike("up|raise|buy")) - F.count_if(act.rlike("down|lower|sell"))).cast("double").alias("earnings_revisions")
    )
