"""Exact order statistics and ranks for groups of any size.

``percentile`` holds every distinct value of a group in one buffer and a ranking window sorts a
whole group in one task. A quarter (or sector) may hold a third of all rows, so both are avoided: a
mergeable quantile sketch, formed on the map side, chooses values that cut a group into parts, whatever
its distribution; one exact count per part follows, and only inside a part are values ordered.

NaN counts as NULL. Infinities are ordinary ends.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscore.functions.columns import has_number, ratio
from pitscore.session import materialize

#: Values of a group that are ordered without a sketch, and accuracy of the sketch (error of a rank: rows / accuracy).
PART_ROWS = 20_000
ACCURACY = 20_000
#: A wanted rank lies between the sketch's values at this distance on both sides: eight times the sketch's error,
#: which is at least eight ranks in a group that is large enough to be sketched.
_MARGIN = 8.0 / ACCURACY
#: Parts of a group that is ranked as a whole: a power of two.
PARTS = 256


def null_safe(left: str, right: str, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for name in names:
        cond = cond & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return cond


def _joined(rows: DataFrame, small: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """Inner join on keys that may be NULL; ``columns`` of the right side are added."""
    return rows.alias("r").join(small.alias("w"), null_safe("r", "w", keys)).select("r.*", *[f"w.{c}" for c in columns])


def _sizes(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, bool]:
    """Rows with a value per group (``keys, n``), written, and whether any group needs a sketch."""
    sizes = materialize(df.filter(has_number(value)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    return sizes, not sizes.filter(F.col("n") > PART_ROWS).isEmpty()


def _sketched(rows: DataFrame, sizes: DataFrame, keys: list[str], value: str, shares: Sequence[float]) -> DataFrame:
    """``sizes`` with ``_s``: approximate values at the shares, NULL for groups that need no sketch."""
    large = sizes.filter(F.col("n") > PART_ROWS).select(*keys, F.lit(1).alias("_large"))
    at = F.percentile_approx(value, F.array(*[F.lit(float(s)) for s in shares]), ACCURACY)
    found = _joined(rows, large, keys).groupBy(*keys).agg(at.alias("_s"))
    joined = sizes.alias("r").join(found.alias("w"), null_safe("r", "w", keys), "left")
    return materialize(joined.select("r.*", "w._s"))


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, tuple[float, Callable[[Column], Column]]],
) -> DataFrame:
    """Exact values at given ranks (0 = smallest) per group; a rank is a function of the count, near a share of it.

    A sketch brackets each rank. One count follows: rows between the brackets by stretch, rows inside a bracket by
    value, so only the latter are ordered. Groups up to ``PART_ROWS`` are all bracket. Returns ``keys``, ``n``
    and one column per rank. Rows with a NULL or NaN value are ignored.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(has_number("_v"))
    sizes, large = _sizes(rows, keys, "_v")
    shares = sorted({p for p, _ in ranks.values()})
    if large:
        bounds = [b for p in shares for b in (max(0.0, p - _MARGIN), min(1.0, p + _MARGIN))]
        cuts = _sketched(rows, sizes, keys, "_v", bounds)
        rows = _joined(rows, cuts, keys, "_s")
        # Ends of a group are open, so the least and the greatest value are inside a bracket.
        low = [F.when(F.lit(bounds[2 * i] > 0), F.get("_s", F.lit(2 * i))) for i in range(len(shares))]
        high = [F.when(F.lit(bounds[2 * i + 1] < 1), F.get("_s", F.lit(2 * i + 1))) for i in range(len(shares))]
        inside = F.lit(False)
        below = F.lit(0)
        for lo, hi in zip(low, high):
            inside = inside | ((lo.isNull() | (F.col("_v") >= lo)) & (hi.isNull() | (F.col("_v") <= hi)))
            below = below + F.when(hi < F.col("_v"), 1).otherwise(0)
        # Above the same number of brackets, values outside come before those of the next one.
        rows = rows.select(*keys, (2 * below + inside.cast("int")).alias("_b"), F.when(inside, F.col("_v")).alias("_v"))
    else:
        rows = rows.select(*keys, F.lit(1).alias("_b"), "_v")
    counts = rows.groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = W.partitionBy(*keys).orderBy("_b", "_v").rowsBetween(W.unboundedPreceding, 0)
    placed = _joined(counts.withColumn("_end", F.sum("_c").over(upto)), sizes, keys, "n")

    def at(rank: Column) -> Column:
        here = (rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end"))
        exact = F.when(F.col("_v").isNull(), F.raise_error(F.lit("a wanted rank lies outside of its bracket")).cast("double")).otherwise(F.col("_v"))
        return F.max(F.when(here, exact))

    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *[at(f(F.col("n")).cast("long")).alias(name) for name, (_, f) in ranks.items()])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per group: ``keys``, ``n``, one column per name."""
    ranks: dict[str, tuple[float, Callable[[Column], Column]]] = {}
    for name, p in probs.items():
        ranks[f"{name}_lo"] = (p, lambda n, p=p: F.floor((n - 1) * F.lit(float(p))))
        ranks[f"{name}_hi"] = (p, lambda n, p=p: F.least(F.floor((n - 1) * F.lit(float(p))) + 1, n - 1))
    stats = order_statistics(df, keys, value, ranks)

    def interpolated(name: str, p: float) -> Column:
        at = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        share = at - F.floor(at)
        return F.when((share == 0) | (lo == hi), lo).otherwise(lo + (hi - lo) * share).alias(name)

    return stats.select(*keys, "n", *[interpolated(name, p) for name, p in probs.items()])


def _in_parts(rows: DataFrame, sketch: DataFrame | None, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``_p``: how many of the group's splitters (``_s`` of ``sketch``) are smaller than the value."""
    if sketch is None:
        return rows.withColumn("_p", F.lit(0))
    rows = _joined(rows, sketch, keys, "_s").withColumn("_p", F.lit(0))
    step = PARTS // 2
    while step:
        rows = rows.withColumn("_p", F.col("_p") + F.when(F.get("_s", F.col("_p") + (step - 1)) < F.col(value), step).otherwise(0))
        step //= 2
    return rows.drop("_s")


def _splitters(rows: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame | None]:
    """Group sizes, and the splitters of groups above ``PART_ROWS`` where there are any."""
    sizes, large = _sizes(rows, keys, value)
    return sizes, _sketched(rows, sizes, keys, value, [i / PARTS for i in range(1, PARTS)]) if large else None


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys``, distinct value, ``n`` (group size) and its average rank (1-based, ties share the mean rank)."""
    keys = list(keys)
    rows = df.select(*keys, value).filter(has_number(value))
    sizes, sketch = _splitters(rows, keys, value)
    counts = _in_parts(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")), sketch, keys, value)
    inside = W.partitionBy(*keys, "_p").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("_r", F.sum("_c").over(inside) - (F.col("_c") - 1) / 2.0)
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.groupBy(*keys, "_p").agg(F.sum("_c").alias("_c")).withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    placed = ranked if sketch is None else _joined(ranked, offsets, [*keys, "_p"], "_o")
    offset = F.lit(0) if sketch is None else F.col("_o")
    return _joined(placed, sizes, keys, "n").select(*keys, value, "n", (offset + F.col("_r")).alias("avg_rank"))


def rank_correlation(
    df: DataFrame, keys: Sequence[str], a: str | Column | Callable[[DataFrame], DataFrame], b: str, min_rows: int = 10,
    valid: Column | None = None,
) -> DataFrame:
    """Spearman correlation of columns with ``b`` per group: ``keys``, ``n``, ``ic``; NULL below ``min_rows`` pairs
    or when one side is constant.

    ``a`` is a column, or an expression for an array of columns that are all numbers where ``valid`` holds, or a function
    that expands rows by such values (``pos``, ``_a``); then each place has its own result, with ``pos``. ``b`` is ranked once for all of them. The values of all
    places are ordered in the same parts of their group, each by one window; what a part adds to the covariance
    depends on the rows before it only through their number, so parts are summed without another look at rows.
    """
    keys = list(keys)
    pairs = df.filter(has_number(b) & (has_number(a) if isinstance(a, str) else F.lit(True) if valid is None else valid))
    ranks = materialize(average_ranks(pairs, keys, b))
    # The mean rank is (n + 1) / 2 by construction.
    centred = pairs.alias("r").join(ranks.alias("w"), null_safe("r", "w", [*keys, b])).select("r.*", "w.n", (F.col("w.avg_rank") - (F.col("w.n") + 1) / 2.0).alias("_d"))
    if callable(a):
        expanded = a(centred)
    else:
        expanded = centred.withColumns({"_all": F.array(F.col(a)) if isinstance(a, str) else a}).select("*", F.posexplode("_all").alias("pos", "_a"))
    rows = expanded.select(*keys, "n", "_d", "pos", "_a")
    sketch = None
    if not ranks.filter(F.col("n") > PART_ROWS).isEmpty():
        at = F.percentile_approx("_a", F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), ACCURACY)
        sketch = materialize(rows.groupBy(*keys).agg(at.alias("_s")))
    rows = _in_parts(rows, sketch, keys, "_a")
    part = W.partitionBy(*keys, "pos", "_p")
    rank = F.rank().over(part.orderBy("_a")) + (F.count(F.lit(1)).over(W.partitionBy(*keys, "pos", "_p", "_a")) - 1) / 2.0
    sums = rows.withColumn("_r", rank).groupBy(*keys, "pos", "_p").agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("_c"), F.sum("_r").alias("_r1"), F.sum(F.col("_r") * F.col("_r")).alias("_r2"),
        F.sum("_d").alias("_d1"), F.sum(F.col("_d") * F.col("_d")).alias("_d2"), F.sum(F.col("_r") * F.col("_d")).alias("_rd"),
    )
    before = W.partitionBy(*keys, "pos").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_c").over(before), F.lit(0)) - (F.col("n") + 1) / 2.0
    total = sums.withColumn("_o", shift).groupBy(*keys, "pos").agg(
        F.max("n").alias("n"), F.sum(F.col("_o") * F.col("_d1") + F.col("_rd")).alias("_ab"),
        F.sum(F.col("_c") * F.col("_o") * F.col("_o") + 2 * F.col("_o") * F.col("_r1") + F.col("_r2")).alias("_aa"), F.sum("_d2").alias("_bb"),
    )
    ic = F.when((F.col("_aa") > 0) & (F.col("_bb") > 0), ratio(F.col("_ab"), F.sqrt(F.col("_aa")) * F.sqrt(F.col("_bb"))))
    out = total.select(*keys, "pos", "n", F.when(F.col("n") >= min_rows, ic).alias("ic"))
    return out.drop("pos") if isinstance(a, str) else out


def first_by(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, fraction: float, count: Callable[[Column], Column]
) -> DataFrame:
    """The ``count(n)`` rows of each group with the largest value, ties by ascending ``tie`` (text).

    For counts that grow with the group, about ``fraction`` of it. The first look finds the cut-off: of small groups
    the last row itself, by one window over key, value and tie alone; of larger ones the exact value, and of the rows equal to it
    the cut-off of a number that sorts like the first six bytes of ``tie``, so that a value shared by a large part of a
    group does not end in one task; only rows that agree on both are ordered. The second look keeps what lies above the cut-off.
    """
    keys = list(keys)
    narrow = df.select(*keys, F.col(value).alias("_v"), F.col(tie).alias("_t")).filter(has_number("_v"))
    sizes, large = _sizes(narrow, keys, "_v")
    take = count(F.col("n")).cast("long")
    if large:
        cut = materialize(order_statistics(narrow, keys, "_v", {"_cut": (1.0 - fraction, lambda n: n - count(n))}).select(*keys, "_cut", take.alias("_take")))
        marked = _joined(narrow, cut, keys, "_cut", "_take").filter(F.col("_v") >= F.col("_cut"))
        above = marked.groupBy(*keys, "_cut").agg((F.max("_take") - F.count_if(F.col("_v") > F.col("_cut"))).alias("_room"), F.count_if(F.col("_v") == F.col("_cut")).alias("_equal"))
        room = materialize(above)
        equal = _joined(narrow, room, keys, "_cut", "_room").filter(F.col("_v") == F.col("_cut")).withColumn("_code", _text_code(F.col("_t")))
        codes = equal.groupBy(*keys, "_code").agg(F.count(F.lit(1)).alias("_c"), F.max("_room").alias("_room"))
        upto = W.partitionBy(*keys).orderBy("_code").rowsBetween(W.unboundedPreceding, 0)
        last_code = codes.withColumn("_end", F.sum("_c").over(upto)).filter((F.col("_end") >= F.col("_room")) & (F.col("_end") - F.col("_c") < F.col("_room")))
        last_code = last_code.select(*keys, "_code", (F.col("_room") - F.col("_end") + F.col("_c")).alias("_left"))
        near = equal.alias("r").join(last_code.alias("w"), null_safe("r", "w", [*keys, "_code"])).select(*[f"r.{k}" for k in keys], "r._cut", "r._t", "w._left")
        place = F.row_number().over(W.partitionBy(*keys).orderBy("_t"))
        last = near.withColumn("_i", place).filter(F.col("_i") == F.col("_left")).select(*keys, "_cut", F.col("_t").alias("_last"))
    else:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_v"), "_t"))
        ordered = _joined(narrow, sizes.select(*keys, take.alias("_take")), keys, "_take").withColumn("_i", place)
        last = ordered.filter(F.col("_i") == F.col("_take")).select(*keys, F.col("_v").alias("_cut"), F.col("_t").alias("_last"))
    found = _joined(df.filter(has_number(value)), materialize(last), keys, "_cut", "_last")
    return found.filter((F.col(value) > F.col("_cut")) | ((F.col(value) == F.col("_cut")) & (F.col(tie) <= F.col("_last")))).drop("_cut", "_last")


def positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """``df`` with the place of each row (from 1) in a total order.

    Rows are sorted by ranges and written; what a range adds to the places is the number of rows before it, so
    no task sees all rows. One row per range is numbered in one place.
    """
    placed = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftrightunsigned("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("_range", F.shiftrightunsigned("_at", 33)).join(offsets, "_range")
    return joined.withColumn(name, F.col("_before") + inside + 1).drop("_range", "_before", "_at")


def _text_code(text: Column) -> Column:
    """A double that does not decrease with the text: its first six bytes as one number, exact below 2**53."""
    head = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")
