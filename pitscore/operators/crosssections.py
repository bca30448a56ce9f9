"""Cross-sections under many weight sets: a task takes one whole with a block of the weight sets.

Rows are sent once per block of weight sets, not once per weight set, and scores, cut-offs and ranks are formed in
numpy over columns of the cross-section. One above ``GROUP_ROWS`` rows goes the way of groups of any size
(``functions.distributed``), so a task's memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore.functions.distributed import null_safe
from pitscore.session import materialize

#: Rows of a cross-section that one task takes whole, and weight sets that it evaluates.
GROUP_ROWS = 1_000_000
BLOCK = 128


def by_size(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups that a task takes whole, and those of larger groups if there are any."""
    large = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > GROUP_ROWS).select(*keys))
    if large.isEmpty():
        return rows, None
    semi, anti = (rows.alias("r").join(large.alias("w"), null_safe("r", "w", keys), how) for how in ("left_semi", "left_anti"))
    return anti, semi


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Doubles with NULL as NaN."""
    return pc.fill_null(column.cast(pa.float64()), float("nan")).to_numpy()


class Scores:
    """Scores of a cross-section, by the arithmetic of ``candidates.with_candidate_scores`` in its order."""

    def __init__(self, columns: Sequence[np.ndarray]):
        there = [~np.isnan(x) for x in columns]
        code = np.zeros(len(columns[0]), np.int64)
        for i, x in enumerate(there):
            code |= x.astype(np.int64) << i
        self.values = [np.where(x, v, 0.0) for x, v in zip(there, columns)]
        # The mass of the weights depends on the names that a row has only.
        patterns, self.pattern = np.unique(code, return_inverse=True)
        self.has = [(patterns >> i & 1).astype(bool) for i in range(len(columns))]
        self.finite = all(bool(np.isfinite(v).all()) for v in self.values)

    def under(self, weights: Sequence[float]) -> tuple[np.ndarray, np.ndarray | None]:
        """The scores under one weight set, and where they are numbers (``None``: everywhere)."""
        mass = np.zeros(len(self.has[0]))
        total = np.zeros(len(self.pattern))
        with np.errstate(all="ignore"):
            for value, has, weight in zip(self.values, self.has, weights):
                total += value * weight
                mass += np.where(has, weight, 0.0)
            score = total
            score /= mass[self.pattern]
            score *= 1e9
            score += 0.5
            np.floor(score, out=score)
            if not (self.finite and np.isfinite(score).all()):
                score = np.nan_to_num(score, copy=False, nan=0.0, posinf=np.inf, neginf=-np.inf)
            # ``floor`` gives a long.
            np.clip(score, -(2.0**63), 2.0**63, out=score)
            score /= 1e9
        return score, None if (mass != 0).all() else (mass != 0)[self.pattern]


def _in_blocks(
    rows: DataFrame, keys: Sequence[str], candidates: Mapping[str, Mapping[str, float]], names: Sequence[str], prefix: str,
    evaluate: Callable[[pa.Table, Iterator[tuple[str, np.ndarray, np.ndarray | None]]], list[dict]], columns_out: dict[str, tuple[str, pa.DataType]],
) -> DataFrame:
    """``keys`` and ``columns_out``: what ``evaluate`` makes of each cross-section and its scores."""
    listed = [(c, [float(w.get(n, 0.0)) for n in names]) for c, w in candidates.items()]
    blocks = [listed[i : i + BLOCK] for i in range(0, len(listed), BLOCK)]
    columns, keys = [f"{prefix}{n}" for n in names], list(keys)
    kinds = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), *(f"{k} {t}" for k, (t, _) in columns_out.items())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        scores = Scores([_numbers(table.column(c)) for c in columns])
        found = evaluate(table, ((c, *scores.under(w)) for c, w in blocks[key[-1].as_py()]))
        out = {k: pa.array([x[k] for x in found], t) for k, (_, t) in columns_out.items()}
        return pa.table({k: pa.array([v.as_py()] * len(found), table.schema.field(k).type) for k, v in zip(keys, key)} | out)

    dealt = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1))))
    return dealt.groupBy(*keys, "_block").applyInArrow(run, kinds)


_SUMS = {
    "candidate": ("string", pa.string()), "k": ("int", pa.int32()), "total": ("double", pa.float64()),
    "names": ("bigint", pa.int64()), "seen": ("bigint", pa.int64()),
}
_ICS = {"candidate": ("string", pa.string()), "ic": ("double", pa.float64())}


def _places(tickers: pa.ChunkedArray) -> np.ndarray:
    """The place of each text among the distinct ones, -1 for NULL."""
    coded = pa.concat_arrays(tickers.chunks).dictionary_encode()
    place = np.empty(len(coded.dictionary) + 1, np.int64)
    place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
    place[-1] = -1
    return place[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)]


def top_sums(
    held: DataFrame, candidates: Mapping[str, Mapping[str, float]], names: Sequence[str], prefix: str, months: int, fraction: float
) -> DataFrame:
    """Of each quarter's best ``fraction`` under each weight set, ties by ticker: ``quarter_end, candidate, k`` (month after
    the quarter) and the sum of returns, the names that have one, and those whose return was seen."""
    flat = held.select(
        "quarter_end", "ticker", *[f"{prefix}{n}" for n in names],
        *[F.get("held", F.lit(k))["value"].alias(f"_v{k}") for k in range(months)], *[F.get("held", F.lit(k))["seen"].alias(f"_s{k}") for k in range(months)],
    )

    def evaluate(table: pa.Table, scored: Iterator[tuple[str, np.ndarray, np.ndarray | None]]) -> list[dict]:
        tickers, place, out = table.column("ticker"), None, []
        value = [pc.fill_null(table.column(f"_v{k}"), 0.0).to_numpy() for k in range(months)]
        known = [pc.is_valid(table.column(f"_v{k}")).to_numpy() for k in range(months)]
        seen = [pc.fill_null(table.column(f"_s{k}"), False).to_numpy() for k in range(months)]
        for candidate, score, valid in scored:
            at = np.arange(len(score)) if valid is None else np.flatnonzero(valid)
            n = len(at)
            if not n:
                continue
            score = score if valid is None else score[at]
            take = max(1, int(np.ceil(n * fraction)))
            cut = np.partition(score, n - take)[n - take]
            above, equal = np.flatnonzero(score > cut), np.flatnonzero(score == cut)
            room = take - len(above)
            if room < len(equal) or tickers.null_count:
                place = _places(tickers) if place is None else place
                own = place[at[equal]]
                last = np.partition(own, room - 1)[room - 1]
                equal = equal[(own >= 0) & (own <= last)]
            picks = at[np.concatenate((above, equal))]
            if not len(picks):  # all rows at the cut-off lack a ticker
                continue
            for k in range(months):
                count = int(known[k][picks].sum())
                out.append({"candidate": candidate, "k": k + 1, "total": float(value[k][picks].sum()) if count else None, "names": count, "seen": int(seen[k][picks].sum())})
        return out

    return _in_blocks(flat, ["quarter_end"], candidates, names, prefix, evaluate, _SUMS)


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))


def rank_correlations(
    rows: DataFrame, keys: Sequence[str], candidates: Mapping[str, Mapping[str, float]], names: Sequence[str], prefix: str, b: str, min_rows: int = 10
) -> DataFrame:
    """Spearman correlation of each weight set's score with ``b`` per group: ``keys, candidate, ic``; NULL below ``min_rows``
    rows or when one side is constant. All rows count: ``b`` is a number in each, and a score that is none is the least."""

    def evaluate(table: pa.Table, scored: Iterator[tuple[str, np.ndarray, np.ndarray | None]]) -> list[dict]:
        other, n = table.column(b).to_numpy(), table.num_rows
        order = np.argsort(other)
        first = _runs(other[order])
        size = np.diff(np.append(first, n))
        d = np.empty(n)
        d[order] = np.repeat(first + (size - 1) / 2.0, size) - (n - 1) / 2.0
        bb = float(np.dot(d, d))
        out = []
        for candidate, score, valid in scored:
            if valid is not None:
                score = np.where(valid, score, -np.inf)
            order = np.argsort(score)
            first = _runs(score[order])
            size = np.diff(np.append(first, n))
            rank = first + (size - 1) / 2.0 - (n - 1) / 2.0
            aa = float(np.dot(rank * rank, size))
            ab = float(np.dot(rank, np.add.reduceat(d[order], first)))
            out.append({"candidate": candidate, "ic": ab / (aa**0.5 * bb**0.5) if n >= min_rows and aa > 0 and bb > 0 else None})
        return out

    return _in_blocks(rows.select(*keys, b, *[f"{prefix}{n}" for n in names]), keys, candidates, names, prefix, evaluate, _ICS)
