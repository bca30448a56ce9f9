"""Repeated substrings by merging Burrows-Wheeler transforms of shards.

Texts are bytes. Content-defined anchors (least hash of a byte k-gram within ``SPAN`` starts) cut a text into
phrases, so equal strings of 400 bytes hold the same anchors inside, and a phrase's hash is the symbol of the
transforms. A shard of texts sorts the suffixes of its symbol strings once and keeps its Burrows-Wheeler
transform: before each sorted suffix the symbol in front of it, and the place of the suffix that starts there.

Shards are merged by refining their interleave: in each round every shard walks its transform and sends the
distinct pairs (symbol in front, interval of the suffix) with their counts; the pairs of all shards are put in
order, which numbers the intervals of the merged transform one symbol deeper. Nothing is sorted again, and a
shard sends each pair once, so a phrase in a third of all texts is one row for each shard. A suffix whose
interval has a single member has reached its longest common prefix and takes no further part, nor does one
whose common prefix is as long as any decision needs.

The common prefixes are whole phrases, so they are the repeated intervals up to their ragged ends. Anchors
next to such ends, and copies of them elsewhere (one for each class of equal surroundings), are settled by
comparing 128-bit hashes of all their 400-byte windows, among anchors that agree on the bytes which every
window of an anchor holds.

Defined results: null and empty texts have no bytes and nothing is removed; texts below 400 bytes have no
window; repeated rows are copies of each other and removed whole if long enough; rows without ``doc_id`` take
part like others; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitscore.llm import words as w
from pitscore.llm.common import delete, free_shuffles, slices, staged, written

LENGTH = 400
#: Bytes of an anchor's k-gram, starts among which it is least, longest period of a k-gram that is no anchor.
GRAM, SPAN, PERIOD = 40, 128, 30
SHARD_BYTES = 24 << 20
#: A common prefix of so many bytes covers every window that starts in its first phrase.
ENOUGH = LENGTH + SPAN + GRAM
#: Rounds of the merge after which shuffle files of the rounds before are freed.
FREE_ROUNDS = 4
#: Rows of keys that a range takes before there is one more, and most ranges.
RANGE_ROWS, RANGES = 50_000, 256
#: Window starts that are told apart by their common bytes before each is hashed alone.
BLOCK = 16
_OTHER = np.random.Generator(np.random.PCG64(9)).integers(1, 2**63, 256, dtype=np.uint64)


class Rolling:
    """Hashes of any byte run of a slice, 64 or 128 bits; the sums of a half are made when it is first asked for."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.sums = raw, [None, None]
        self.inv = w.powers(len(raw) + 1)[1]

    def _sums(self, which: int) -> np.ndarray:
        if self.sums[which] is None:
            self.sums[which] = np.zeros(len(self.raw) + 1, np.uint64)
            each = (w._TABLE, _OTHER)[which][self.raw]
            each *= w.powers(len(self.raw) + 1)[0][: len(self.raw)]
            np.cumsum(each, out=self.sums[which][1:])
        return self.sums[which]

    def run(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        s = self._sums(which)
        return w.mix((s[end] - s[start]) * self.inv[start] + (end - start).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        """Hashes of the runs of ``length`` bytes from each start."""
        s, n = self._sums(0), max(0, len(self.raw) - length + 1)
        found = s[length : length + n] - s[:n]
        found *= self.inv[:n]
        found += np.uint64(length)
        return w.mix(found)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum over each run of ``span`` values."""
    n = len(values) - span + 1
    if n <= 0:
        return values[:0]
    pad = -len(values) % span
    v = np.concatenate((values, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, span)
    ahead, back = np.minimum.accumulate(v, 1).ravel(), np.minimum.accumulate(v[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[span - 1 : span - 1 + n])


def _periodic(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the k-gram at each place has a period of at most ``PERIOD`` bytes."""
    gram = raw[at[:, None] + np.arange(GRAM)]
    found = np.zeros(len(at), bool)
    for q in range(1, PERIOD + 1):
        # The first bytes rule out most; what is left is compared whole.
        some = np.flatnonzero((gram[:, 0] == gram[:, q]) & (gram[:, 1] == gram[:, q + 1]))
        found[some] |= (gram[some, : GRAM - q] == gram[some, q:]).all(axis=1)
    return found


class Parse:
    """Anchors of the long texts of a slice.

    ``at`` has the anchors' places, ``text`` their texts, ``low`` and ``high`` the first and last start of a
    window of LENGTH bytes that each is the anchor of (``high < low`` if none is). ``symbol`` is the hash of the
    phrase up to the next anchor, 0 if there is none or the anchor's k-gram has a short period; ``key`` names the
    symbol, or the k-gram in its place, and the bytes behind the anchor that all its windows hold.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.raw, self.off, self.hash = raw, off, Rolling(raw)
        key = self.hash.every(GRAM)
        bits = np.uint64(max(24, len(key).bit_length()))
        key >>= bits
        key <<= bits
        key |= np.arange(len(key), dtype=np.uint64)
        pick = (_least(key, SPAN) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        size = np.diff(off)
        spans = np.where(size >= LENGTH, size - (SPAN + GRAM - 1) + 1, 0)
        text = np.repeat(np.arange(len(size)), spans)
        window = np.arange(len(text)) + np.repeat(off[:-1] - (np.cumsum(spans) - spans), spans)
        picked = pick[window]
        change = np.ones(len(window), bool)
        change[1:] = (picked[1:] != picked[:-1]) | (text[1:] != text[:-1])
        self.at, self.text, self.low = picked[change], text[change], window[change]
        last = np.flatnonzero(change)
        self.high = np.minimum(window[np.append(last[1:], len(window)) - 1], off[self.text + 1] - LENGTH) if len(window) else self.low
        gram = self.hash.run(self.at, self.at + GRAM)
        valid = ~_periodic(raw, self.at)
        same = np.zeros(len(self.at), bool)
        same[:-1] = self.text[1:] == self.text[:-1]
        end = np.where(same, np.append(self.at[1:], 0), self.at + GRAM)
        self.symbol = np.where(same & valid, self.hash.run(self.at, end) | np.uint64(1), np.uint64(0))
        named = np.where(valid, self.symbol, gram | np.uint64(1))
        core = self.hash.run(self.at, np.minimum(self.at + LENGTH - SPAN + 1, off[self.text + 1]))
        self.key = np.where(named > 0, w.mix(named ^ w.mix(core)) | np.uint64(1), np.uint64(0))
        # Equal surroundings: the anchor's windows have equal bytes, at equal places from it.
        stop = np.maximum(self.low, self.high + LENGTH)
        self.around = w.mix(self.hash.run(self.low, stop) ^ ((self.at - self.low).astype(np.uint64) << np.uint64(20)) ^ (stop - self.low).astype(np.uint64))
        self.bounds = self.text.searchsorted(np.arange(len(size) + 1))


    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """A byte for each anchor's step from the one before it, and one for its step back to ``low`` (top bit: no symbol)."""
        before = np.concatenate((np.zeros(1, np.int64), self.at[:-1]))[: len(self.at)]
        first = self.bounds[:-1][np.diff(self.bounds) > 0]
        before[first] = self.off[self.text[first]]
        return (self.at - before).astype(np.uint8), (self.at - self.low + 128 * (self.symbol == 0)).astype(np.uint8)


def _anchors(steps: pa.ChunkedArray, lows: pa.ChunkedArray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """``at, low, high``, whether there is no symbol, and the anchors of each text, from packed anchors."""
    step, count = _joined(steps, np.uint8)
    low, _ = _joined(lows, np.uint8)
    sums = np.concatenate(([0], np.cumsum(step, dtype=np.int64)))
    at = sums[1:] - np.repeat(sums[np.cumsum(count) - count], count)
    start = at - (low & 127)
    row = np.repeat(np.arange(len(count)), count)
    high = size[row] - LENGTH
    same = np.flatnonzero(row[1:] == row[:-1])
    high[same] = np.minimum(high[same], start[same + 1] - 1)
    return at, start, high, low >= 128, count


def _arrays(a: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.array([a[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary())


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By ``part``: a ``text`` row for each text, a ``phrase`` and an ``anchor`` row for each that has anchors, and a ``symbol`` row for each distinct symbol of a shard with its count."""
    shut = zstandard.ZstdCompressor(level=1).compress
    base, shard, row, size, seen = TaskContext.get().partitionId() << 32, 0, 0, 0, []
    names = None

    def out(part: str, **given) -> pa.RecordBatch:
        n = len(next(iter(given.values())))
        given["part"] = pa.repeat(pa.scalar(part), n)
        return pa.record_batch([given.get(f.name, pa.nulls(n, f.type)) for f in names], schema=names)

    def symbols() -> Iterator[pa.RecordBatch]:
        s, n = np.unique(np.concatenate([*seen, np.zeros(0, np.uint64)]), return_counts=True)
        for i in range(0, len(s), 1 << 16):
            part = s[i : i + (1 << 16)].view(np.int64)
            yield out("symbol", shard=pa.array(np.full(len(part), base + shard)), symbol=pa.array(part), n=pa.array(n[i : i + (1 << 16)]))

    for batch in slices(batches):
        names = pa.schema(
            [("part", pa.string()), ("shard", pa.int64()), ("uid", pa.int64()), ("doc_id", batch.schema.field("doc_id").type), ("n_bytes", pa.int64()), ("sha", pa.string()), ("z", pa.binary())]
            + [(c, pa.binary()) for c in ("steps", "lows", "symbols", "keys", "around")] + [("symbol", pa.int64()), ("n", pa.int64())]
        )
        raw, off = w.text_bytes(batch.column("text"))
        p = Parse(raw, off)
        data = raw.tobytes()
        texts = [data[a:b] for a, b in zip(off, off[1:])]
        uid, n_bytes = base + row + np.arange(batch.num_rows), np.diff(off)
        yield out(
            "text", uid=pa.array(uid), doc_id=batch.column("doc_id"), n_bytes=pa.array(n_bytes),
            sha=pa.array([hashlib.sha256(t).hexdigest() for t in texts]), z=pa.array([shut(t) for t in texts], pa.binary()),
        )
        some = np.flatnonzero(np.diff(p.bounds))
        if len(some):
            step, low = p.packed()
            bounds = np.append(p.bounds[some], p.bounds[-1])
            steps, uids = _arrays(step, bounds), pa.array(uid[some])
            yield out("phrase", shard=pa.array(np.full(len(some), base + shard)), uid=uids, steps=steps, symbols=_arrays(p.symbol, bounds))
            yield out("anchor", uid=uids, n_bytes=pa.array(n_bytes[some]), steps=steps, lows=_arrays(low, bounds), keys=_arrays(p.key, bounds), around=_arrays(p.around, bounds))
        seen = [np.concatenate([*seen, p.symbol[p.symbol > 0]])] if len(seen) > 64 else [*seen, p.symbol[p.symbol > 0]]
        row += batch.num_rows
        size += len(raw)
        if size >= SHARD_BYTES:
            yield from symbols()
            shard, size, seen = shard + 1, 0, []
    if names is not None:
        yield from symbols()


def _joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and how many each row has."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind), np.array([len(x) // np.dtype(kind).itemsize for x in parts], np.int64)


def _transform(_: tuple, texts: pa.Table, names: pa.Table) -> pa.Table:
    """A shard's transform over the symbols that occur twice or more in the corpus, and its first intervals."""
    symbol, count = _joined(texts.column("symbols"), np.uint64)
    step, _ = _joined(texts.column("steps"), np.uint8)
    row = np.repeat(np.arange(texts.num_rows), count)
    known = np.sort(names.column("symbol").to_numpy().view(np.uint64))
    order = np.argsort(names.column("symbol").to_numpy().view(np.uint64))
    number = names.column("id").to_numpy()[order]
    near = np.minimum(known.searchsorted(symbol), max(0, len(known) - 1))
    live = np.flatnonzero(known[near] == symbol) if len(known) else np.zeros(0, np.int64)
    after = np.zeros(len(symbol) + 1, np.int64) - 1
    after[live] = np.arange(len(live))
    follow = np.append(after[1:], -1)[live] if len(live) else live
    follow = np.where((follow >= 0) & (row[np.minimum(live + 1, len(row) - 1)] == row[live]), follow, -1) if len(live) else live
    # An anchor with a symbol has one behind it in its text.
    length = step[live + 1].astype(np.int64) if len(live) else live
    # Sort the shard's suffixes once: ranks of one, two, four and eight symbols, then by those behind them.
    rank = number[near[live]] if len(live) else live
    ahead = follow.copy()
    for _round in range(4):
        behind = np.where(ahead >= 0, rank[np.maximum(ahead, 0)], -1) if len(live) else live
        by = np.lexsort((behind, rank))
        new = np.ones(len(by), bool)
        new[1:] = (rank[by][1:] != rank[by][:-1]) | (behind[by][1:] != behind[by][:-1])
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(new)
        ahead = np.where(ahead >= 0, ahead[np.maximum(ahead, 0)], -1) if len(live) else live
    order = np.argsort(rank, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    front = np.full(len(order), -1)
    front[place[follow[follow >= 0]]] = place[np.flatnonzero(follow >= 0)]
    first = number[near[live]][order] if len(live) else live
    return _packed(
        texts.column("shard")[0].as_py(),
        {
            "uid": texts.column("uid").to_numpy()[row[live]][order], "j": (live - (np.cumsum(count) - count)[row[live]])[order], "length": length[order],
            "bwt": np.where(front >= 0, first[np.maximum(front, 0)], 0) if len(live) else front, "front": front, "interval": first,
            "reach": length[order], "best": length[order],
        },
    )


_STATE = {"uid": np.int64, "j": np.int32, "length": np.int32, "bwt": np.int64, "front": np.int32, "interval": np.int64, "reach": np.int32, "best": np.int32}
_DONE = {"done_uid": np.int64, "done_j": np.int32, "done_best": np.int32}
_STATE_SCHEMA = "part string, shard bigint, " + ", ".join(f"{k} binary" for k in (*_STATE, *_DONE)) + ", bwt_key bigint, interval_key bigint, n bigint"


def _packed(shard: int, s: dict[str, np.ndarray]) -> pa.Table:
    """The shard's state as one row, its finished suffixes as another, and its distinct open pairs.

    A suffix grows while its interval has copies, its common prefix is short and the suffix behind it has
    copies too. The state keeps growing suffixes and those behind them; all others are finished.
    """
    behind = np.full(len(s["front"]), -1)
    q = np.flatnonzero(s["front"] >= 0)
    behind[s["front"][q]] = q
    grows = (s["interval"] > 0) & (s["reach"] < ENOUGH) & (behind >= 0)
    grows[grows] = s["interval"][behind[grows]] > 0
    back = behind[grows]
    keep = grows.copy()
    keep[back] = True
    pairs, n = np.unique(np.stack([s["bwt"][back], s["interval"][back]], axis=1), axis=0, return_counts=True) if len(back) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    place = np.append(np.cumsum(keep) - 1, -1)
    front = np.where((s["front"] >= 0) & np.append(grows, False)[s["front"]], place[s["front"]], -1) if len(keep) else s["front"]
    done = {f"done_{k}": s[k][~keep] for k in ("uid", "j", "best")}
    state = {k: v[keep] for k, v in {**s, "front": front}.items()}
    here = {"open": int(keep.any()), "done": int((~keep).any()), "pair": len(n)}
    none = lambda part, kind: pa.nulls(here[part], kind)
    columns = [pa.array(np.repeat(list(here), list(here.values())).tolist(), pa.string()), pa.array([shard] * sum(here.values()), pa.int64())]
    for values, kinds, part in ((state, _STATE, "open"), (done, _DONE, "done")):
        for k, t in kinds.items():
            one = pa.array([values[k].astype(t).tobytes()] * here[part], pa.binary())
            columns.append(pa.concat_arrays([one if p == part else none(p, pa.binary()) for p in here]))
    columns += [pa.concat_arrays([none("open", pa.int64()), none("done", pa.int64()), pa.array(x, pa.int64())]) for x in (pairs[:, 0], pairs[:, 1], n)]
    return pa.table(columns, names=["part", "shard", *_STATE, *_DONE, "bwt_key", "interval_key", "n"])


def _refine(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """One round: every growing suffix moves to its interval of the merged transform, or has no copy any more."""
    row = left.slice(0, 1).to_pylist()[0]
    s = {k: np.frombuffer(row[k], t).astype(np.int64) for k, t in _STATE.items()}
    a, b, number = (right.column(c).to_numpy() for c in ("a", "b", "id"))
    back = np.flatnonzero(s["front"] >= 0)
    grown = s["front"][back]
    keys, at = np.unique(np.stack([np.concatenate((a, s["bwt"][back])), np.concatenate((b, s["interval"][back]))], 1), axis=0, return_inverse=True)
    name = np.zeros(len(keys), np.int64)
    name[at.ravel()[: len(a)]] = number
    got = name[at.ravel()[len(a) :]]
    interval, reach = s["interval"].copy(), s["reach"].copy()
    # Only growing suffixes reach this depth; those that are long enough keep their interval for the ones in front.
    interval[s["reach"] < ENOUGH] = 0
    interval[grown] = got
    reach[grown] = s["length"][grown] + s["reach"][back]
    best = np.where(interval > 0, np.maximum(s["best"], reach), s["best"])
    return _packed(row["shard"], s | {"interval": interval, "reach": reach, "best": best})


def _numbered(rows: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """Rows (``of, <keys>, n``) whose key occurs twice or more over all shards, with its number ``id`` in the order of the keys; no depth shares a number.

    One exchange by ranges brings the rows of a key together, one for each shard at most, so the number needs no
    second table. The driver orders 300 sampled rows for each range: their count follows the rows up to ``RANGES``.
    """
    ranges = min(RANGES, 2 + rows.count() // RANGE_ROWS)
    placed = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id())
    same = W.partitionBy(*keys)
    found = placed.withColumns({"_n": F.sum("n").over(same), "id": F.min("id").over(same) + 1 + (depth << 54)})
    return found.filter("_n > 1").select("of", *keys, "id")


def merge(spark: SparkSession, at: str) -> tuple[DataFrame, list[str]]:
    """``uid, js, bests``: for each suffix of a text's symbols with a copy, the bytes of its longest common prefix; and the folders it reads.

    ``at`` has the parsed texts; their phrases and symbols are deleted as soon as the transforms have them.
    """
    kind = StructType.fromDDL(_STATE_SCHEMA)

    def read(path: str, part: str, kind: StructType = kind) -> DataFrame:
        return spark.read.schema(kind).parquet(path).filter(F.col("part") == part)

    parsed = StructType.fromDDL("part string, shard bigint, uid bigint, steps binary, symbols binary, symbol bigint, n bigint")
    symbols = read(at, "symbol", parsed).select(F.col("shard").alias("of"), "symbol", "n")
    mine = _numbered(symbols, ["symbol"], 0)
    texts = read(at, "phrase", parsed).select("shard", "uid", "steps", "symbols")
    paths = [written(texts.groupBy("shard").cogroup(mine.groupBy("of")).applyInArrow(_transform, _STATE_SCHEMA), "part")]
    for path in (f"{at}/part=phrase", f"{at}/part=symbol"):
        delete(spark, path)
    del symbols, mine, texts
    free_shuffles(spark)
    while not (pairs := read(paths[-1], "pair")).isEmpty():
        pairs = pairs.select(F.col("shard").alias("of"), F.col("bwt_key").alias("a"), F.col("interval_key").alias("b"), "n")
        mine = _numbered(pairs, ["a", "b"], len(paths))
        open_ = read(paths[-1], "open").select("shard", *_STATE)
        paths.append(written(open_.groupBy("shard").cogroup(mine.groupBy("of")).applyInArrow(_refine, _STATE_SCHEMA), "part"))
        # The next state is written, so nothing reads this one again.
        for part in ("open", "pair"):
            delete(spark, f"{paths[-2]}/part={part}")
        del pairs, mine, open_
        if len(paths) % FREE_ROUNDS == 2:
            free_shuffles(spark)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                uid, j, best = (np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in _DONE.items())
                order = np.lexsort((j, uid))
                u, first = np.unique(uid[order], return_index=True)
                bounds = np.append(first, len(uid))
                yield pa.record_batch({"uid": pa.array(u), "js": _arrays(j[order], bounds), "bests": _arrays(best[order], bounds)})

    done = reduce(DataFrame.unionByName, [read(path, "done").select(*_DONE) for path in paths])
    parts = done.mapInArrow(rows_of, "uid bigint, js binary, bests binary")
    listed = parts.groupBy("uid").agg(F.collect_list(F.struct("js", "bests")).alias("l"))
    whole = lambda c: F.aggregate("l", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x[c])).alias(c)
    return listed.select("uid", whole("js"), whole("bests")), paths


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans inside repeated intervals (``start, end``), and the anchors that have copies (``key`` and on)."""
    nothing = pa.nulls
    for batch in batches:
        if not batch.num_rows:
            continue
        get = lambda c, kind: _joined(pa.chunked_array([batch.column(c)]), kind)
        (keys, _), (around, _) = (get(c, np.uint64) for c in ("keys", "around"))
        size = batch.column("n_bytes").to_numpy()
        at, low, high, bare, count = _anchors(*(pa.chunked_array([batch.column(c)]) for c in ("steps", "lows")), size)
        js, found = _joined(pa.chunked_array([_filled(batch.column("js"))]), np.int32)
        bests, _ = _joined(pa.chunked_array([_filled(batch.column("bests"))]), np.int32)
        first = np.cumsum(count) - count
        row = np.repeat(np.arange(batch.num_rows), count)
        best = np.zeros(len(at), np.int64)
        best[np.repeat(first, found) + js] = bests
        base = np.concatenate(([0], np.cumsum(size + 1)))
        marks = np.zeros(base[-1] + 1, np.int64)
        whole = np.flatnonzero(best >= LENGTH)
        np.add.at(marks, base[row[whole]] + at[whole], 1)
        np.add.at(marks, base[row[whole]] + at[whole] + best[whole] - LENGTH + 1, -1)
        inside = np.cumsum(marks)[:-1] > 0
        before = np.concatenate(([0], np.cumsum(inside)))
        stop = np.maximum(low, high + 1)
        left = (stop - low) - (before[base[row] + stop] - before[base[row] + low])
        # The common phrases must reach the last anchor that equal windows surely share.
        sure = np.searchsorted(base[row] + at, base[row] + low + LENGTH - (SPAN + GRAM - 1), "right") - 1
        sure = np.maximum(sure, np.arange(len(at)))
        # Anchors without a symbol are not in the transform, so a chain ends at the first of them; a text's last anchor is one.
        ends = np.flatnonzero(bare)
        sure = np.minimum(sure, ends[ends.searchsorted(np.arange(len(at)))])
        copied = bare & (keys > 0) | (best > 0) & (at + best >= at[sure])
        keep = np.flatnonzero((high >= low) & (keys > 0) & (copied | (best > 0)))
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = base.searchsorted(begin, "right") - 1
        uid = batch.column("uid").to_numpy()
        n = len(begin)
        yield pa.record_batch(
            {
                "uid": pa.array(np.concatenate((uid[of], uid[row[keep]]))),
                "start": pa.concat_arrays([pa.array(begin - base[of]), nothing(len(keep), pa.int64())]),
                "end": pa.concat_arrays([pa.array(end - base[of] - 1 + LENGTH), nothing(len(keep), pa.int64())]),
                "key": pa.concat_arrays([nothing(n, pa.int64()), pa.array(keys[keep].view(np.int64))]),
                "around": pa.concat_arrays([nothing(n, pa.int64()), pa.array(around[keep].view(np.int64))]),
                "at": pa.concat_arrays([nothing(n, pa.int64()), pa.array(at[keep])]),
                "low": pa.concat_arrays([nothing(n, pa.int64()), pa.array(low[keep])]),
                "high": pa.concat_arrays([nothing(n, pa.int64()), pa.array(high[keep])]),
                "edge": pa.concat_arrays([nothing(n, pa.bool_()), pa.array((copied & (left > 0))[keep])]),
            }
        )


def _filled(column: pa.Array) -> pa.Array:
    return column.fill_null(b"")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each anchor in blocks at equal steps before it, with the hash of the bytes that a whole block shares."""
    opened = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(batch.num_rows):
            h = Rolling(np.frombuffer(opened(batch.column("z")[i].as_py()), np.uint8))
            ranges = batch.column("ranges")[i].values
            at, low, high, alone = (ranges.field(k).to_numpy(zero_copy_only=False) for k in ("at", "low", "high", "alone"))
            near, far = (at - high) // BLOCK, (at - low) // BLOCK
            of = np.repeat(np.arange(len(at)), far - near + 1)
            last = at[of] - BLOCK * (near[of] + np.arange(len(of)) - np.repeat(np.cumsum(far - near + 1) - (far - near + 1), far - near + 1))
            core = w.mix(h.run(last, last - (BLOCK - 1) + LENGTH) ^ (at[of] - last).astype(np.uint64))
            yield pa.record_batch(
                {
                    "core": pa.array(core.view(np.int64)), "uid": pa.array(np.full(len(of), batch.column("uid")[i].as_py())),
                    "low": pa.array(np.maximum(low[of], last - (BLOCK - 1))), "high": pa.array(np.minimum(high[of], last)), "alone": pa.array(alone[of]),
                }
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hashes of all windows in the given ranges."""
    opened = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(batch.num_rows):
            raw = np.frombuffer(opened(batch.column("z")[i].as_py()), np.uint8)
            h = Rolling(raw)
            ranges = batch.column("ranges")[i].values
            low, high, alone = (ranges.field(k).to_numpy(zero_copy_only=False) for k in ("low", "high", "alone"))
            size = high + 1 - low
            start = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
            alone = np.repeat(alone, size)
            yield pa.record_batch(
                {
                    "h1": pa.array(h.run(start, start + LENGTH).view(np.int64)), "h2": pa.array(h.run(start, start + LENGTH, 1).view(np.int64)),
                    "uid": pa.array(np.full(len(start), batch.column("uid")[i].as_py())), "start": pa.array(start.astype(np.int32)), "alone": pa.array(alone),
                }
            )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each text as maximal runs, in order."""
    for batch in batches:
        spans = batch.column("spans")
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(spans).to_numpy(zero_copy_only=False))
        start, end = (spans.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("start", "end"))
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        # Every row has a stretch of its own, with a gap behind it, so runs never join those of the next row.
        base = row * (end.max(initial=0) + 2)
        reach = np.maximum.accumulate(base + end)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (base + start)[1:] > reach[:-1])))
        last = np.append(first[1:], len(row))[: len(first)] - 1
        runs = pa.StructArray.from_arrays([pa.array(start[first], pa.int64()), pa.array((reach - base)[last], pa.int64())], ["start", "end"])
        bounds = row[first].searchsorted(np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.record_batch([batch.column("uid"), pa.ListArray.from_arrays(pa.array(bounds), runs)], ["uid", "spans"])


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        removed, runs, sha = [], [], []
        for spans, z, whole in zip(batch.column("spans"), batch.column("z"), batch.column("sha").to_pylist()):
            start, end = (spans.values.field(k).to_pylist() for k in ("start", "end")) if spans.is_valid else ((), ())
            if start:
                data = opened(z.as_py())
                whole = hashlib.sha256(b"".join(data[a:b] for a, b in zip([0, *end], [*start, len(data)]))).hexdigest()
            removed.append(sum(end) - sum(start))
            runs.append(len(start))
            sha.append(whole)
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), batch.column("spans")],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def _ranged(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Texts with the list of their ranges (all columns but ``uid``)."""
    listed = ranges.groupBy("uid").agg(F.collect_list(F.struct(*(c for c in ranges.columns if c != "uid"))).alias("ranges"))
    return texts.select("uid", "z").join(listed, "uid")


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The parsed texts (``uid`` and on) and ``uid, spans``: maximal runs of bytes covered by a string that starts elsewhere too."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    schema = f"part string, shard bigint, uid bigint, doc_id {kind}, n_bytes bigint, sha string, z binary, steps binary, lows binary, symbols binary, keys binary, around binary, symbol bigint, n bigint"
    rows_at = written(docs.select("doc_id", "text").mapInArrow(_parse, schema), "part")
    merged, states = merge(spark, rows_at)
    anchored = spark.read.schema(schema).parquet(rows_at).filter(F.col("part") == "anchor")
    found = anchored.join(merged, "uid", "left").select("uid", "n_bytes", "steps", "lows", "keys", "around", "js", "bests")
    found_schema = "uid bigint, start bigint, end bigint, key bigint, around bigint, at bigint, low bigint, high bigint, edge boolean"
    found_at = written(found.mapInArrow(_covered, found_schema))
    found = spark.read.schema(found_schema).parquet(found_at)
    for path in (*states, f"{rows_at}/part=anchor"):
        delete(spark, path)
    texts = spark.read.schema(schema).parquet(rows_at).filter(F.col("part") == "text")
    del merged
    free_shuffles(spark)
    anchors = found.filter("key is not null")
    near = anchors.join(anchors.filter("edge").select("key").distinct(), "key", "left_semi")
    classes = near.groupBy("key", "around").agg(F.count("*").alias("n"), F.min(F.struct("uid", "at", "low", "high")).alias("head"))
    classes_at = written(classes)
    classes = spark.read.schema(classes.schema).parquet(classes_at)
    many = near.filter("edge").join(classes.filter("n > 1").select("key", "around"), ["key", "around"]).select("uid", F.col("low").alias("start"), (F.col("high") + LENGTH).alias("end"))
    several = classes.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    heads = classes.join(several, "key", "left_semi").select("head.uid", "head.at", "head.low", "head.high", (F.col("n") == 1).alias("alone"))
    block_schema = "core bigint, uid bigint, low bigint, high bigint, alone boolean"
    at = written(_ranged(texts, heads).mapInArrow(_blocks, block_schema))
    blocks = spark.read.schema(block_schema).parquet(at)
    free_shuffles(spark)
    # Only an unsettled class asks, and equal windows lie in blocks with equal common bytes.
    asked = blocks.groupBy("core").agg(F.count("*").alias("n"), F.bool_or("alone").alias("open")).filter("n > 1 and open").select("core")
    window_schema = "h1 bigint, h2 bigint, uid bigint, start int, alone boolean"
    windows_at = written(_ranged(texts, blocks.join(asked, "core", "left_semi").drop("core")).mapInArrow(_windows, window_schema))
    windows = spark.read.schema(window_schema).parquet(windows_at)
    delete(spark, at)
    free_shuffles(spark)
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    last = windows.filter("alone").join(twice, ["h1", "h2"], "left_semi").select("uid", F.col("start").cast("long").alias("start"), (F.col("start") + LENGTH).cast("long").alias("end"))
    spans = found.filter("start is not null").select("uid", "start", "end").unionByName(many).unionByName(last)
    listed = spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    runs = staged(listed.mapInArrow(_runs, "uid bigint, spans array<struct<start:bigint,end:bigint>>"))
    # The texts are shuffled once more to meet their runs: all else is off the disk by then.
    for path in (found_at, classes_at, windows_at):
        delete(spark, path)
    free_shuffles(spark)
    return texts, runs


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (byte spans: the removed runs, in order)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts, spans = repeated(docs)
    joined = texts.select("uid", "doc_id", "n_bytes", "sha", "z").join(spans, "uid", "left").select("doc_id", "n_bytes", "sha", "z", "spans")
    return joined.mapInArrow(_results, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")
