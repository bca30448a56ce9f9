"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the word windows of benchmark items; the symbols of the search are words. For each pattern
length the tables are: a shift for every block of two words that occurs in a pattern (all other blocks allow
the greatest shift), and for blocks that end a pattern (shift 0) the bucket of patterns with that suffix. The
search hops over the words of all texts of a slice at once, each text by its own shifts; a hit in a bucket is
confirmed by direct comparison of the words' bytes.

Patterns are taken in blocks of at most ``PATTERNS`` windows, so the tables sent to a task are bounded and a
larger benchmark means more passes.

Defined results: null and empty texts have no words and are clean; null items are skipped; equal items with
different ids all count; repeated rows and other columns do no harm; an empty benchmark leaves all clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitscore.llm import words as w
from pitscore.llm.common import filled, slices

WINDOW = 13
PATTERNS = 250_000


class Tables:
    """Shift and bucket tables of equally long patterns (rows of word hashes)."""

    def __init__(self, hashes: np.ndarray, texts: np.ndarray, items: list[np.ndarray]):
        self.m, self.items = hashes.shape[1], items
        self.block = min(2, self.m)
        blocks = _blocks(hashes.ravel(), self.block)
        keys, shifts = [], []
        for end in range(self.block, self.m + 1):
            keys.append(blocks[np.arange(len(hashes)) * self.m + end - self.block])
            shifts.append(np.full(len(hashes), self.m - end))
        k, s = np.concatenate(keys), np.concatenate(shifts)
        order = np.lexsort((s, k))
        self.keys, first = np.unique(k[order], return_index=True)
        self.shifts = s[order][first]
        suffix = keys[-1]
        self.order = np.argsort(suffix, kind="stable")
        self.suffix, self.hashes, self.texts = suffix[self.order], hashes[self.order], texts[self.order]

    def search(self, raw: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """(word index of an occurrence, pattern) in texts whose words are ``bounds[i]:bounds[i + 1]``."""
        if len(hashes) < self.m:
            return
        blocks = _blocks(hashes, self.block)
        at = np.minimum(self.keys.searchsorted(blocks), len(self.keys) - 1)
        shift = np.where(self.keys[at] == blocks, self.shifts[at], self.m - self.block + 1)
        pos, stop = bounds[:-1] + self.m - self.block, bounds[1:] - self.block + 1
        while True:
            live = pos < stop
            pos, stop = pos[live], stop[live]
            if not len(pos):
                return
            step = shift[pos]
            hit = pos[step == 0]
            if len(hit):
                low, high = self.suffix.searchsorted(blocks[hit]), self.suffix.searchsorted(blocks[hit], "right")
                reach = int((high - low).max())
                for j in range(reach):
                    some = low + j < high
                    start, pattern = hit[some] + self.block - self.m, (low + j)[some]
                    same = np.ones(len(start), bool)
                    for i in range(self.m):
                        same &= hashes[start + i] == self.hashes[pattern, i]
                    for a, p in zip(start[same], pattern[same]):
                        if b" ".join(raw[starts[a + i] : ends[a + i]] for i in range(self.m)) == self.texts[p]:
                            yield int(a), int(p)
            pos = pos + np.maximum(step, 1)


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    return hashes if size == 1 else w.mix(hashes[:-1] * w._P + hashes[1:])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        low, starts, ends, doc = w.words(batch.column("text"), w.NOT_ALNUM)
        raw, bounds = low.tobytes(), doc.searchsorted(np.arange(batch.num_rows + 1))
        ids, texts = [], []
        for item, a, b in zip(batch.column("item_id").to_pylist(), bounds, bounds[1:]):
            for i in range(a, max(a, b - WINDOW) + 1 if b > a else a):
                ids.append(item)
                texts.append(b" ".join(raw[starts[j] : ends[j]] for j in range(i, min(b, i + WINDOW))))
        yield pa.record_batch({"item_id": pa.array(ids, batch.schema.field("item_id").type), "w": pa.array(texts, pa.binary())})


def benchmark_tables(benchmark: DataFrame) -> Iterator[list[Tables]]:
    """Search tables of the benchmark's windows, one list for each block of ``PATTERNS`` windows."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    windows = benchmark.filter("item_id is not null").select("item_id", "text").mapInArrow(_windows, f"item_id {kind}, w binary")
    per_window = windows.groupBy("w").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    block: list[tuple[bytes, list]] = []
    for r in per_window.toLocalIterator():
        block.append((bytes(r.w), r.items))
        if len(block) == PATTERNS:
            yield _tables(block)
            block = []
    if block:
        yield _tables(block)


def _tables(block: list[tuple[bytes, list]]) -> list[Tables]:
    lengths = np.array([t.count(b" ") + 1 for t, _ in block])
    out = []
    for m in np.unique(lengths):
        mine = np.flatnonzero(lengths == m)
        texts = [block[i][0] for i in mine]
        low, starts, ends, _ = w.words(pa.array([t.decode() for t in texts], pa.string()), w.NOT_ALNUM)
        hashes = w.span_hashes(low, starts, ends).reshape(len(mine), m)
        tables = Tables(hashes, np.array([*texts, None], object)[:-1], [])
        tables.items = [block[mine[i]][1] for i in tables.order]
        out.append(tables)
    return out


def occurrences(docs: DataFrame, benchmark: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words, n_hit, items`` (sorted ids of items with an occurring window).

    Input columns of these names are replaced. With several blocks of patterns, each block is one more
    pass over the texts, and hit words and items are united row by row.
    """
    spark, item = docs.sparkSession, benchmark.schema["item_id"].dataType
    added = [T.StructField("_hit", T.BinaryType()), T.StructField("items", T.ArrayType(item)), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType())]
    kept = [f for f in docs.schema.fields if f.name not in {"text", *(a.name for a in added)}]
    state = docs.select("text", *[F.col(f"`{f.name}`") for f in kept], F.lit(b"").alias("_hit"), F.lit(None).cast(T.ArrayType(item)).alias("items"))
    blocks = benchmark_tables(benchmark)
    tables = next(blocks, [])
    while tables is not None:
        after = next(blocks, None)
        fields = [docs.schema["text"]] * (keep_text or after is not None) + kept + added
        state = state.drop("n_words", "n_hit").mapInArrow(_searcher(spark.sparkContext.broadcast(tables), [f.name for f in fields]), T.StructType(fields))
        tables = after
    return state.drop("_hit")


def _searcher(sent, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for batch in slices(batches, fill=False):
            low, starts, ends, doc = w.words(filled(batch.column("text")), w.NOT_ALNUM)
            bounds = doc.searchsorted(np.arange(batch.num_rows + 1))
            hashes, raw = w.span_hashes(low, starts, ends), low.tobytes()
            marks, items = np.zeros(len(starts) + 1, np.int64), [set(x or ()) for x in batch.column("items").to_pylist()]
            for t in tables:
                for a, p in t.search(raw, hashes, starts, ends, bounds):
                    marks[a] += 1
                    marks[a + t.m] -= 1
                    items[doc[a]].update(t.items[p])
            hit = np.cumsum(marks)[:-1] > 0
            for i, old in enumerate(batch.column("_hit").to_pylist()):
                if old:
                    hit[bounds[i] : bounds[i + 1]] |= np.unpackbits(np.frombuffer(old, np.uint8))[: bounds[i + 1] - bounds[i]] > 0
            total = np.concatenate(([0], np.cumsum(hit)))
            n_hit = total[bounds[1:]] - total[bounds[:-1]]
            columns = {
                "_hit": pa.array([np.packbits(hit[a:b]).tobytes() if n else b"" for a, b, n in zip(bounds, bounds[1:], n_hit)], pa.binary()),
                "items": pa.array([sorted(x) for x in items], batch.schema.field("items").type),
                "n_words": pa.array(np.diff(bounds)),
                "n_hit": pa.array(n_hit),
            }
            yield pa.record_batch({n: columns[n] if n in columns else batch.column(n) for n in names})

    return run


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """A document counts as contaminated from a twentieth of its words on."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``."""
    marks = {"_hit", "items", "n_words", "n_hit"}
    own = [c for c in docs.columns if c in marks]
    found = occurrences(docs.withColumnsRenamed({c: f"_own_{c}" for c in own}), benchmark)
    return found.filter(~contaminated()).select(*[F.col(f"`_own_{c}`").alias(c) if c in marks else F.col(f"`{c}`") for c in docs.columns])
