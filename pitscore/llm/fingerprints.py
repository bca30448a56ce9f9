"""I-Match document fingerprints.

The lexicon holds the terms whose document frequency lies in a band of all documents' number. A document's
distinct lexicon terms are sorted, and subsets of them hashed: subset r at level j keeps a term when the
first j bits of the term's r-th random value are zero, so about one in ``2**j``. A fingerprint holds
``SUBSETS`` hashes at the three levels around the logarithm of the document's number of terms, where a
subset has about one to three terms. The likeness of two fingerprints is the share of equal hashes among the
subsets that have terms in either, over the levels both hold.

The lexicon is sent to all tasks. Each of its terms is in at least ``low`` of all documents, so there are at
most (mean distinct terms of a document) / ``low`` terms, however many documents there are.

Defined results: null and empty texts have no terms and share one fingerprint, likeness 1 among themselves
and 0 to others; a document without lexicon terms is fingerprinted by all its terms; repeated rows are
neighbours of each other; rows without ``doc_id`` come last; a single row is its own next document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore.llm import words as w
from pitscore.llm.common import SLICE_BYTES, slices

LOW, HIGH = 0.002, 0.25
SUBSETS = 16
#: Bytes of text dealt to one bucket of the descending order.
BUCKET_BYTES = 32 << 20
_SALTS = np.random.Generator(np.random.PCG64(10)).integers(1, 2**63, SUBSETS, dtype=np.uint64)
_HEX = 6


def _terms(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and distinct term hashes, sorted by both."""
    low, starts, ends, doc = w.words(texts, w.NOT_ALNUM)
    h = w.span_hashes(low, starts, ends)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in at least ``low`` and at most ``high`` of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, times, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in slices(batches):
            n += batch.num_rows
            h, c = np.unique(_terms(batch.column("text"))[1], return_counts=True)
            h, at = np.unique(np.concatenate((seen, h)), return_inverse=True)
            times = np.bincount(at, np.concatenate((times, c)), len(h)).astype(np.int64)
            seen = h
        for i in range(0, len(seen), 1 << 16):
            yield pa.record_batch({"term": pa.array(seen[i : i + (1 << 16)].view(np.int64)), "df": pa.array(times[i : i + (1 << 16)])})

    n = docs.count()
    counts = docs.select("text").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    kept = counts.filter((F.col("df") >= math.ceil(low * n)) & (F.col("df") <= math.floor(high * n))).select("term")
    found = kept.toArrow().column("term").to_numpy() if n else np.zeros(0, np.int64)
    return np.sort(found.astype(np.int64).view(np.uint64))


def fingerprints(texts: pa.StringArray, known: np.ndarray) -> list[str]:
    doc, h = _terms(texts)
    if len(known):
        inside = known[np.minimum(known.searchsorted(h), len(known) - 1)] == h
        some = np.bincount(doc, inside, len(texts)) > 0
        keep = inside | ~some[doc]
        doc, h = doc[keep], h[keep]
    m = np.bincount(doc, minlength=len(texts))
    level = np.maximum(1, np.round(np.log2(np.maximum(m, 1))).astype(int))
    value = w.mix(h ^ np.uint64(0xC0FFEE))
    out = np.zeros((len(texts), 3, SUBSETS), np.uint64)
    for r in range(SUBSETS):
        zeros = 64 - np.frexp(np.maximum(w.mix(h ^ _SALTS[r]).astype(np.float64), 0.5))[1]
        for k in range(3):
            inside = zeros >= level[doc] + k - 1
            d, v = doc[inside], value[inside]
            if len(d):
                first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                out[d[first], k, r] = w.mix(np.add.reduceat(v, first)) % np.uint64((1 << 4 * _HEX) - 1) + np.uint64(1)
    rows = out.reshape(len(texts), -1)
    return [f"{l:02d}" + "".join(f"{x:0{_HEX}x}" for x in row) for l, row in zip(level, rows.tolist())]


def likeness(a: str, b: str) -> float:
    """Share of equal subset hashes of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    la, lb = int(a[:2]), int(b[:2])
    same = total = 0
    size = SUBSETS * _HEX
    for level in range(max(la, lb) - 1, min(la, lb) + 2):
        x, y = a[2 + (level - la + 1) * size :], b[2 + (level - lb + 1) * size :]
        for i in range(0, size, _HEX):
            p, q = x[i : i + _HEX], y[i : i + _HEX]
            if p != "0" * _HEX or q != "0" * _HEX:
                total += 1
                same += p == q
    return same / total if total else 0.0


def _ordered(docs: DataFrame) -> DataFrame:
    """``bucket, edge, doc_id, z`` sorted within partitions, descending by id.

    A bucket is a range of ids whose first id is known exactly, because splitters are ids that occur. The
    rows with that id also go to the bucket before as its ``edge``, so each task sees the document after its
    last one.
    """
    size = docs.agg(F.max("doc_id").alias("top"), F.sum(F.octet_length("text")).alias("bytes"), F.count("doc_id").alias("n")).first()
    n = max(1, math.ceil((size.bytes or 0) / BUCKET_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism * 2, size.n // 64))
    shares = [i / n for i in range(1, n)]
    inner = docs.agg(F.percentile_approx("doc_id", shares, 10_000 + 10 * n).alias("p")).first().p if shares else []
    splitters = np.unique(np.array([*(inner or []), size.top if size.top is not None else np.iinfo(np.int64).min], np.int64))
    kind, last = docs.schema["doc_id"].dataType.simpleString(), len(splitters) - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shut = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
            at = splitters.searchsorted(ids)
            first = np.flatnonzero(splitters[at] == ids)
            rows = np.concatenate((np.arange(len(ids)), first))
            z = pa.array([shut(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            before = np.where(at[first] == last, 0, at[first] + 1)
            yield pa.record_batch(
                {
                    "bucket": pa.array(np.concatenate((at, before)).astype(np.int32)),
                    "edge": pa.array(np.concatenate((np.zeros(len(ids)), np.ones(len(first)))).astype(np.int32)),
                    "doc_id": batch.column("doc_id").take(pa.array(rows)),
                    "z": z.take(pa.array(rows)),
                }
            )

    dealt = docs.select("doc_id", "text").mapInArrow(deal, f"bucket int, edge int, doc_id {kind}, z binary")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "edge", F.desc_nulls_last("doc_id"), F.xxhash64("z"))


def match(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likeness to it and to the next document.

    The next document is the one with the next smaller id, after the last the first. The edited text has
    its last third replaced by the first code points of the next document.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def finish(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        """Results of all rows but the last, each against the one after it."""
        texts = [t for _, _, _, t in rows]
        edited = []
        for t, after in zip(texts, texts[1:]):
            k = len(t) // 3
            edited.append(t[: len(t) - k] + after[:k])
        prints, other = fingerprints(pa.array(texts, pa.string()), sent.value), fingerprints(pa.array(edited, pa.string()), sent.value)
        out = []
        for i, e in enumerate(edited):
            bucket, edge, doc_id, t = rows[i]
            if not edge and rows[i + 1][0] == bucket:
                out.append((doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), prints[i], other[i], likeness(prints[i], other[i]), likeness(prints[i], prints[i + 1])))
        kinds = (id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for bucket, edge, doc_id, z in zip(*(batch.column(c) for c in ("bucket", "edge", "doc_id", "z"))):
                raw = open_(z.as_py())
                rows.append((bucket.as_py(), edge.as_py(), doc_id.as_py(), raw.decode()))
                size += len(raw)
                if size > SLICE_BYTES and len(rows) > 1:
                    yield finish(rows, id_type)
                    rows, size = rows[-1:], len(raw)
        if len(rows) > 1:
            yield finish(rows, id_type)

    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _ordered(docs).select("bucket", "edge", "doc_id", "z").mapInArrow(run, schema)
