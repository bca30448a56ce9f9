"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model scores each sentence by its words; noisy-or joins
the sentences, ``1 - prod(1 - p)``. Only documents have labels: the gradient of the bag's likelihood
reaches the sentences through noisy-or, so the model finds out which sentences offend.

Defined results: a null or empty text has no sentence and scores 0; rows without ``doc_id`` are scored
but never learnt from; several labels of one document count as toxic if one does; without labels of both
kinds every score is 0; repeated rows are scored each; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscore.llm import words as w
from pitscore.llm.common import slices, staged

#: Bounds of the training sample: documents of each label, and code points of all of them.
SAMPLE_DOCS, SAMPLE_CHARS = 4000, 24_000_000
#: A word is a feature if its counts over documents of both labels have this log-likelihood ratio (G squared).
ASSOCIATION = 20.0
_NEWLINE, _END_MARKS = 10, np.frombuffer(b".!?", np.uint8)


@dataclass(frozen=True)
class Model:
    """Sorted word hashes with their weights, and the intercept of a sentence."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def held_out(fold: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo 5; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == fold, F.lit(False))


def _sentences(arr: pa.StringArray) -> tuple[np.ndarray, ...]:
    """Bytes, text offsets, sentence-end flags, word hashes, sentence and text number of each word."""
    low, starts, ends, doc = w.words(arr, w.NOT_ALNUM)
    _, off = w.text_bytes(arr)
    after = np.full(len(low), 32, np.uint8)
    after[:-1] = low[1:]
    close = (low == _NEWLINE) | (np.isin(low, _END_MARKS) & w.SPACE[after])
    ends_of_texts = off[1:][off[1:] > off[:-1]] - 1
    close[ends_of_texts] = True
    number = np.concatenate(([0], np.cumsum(close)))
    return low, off, close, w.span_hashes(low, starts, ends), number[starts], doc


def sample(docs: DataFrame, labels: DataFrame, fold: int) -> DataFrame:
    """A bounded sample (``doc_id, text, toxic, weight``) of the labelled rows outside the held-out fold, both labels alike.

    A sampled row stands for ``weight`` labelled rows of its label, so the sample keeps the labels' natural shares.
    Of rows with one id the smallest text counts. Texts are read once and written.
    """
    spark, known = docs.sparkSession, labels.filter(~held_out(fold) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).join(docs.select("doc_id"), "doc_id", "left_semi")
    rows = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id", F.lit(8))
    ids = [tuple(r) for t in (0, 1) for r in known.filter(F.col("toxic") == t).orderBy(order, "doc_id").limit(SAMPLE_DOCS).collect()]
    kind = f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, toxic int"
    # At most 2 * SAMPLE_DOCS ids.
    picked = F.broadcast(spark.createDataFrame(ids, kind))
    found = staged(docs.select("doc_id", "text").join(picked, "doc_id"))
    found = found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.coalesce(F.min("text"), F.lit("")).alias("text"))
    sizes = sorted(found.select("doc_id", "toxic", F.length("text"), F.xxhash64("doc_id", F.lit(9))).collect(), key=lambda r: (r[3], r[0]))
    total, kept = 0, []
    for doc_id, toxic, n, _ in sizes:
        if total + n <= SAMPLE_CHARS:
            total += n
            kept.append((doc_id, toxic))
    have = {t: sum(toxic == t for _, toxic in kept) for t in (0, 1)}
    weighted = spark.createDataFrame([(i, rows[t] / have[t]) for i, t in kept], f"{kind.split(',')[0]}, weight double")
    return found.join(F.broadcast(weighted), "doc_id").select("doc_id", "text", "toxic", "weight")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold a word."""
    for batch in slices(batches):
        hashes, doc = _sentences(batch.column("text"))[3::2]
        words, at = np.unique(hashes, return_inverse=True)
        pairs = np.unique(at * batch.num_rows + doc)
        toxic = batch.column("toxic").to_numpy()[pairs % max(1, batch.num_rows)]
        n = [np.bincount(pairs // max(1, batch.num_rows), toxic == t, len(words)).astype(np.int64) for t in (0, 1)]
        yield pa.record_batch({"word": pa.array(words.view(np.int64)), "clean": pa.array(n[0]), "toxic": pa.array(n[1])})


def _association(clean: int, toxic: int) -> Column:
    """G squared of a word against the label, from the documents of each label that hold it and ``clean``, ``toxic`` documents in all."""
    total, parts = F.col("clean") + F.col("toxic"), []
    for have, size in ((F.col("clean"), clean), (F.col("toxic"), toxic)):
        for seen, expected in ((have, total * F.lit(size / (clean + toxic))), (size - have, (clean + toxic - total) * F.lit(size / (clean + toxic)))):
            parts.append(F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0))
    return 2 * sum(parts[1:], parts[0])


def _bags(features: np.ndarray):
    """Per document: its sentences with words, and the distinct pairs of sentence and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, sentence, doc = _sentences(batch.column("text"))[3:]
            # A sentence belongs to one text, so numbers of sentences with words run through the texts.
            numbers, of = np.unique(sentence, return_inverse=True)
            bag = np.zeros(len(numbers), np.int64)
            bag[of] = doc
            first = bag.searchsorted(np.arange(batch.num_rows + 1))
            at = np.minimum(features.searchsorted(hashes), max(0, len(features) - 1))
            known = features[at] == hashes if len(features) else np.zeros(len(hashes), bool)
            pairs = np.unique(of[known] * (len(features) + 1) + at[known])
            of, at = pairs // (len(features) + 1), pairs % (len(features) + 1)
            cut = of.searchsorted(first)
            yield pa.record_batch(
                {
                    "toxic": batch.column("toxic"),
                    "weight": batch.column("weight"),
                    "sentences": pa.array(np.diff(first)),
                    "of": pa.array([(of[a:b] - f).astype(np.int32).tobytes() for a, b, f in zip(cut, cut[1:], first)], pa.binary()),
                    "at": pa.array([at[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                }
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, fold: int = 0, steps: int = 300) -> Model:
    """Train on a sample of at most ``2 * SAMPLE_DOCS`` labelled documents and ``SAMPLE_CHARS`` code points.

    Words are counted and chosen in Spark; the driver gets only the chosen words and where they occur. Without
    labelled documents of both labels nothing is learnt; without any word only the intercept remains.
    """
    found = staged(sample(docs, labels, fold).select("doc_id", "toxic", "weight", "text"))
    size = {r.toxic: r["count"] for r in found.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -20.0)
    counted = found.select("toxic", "text").mapInArrow(_counts, "word bigint, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    chosen = counted.filter(_association(size[0], size[1]) >= ASSOCIATION).select("word").collect()
    features = np.sort(np.array([r.word for r in chosen], np.int64).view(np.uint64))
    rows = found.orderBy("doc_id").select("toxic", "weight", "text").mapInArrow(_bags(features), "toxic int, weight double, sentences bigint, of binary, at binary").toArrow()
    y, sentences = rows.column("toxic").to_numpy().astype(float), rows.column("sentences").to_numpy()
    pairs_of, pairs_at = ([np.frombuffer(x, np.int32) for x in rows.column(c).to_pylist()] for c in ("of", "at"))
    base = np.cumsum(sentences) - sentences
    of = np.concatenate([x + b for x, b in zip(pairs_of, base)]).astype(np.int64)
    at = np.concatenate(pairs_at).astype(np.int64)
    n, k = int(sentences.sum()), len(features)
    bag = np.repeat(np.arange(len(y)), sentences)
    theta, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    theta[k] = -4.0
    share = rows.column("weight").to_numpy()
    share = share / share.sum()
    for t in range(1, steps + 1):
        z = theta[k] + np.bincount(of, theta[at], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(-np.bincount(bag, np.logaddexp(0, z), len(y)))
        pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) * share
        g = p * pull[bag]
        grad = np.concatenate((np.bincount(at, g[of], k), [g.sum()]))
        grad[:k] += 1e-5 * theta[:k]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(features, theta[:k], float(theta[k]))


def _judge(batch: pa.RecordBatch, model: Model) -> tuple[np.ndarray, ...]:
    """Scores of the texts; probability, text, first and last byte of each sentence with words."""
    low, off, close, hashes, sentence, doc = _sentences(batch.column("text"))
    numbers, of = np.unique(sentence, return_inverse=True)
    z = np.full(len(numbers), model.bias)
    if len(model.words) and len(hashes):
        at = np.minimum(model.words.searchsorted(hashes), len(model.words) - 1)
        known = np.flatnonzero(model.words[at] == hashes)
        once = known[np.unique(of[known] * (len(model.words) + 1) + at[known], return_index=True)[1]]
        z = z + np.bincount(of[once], model.weights[at[once]], len(numbers))
    bag = np.zeros(len(numbers), np.int64)
    bag[of] = doc
    score = -np.expm1(-np.bincount(bag, np.logaddexp(0, z), batch.num_rows)) if len(numbers) else np.zeros(batch.num_rows)
    stops = np.concatenate(([0], np.flatnonzero(close) + 1))
    start = np.maximum(stops[numbers], off[bag]) if len(numbers) else numbers
    return np.clip(score, 0.0, 1.0), 1 / (1 + np.exp(-z)), bag, start, stops[numbers + 1] if len(numbers) else numbers, low, off


def filter_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([_judge(part, model)[0] for part in slices(iter([batch]))] or [np.zeros(0)])
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``doc_id, score, n_sentences, offending``: the spans (code points, end exclusive) of sentences at the threshold."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            result, p, bag, start, end, low, off = _judge(batch, model)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            hot = np.flatnonzero(p >= threshold)
            points = np.concatenate(([0], np.cumsum((low & 0xC0) != 0x80))) if len(hot) else None
            for i in hot:
                base = points[off[bag[i]]]
                spans[bag[i]].append({"start": int(points[start[i]] - base), "end": int(points[end[i]] - base), "score": float(p[i])})
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "score": pa.array(result),
                    "n_sentences": pa.array(np.bincount(bag, minlength=batch.num_rows)),
                    "offending": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
                }
            )

    out = f"doc_id {kind}, score double, n_sentences bigint, offending array<struct<start:bigint,end:bigint,score:double>>"
    return docs.select("doc_id", "text").mapInArrow(run, out)
