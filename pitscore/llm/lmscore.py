"""Language-model scores: a causal self-attention model on subword ids, beside a smoothed word model.

The corpus is cut into blocks of texts. A block gives its distinct words with their training counts; the sum
over blocks is the lexicon, where each distinct word is tokenised once. Blocks then meet the lexicon rows of
their own words, so no task holds the whole lexicon; a word's ids and count are read from there, and the ids of
all texts are written. Lexicon rows travel packed by block. Counts of ids come from the whole lexicon. Counts of
neighbouring ids, inside words, from a word to the next one and at both ends of a text, come from the ids of all
training texts, with each id as its input row. The attention starts from a bounded sample; then every task makes a
training pass over all its training texts, and the model has the mean of the weights of all steps.

Defined results: a null or empty text is its end token alone; rows without ``doc_id`` are scored and, having no
remainder, learnt from; repeated rows count each; an empty table gives an empty result; other columns are
not looked at. Without any training row the word model has no counts and the attention model trains on none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore.llm import attention
from pitscore.llm import words as w
from pitscore.llm.common import slices, staged
from pitscore.llm.subwords import Subwords
from pitscore.llm.toxicity import held_out

#: Text bytes of a block; ids that a worker handles at once; documents and code points of the sample that the attention model starts from.
BLOCK_BYTES = 24 << 20
SLICE_IDS = 1 << 20
#: Lexicon rows that a worker packs at once.
PACKED_ROWS = 1 << 18
SAMPLE_DOCS, SAMPLE_CHARS = 10_000, 12_000_000
#: Parts that the weights of all passes are summed in.
WEIGHT_PARTS = 64
#: Text bytes whose words are looked up at once: each lookup hashes all words of the block.
LOOKUP_BYTES = 4 << 20
VOCABULARY, IDS = "word_bpe_49k.json", 49_408
PACKED = ("of", "word", "word_sizes", "c", "ids", "ids_sizes")

_PLAIN = w.LOWER.copy()
_PLAIN[9:14] = 32


def split_words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Lower-cased words of all texts, and the n+1 bounds of the texts in them."""
    raw, off = w.text_bytes(texts)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(_PLAIN[raw].tobytes()))
    split = pc.split_pattern(plain, " ")
    flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(flat, "")
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return flat.filter(real), before[offsets - offsets[0]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts (``z``) and of distinct words (``word, n``) of each block."""
    shut = zstandard.ZstdCompressor(level=1).compress
    base, number, size, tables = TaskContext.get().partitionId() << 32, 0, 0, []

    def words_of(block: int) -> Iterator[pa.RecordBatch]:
        if tables:
            t = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
            for b in t.select(["word", "n_sum"]).to_batches(1 << 16):
                yield row(block, word=b.column(0), n=b.column(1))

    def row(block: int, **given: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(given.values())))
        return pa.record_batch([pa.array([block] * n, pa.int64()), *(given.get(f.name, pa.nulls(n, f.type)) for f in list(kinds)[1:])], schema=kinds)

    kinds = pa.schema([])
    for batch in slices(batches):
        kinds = pa.schema([("block", pa.int64()), ("doc_id", batch.schema.field("doc_id").type), ("held_out", pa.bool_()), ("z", pa.binary()), ("word", pa.string()), ("n", pa.int64())])
        texts = batch.column("text")
        flat, bounds = split_words(texts)
        learnt = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), np.repeat(learnt, np.diff(bounds)), len(coded.dictionary))
        tables.append(pa.table({"word": coded.dictionary, "n": pa.array(n.astype(np.int64))}))
        yield row(base + number, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), z=pa.array([shut(t.encode()) for t in texts.to_pylist()], pa.binary()))
        size += texts.nbytes
        if size >= BLOCK_BYTES:
            yield from words_of(base + number)
            number, size, tables = number + 1, 0, []
    yield from words_of(base + number)


def _tokenised(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Subwords(path)
        for batch in batches:
            flat, sizes = tokens.encoded(batch.column("word"))
            ends = np.concatenate(([0], 2 * np.cumsum(sizes))).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.record_batch({"word": batch.column("word"), "c": batch.column("c"), "ids": ids})

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lexicon rows (``of, word, c, ids``) as few rows for each block: words, counts and ids joined, sizes beside them."""
    shut = zstandard.ZstdCompressor(level=1).compress
    kept: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        t = pa.Table.from_batches(kept).sort_by("of").combine_chunks()
        of = t.column("of").to_numpy()
        bounds = np.append(np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))), len(of))
        spans = list(zip(bounds, bounds[1:]))
        columns = {"of": pa.array(of[bounds[:-1]]), "c": pa.array([shut(t.column("c").to_numpy()[a:b].tobytes()) for a, b in spans], pa.binary())}
        for name in ("word", "ids"):
            raw, off = w.text_bytes(t.column(name).chunk(0))
            columns[name] = pa.array([shut(raw[off[a] : off[b]].tobytes()) for a, b in spans], pa.binary())
            columns[f"{name}_sizes"] = pa.array([shut(np.diff(off[a : b + 1]).astype(np.int32).tobytes()) for a, b in spans], pa.binary())
        return pa.record_batch([columns[x] for x in PACKED], PACKED)

    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
        if sum(b.num_rows for b in kept) >= PACKED_ROWS:
            yield out()
            kept = []
    if kept:
        yield out()


def _unpacked(rows: pa.Table) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block, their counts, all their ids and the n+1 bounds of the words in these."""
    opened = zstandard.ZstdDecompressor().decompress
    whole = {x: b"".join(opened(z) for z in rows.column(x).to_pylist()) for x in PACKED[1:]}
    ends = lambda x: np.concatenate(([0], np.cumsum(np.frombuffer(whole[x], np.int32), dtype=np.int64)))
    off = ends("word_sizes")
    words = pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(whole["word"]))
    return words, np.frombuffer(whole["c"], np.int64).astype(np.float64), np.frombuffer(whole["ids"], np.uint16), ends("ids_sizes") // 2


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(IDS, np.int64)
    for batch in batches:
        ids = [np.frombuffer(x, np.uint16) for x in batch.column("ids").to_pylist()]
        c = np.repeat(batch.column("c").to_numpy(), [len(x) for x in ids])
        np.add.at(n, np.concatenate([*ids, np.zeros(0, np.uint16)]).astype(np.int64), c)
    live = np.flatnonzero(n)
    yield pa.record_batch({"id": pa.array(live), "n": pa.array(n[live])})


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of coded texts of about ``SLICE_IDS`` ids, with their ids and the n+1 bounds of the texts in them."""
    opened = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        total = np.concatenate(([0], np.cumsum(batch.column("n_subwords").to_numpy())))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(total.searchsorted(total[at] + SLICE_IDS, "right")) - 1)
            part = batch.slice(at, end - at)
            yield part, np.frombuffer(b"".join(opened(z) for z in part.column("z").to_pylist()), np.uint16), total[at : end + 1] - total[at]
            at = end


def neighbours(coded: DataFrame, place: np.ndarray) -> np.ndarray:
    """Previous input row, input row and count of all neighbouring ids of the training texts."""
    shared = coded.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(attention.ROWS**2, np.int64)
        for _, ids, bounds in _opened(batches):
            n += np.bincount(attention.neighbours(shared.value, ids, bounds), minlength=len(n))
        live = np.flatnonzero(n)
        yield pa.record_batch({"pair": pa.array(live.astype(np.int32)), "n": pa.array(n[live])})

    # At most ROWS**2 groups in any corpus.
    found = coded.filter(~F.col("held_out")).select("n_subwords", "z").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair = found.column("pair").to_numpy().astype(np.int64)
    return np.stack([pair // attention.ROWS, pair % attention.ROWS, found.column("n").to_numpy()], axis=1)


def learn(coded: DataFrame, start: attention.Model) -> attention.Model:
    """Attention from all training texts: the mean weights of a pass of every task over its texts, each from ``start``."""
    shared = coded.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = attention.passed(shared.value, ((ids, bounds) for _, ids, bounds in _opened(batches)))
        if n:
            parts, task = np.array_split(total, WEIGHT_PARTS), TaskContext.get().partitionId()
            yield pa.record_batch({"part": pa.array(range(WEIGHT_PARTS), pa.int32()), "task": pa.array([task] * WEIGHT_PARTS, pa.int64()), "n": pa.array([n] * WEIGHT_PARTS, pa.int64()), "total": pa.array([x.tobytes() for x in parts], pa.binary())})

    def summed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")
        total = np.sum([np.frombuffer(x) for x in rows.column("total").to_pylist()], axis=0)
        return pa.table({"part": rows.column("part")[:1], "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

    passes = coded.filter(~F.col("held_out")).select("n_subwords", "z").mapInArrow(run, "part int, task bigint, n bigint, total binary")
    found = passes.groupBy("part").applyInArrow(summed, "part int, n bigint, total binary").toArrow().sort_by("part")
    if not found.num_rows:
        return start
    return attention.learnt(start, np.concatenate([np.frombuffer(x) for x in found.column("total").to_pylist()]), found.column("n")[0].as_py())


def fit(docs: DataFrame, lexicon: DataFrame, coded: DataFrame, path: str, n_docs: int) -> attention.Model:
    """Counts and attention from all training texts; at most ``SAMPLE_DOCS`` documents and ``SAMPLE_CHARS`` code points give its start."""
    counts = np.zeros(IDS)
    for r in lexicon.filter("c > 0").select("c", "ids").mapInArrow(_counts, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    counts[attention.END] += n_docs
    pairs = neighbours(coded, attention.places(counts))
    order = F.xxhash64("doc_id", F.lit(6))
    sized = docs.filter(~F.col("held_out")).select("doc_id", F.length("text").alias("n"), order.alias("h")).orderBy("h", "doc_id").limit(SAMPLE_DOCS).collect()
    total, kept = 0, []
    for r in sized:
        total += r.n or 0
        if total > SAMPLE_CHARS and kept:
            break
        kept.append(r.doc_id)
    texts = [r.text or "" for r in docs.filter(F.col("doc_id").isin(kept)).select("text").collect()] if kept else []
    flat, bounds = split_words(pa.array(texts, pa.string()))
    ids, bounds = Subwords(path).join(flat, bounds, attention.END)
    return learn(coded, attention.train(counts, pairs, ids, bounds))


def score(docs: DataFrame, fold: int = 1, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords`` (log10 probabilities)."""
    path, kind = vocabulary or public_tokenizers.path(VOCABULARY), docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", held_out(fold).alias("held_out"))
    rows = staged(docs.mapInArrow(_blocks, f"block bigint, doc_id {kind}, held_out boolean, z binary, word string, n bigint"))
    texts, words = rows.filter("z is not null").select("block", "doc_id", "held_out", "z"), rows.filter("word is not null")
    n_docs = texts.filter("not held_out").count()
    counted = words.groupBy("word").agg(F.sum("n").alias("c"))
    lexicon = staged(counted.mapInArrow(_tokenised(path), "word string, c bigint, ids binary"))
    total = lexicon.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    n, v = (total[0] or 0) + n_docs, total[1] + (n_docs > 0)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known_words, c, flat_ids, id_bounds = _unpacked(right)
        log = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        out = []
        # Rows come in any order; the training pass goes by theirs.
        left = left.sort_by("doc_id")
        opened = zstandard.ZstdDecompressor().decompress
        for a in range(0, left.num_rows, 2048):
            part = left.slice(a, 2048)
            text = pa.array([opened(z).decode() for z in part.column("z").to_pylist()], pa.string())
            plain = pa.record_batch({"doc_id": part.column("doc_id").combine_chunks(), "held_out": part.column("held_out").combine_chunks(), "text": text})
            for b in slices(iter([plain]), limit=LOOKUP_BYTES):
                out.append(_coded(b, known_words, c, log, flat_ids, id_bounds))
        return pa.Table.from_batches(out) if out else pa.table({f.name: pa.array([], f.type) for f in result(left.schema.field("doc_id").type)})

    def result(doc_id: pa.DataType) -> pa.Schema:
        return pa.schema([("doc_id", doc_id), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("n_subwords", pa.int64()), ("z", pa.binary())])

    def _coded(batch: pa.RecordBatch, known_words, c, log, flat_ids, id_bounds) -> pa.RecordBatch:
        flat, bounds = split_words(batch.column("text"))
        at = pc.index_in(flat, value_set=known_words).to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
        sums = np.concatenate(([0.0], np.cumsum(log[at])))
        seen = np.concatenate(([0], np.cumsum(c[at] > 0)))
        end = np.log10((n_docs + 0.5) / (n + 0.5 * (v + 1)))
        size = id_bounds[at + 1] - id_bounds[at]
        cum = np.concatenate(([0], np.cumsum(size)))
        source = np.repeat(id_bounds[at] - cum[:-1], size) + np.arange(cum[-1])
        places = cum[bounds] + np.arange(len(bounds))
        ids = np.full(places[-1], attention.END, np.uint16)
        text = np.repeat(np.arange(batch.num_rows), np.diff(cum[bounds]))
        ids[np.arange(cum[-1]) + text] = flat_ids[source]
        shut = zstandard.ZstdCompressor(level=1).compress
        return pa.record_batch(
            [
                batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(bounds) + 1), pa.array(np.diff(seen[bounds]) + (n_docs > 0)), pa.array(np.diff(sums[bounds]) + end),
                pa.array(np.diff(places)), pa.array([shut(ids[a:b].tobytes()) for a, b in zip(places, places[1:])], pa.binary()),
            ],
            schema=result(batch.schema.field("doc_id").type),
        )

    looked = words.select(F.col("block").alias("of"), "word").join(lexicon, "word").select("of", "word", "c", "ids")
    looked = looked.mapInArrow(_packed, ", ".join(["of bigint", *(f"{x} binary" for x in PACKED[1:])]))
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, n_subwords bigint, z binary"
    coded = staged(texts.groupBy("block").cogroup(looked.groupBy("of")).applyInArrow(run, schema))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, lexicon, coded, path, n_docs))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_subwords")
        for part, ids, bounds in _opened(batches):
            logs = np.concatenate(([0.0], np.cumsum(attention.log_probabilities(model.value, ids, bounds)))) / np.log(10)
            new = {"train_tokens": pa.array(np.full(part.num_rows, n)), "score": pa.array(np.diff(logs[bounds]))}
            yield pa.record_batch([new[c] if c in new else part.column(c) for c in names], names)

    return coded.mapInArrow(scored, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_subwords bigint")
