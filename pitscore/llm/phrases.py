"""Phrase collocations: exact n-gram counts from an FM-index per shard, summed across shards.

Texts of one language are dealt into shards of bounded size in the tasks that read them. A shard's words are
numbered; words are counted across shards, and only those with ``min_count`` occurrences stay in the shard's
text of ids (all others end phrases, which no candidate can contain). Each shard keeps the Burrows-Wheeler transforms of
its text and of the reversed text. Phrases grow by one word a round, to the left in even rounds and to the
right in odd ones; a shard gives each extension whose two parts (without the last, without the first word) reached
``min_count`` over all shards, with its count. All phrases are dealt into parts by a hash, the same in every shard; a
part sums the counts of its phrases across shards, and what reaches ``min_count`` goes back to its shards and
grows on. Phrases travel as packed columns, one blob per shard and part, so the shuffle holds about ten bytes for each.

A phrase's counts of first and last parts travel along as two arrays. Left and right extensions tell whether a
longer candidate has nearly the same count: counts fall along extensions, so looking at one word more is exact.

Defined results: null and empty texts have no words; rows without ``lang`` count as ``und``; repeated rows
count each; the other columns are not looked at; an empty table gives no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscore.llm import fmindex
from pitscore.llm import words as w
from pitscore.llm.common import slices, staged

#: Text bytes of a shard, and of all open shards of a task together.
SHARD_BYTES, OPEN_BYTES = 8 << 20, 24 << 20

_BREAK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_GAP = _BREAK | np.isin(np.arange(256), [32, 9])


def pieces(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Lower-cased words of all texts, and for each whether it begins a piece."""
    low, starts, ends, doc = w.words(texts, _GAP)
    # Words are all that is not a gap, so the bytes between gaps are the words one behind the other.
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(low[~_GAP[low]].tobytes()))
    breaks = np.concatenate(([0], np.cumsum(_BREAK[low])))
    begins = np.ones(len(starts), bool)
    begins[1:] = (breaks[starts[1:]] > breaks[ends[:-1]]) | (doc[1:] != doc[:-1])
    return flat, begins


_SHARD = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("z", pa.binary()), ("no", pa.int32()), ("word", pa.string())])


def _rows(schema: pa.Schema, size: int, /, **given) -> pa.RecordBatch:
    """A batch of ``size`` rows: single values repeated, missing columns null."""
    cols = []
    for f in schema:
        x = given.get(f.name)
        cols.append(pa.nulls(size, f.type) if x is None else pa.array(x, f.type) if isinstance(x, (np.ndarray, list)) else x if isinstance(x, pa.Array) else pa.repeat(pa.scalar(x, f.type), size))
    return pa.record_batch(cols, schema=schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard with its coded text (``z``), and one per distinct word of it."""
    shut = zstandard.ZstdCompressor(level=1).compress
    number, open_ = TaskContext.get().partitionId() << 32, {}

    def close(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal number
        _, parts = open_.pop(lang)
        coded = pa.chunked_array([flat for flat, _ in parts]).combine_chunks().dictionary_encode()
        begins = np.concatenate([b for _, b in parts])
        no = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
        # A piece's first word is marked by its negative number.
        text = np.where(begins, -no, no).astype(np.int32)
        yield _rows(_SHARD, 1, shard=number, lang=lang, n=len(no), z=pa.array([shut(text.tobytes())], pa.binary()))
        n = np.bincount(no, minlength=len(coded.dictionary) + 1)[1:]
        every = np.arange(1, len(n) + 1)
        for a in range(0, len(n), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield _rows(_SHARD, len(n[part]), shard=number, lang=lang, n=n[part], no=every[part], word=coded.dictionary.slice(a, 1 << 16))
        number += 1

    for batch in slices(batches):
        for lang in pc.unique(batch.column("lang")).to_pylist():
            texts = batch.filter(pc.equal(batch.column("lang"), lang)).column("text")
            flat, begins = pieces(texts)
            if len(flat):
                size, parts = open_.get(lang, (0, []))
                open_[lang] = (size + texts.nbytes, [*parts, (flat, begins)])
                if size + texts.nbytes >= SHARD_BYTES:
                    yield from close(lang)
        while sum(size for size, _ in open_.values()) >= OPEN_BYTES:
            yield from close(max(open_, key=lambda x: open_[x][0]))
    for lang in list(open_):
        yield from close(lang)


_INDEX = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n_ids", pa.int64()), ("size", pa.int64()), ("ids", pa.binary()), ("forward", pa.binary()), ("reverse", pa.binary())])
#: Phrases of a shard for one part of all phrases: columns of ``_GROWN``, packed.
_DEALT = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("z", pa.binary())])
_GROWN = (("p", np.int64), ("s", np.int64), ("n", np.int32), ("low", np.int32), ("back", np.int32))
#: A frequent phrase (``id, p, s, f``), or the frequent phrases of a shard in one part: columns of ``_ALIVE``, packed.
_SUMMED = pa.schema([("shard", pa.int64()), ("z", pa.binary()), ("id", pa.int64()), ("p", pa.int64()), ("s", pa.int64()), ("f", pa.int64())])
_ALIVE = (("id", np.int64), ("n", np.int32), ("low", np.int32), ("back", np.int32))
#: Rows of a part at most, about: what a task sums at once.
PART_ROWS = 1 << 20


def _spark(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _open(z: bytes, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), kind)


def _pack(columns: dict[str, np.ndarray], kinds: tuple) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(columns[name].astype(kind).tobytes() for name, kind in kinds))


def _unpack(blobs: list[bytes], kinds: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The columns of all blobs, one behind the other, and how many rows each blob has."""
    width, parts, sizes = sum(np.dtype(kind).itemsize for _, kind in kinds), {name: [np.zeros(0, kind)] for name, kind in kinds}, []
    for z in blobs:
        raw = zstandard.ZstdDecompressor().decompress(z)
        n, at = len(raw) // width, 0
        sizes.append(n)
        for name, kind in kinds:
            parts[name].append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(x) for name, x in parts.items()}, np.array(sizes, np.int64)


def _build(_: tuple, shard: pa.Table, known: pa.Table) -> pa.Table:
    """Index of one shard over its frequent words."""
    if not shard.num_rows or not known.num_rows:
        return _INDEX.empty_table()
    text = _open(shard.column("z")[0].as_py())
    no = known.column("no").to_numpy()
    order = np.argsort(no)
    new = np.zeros(int(np.abs(text).max()) + 1, np.int32)
    new[no[order]] = np.arange(1, len(no) + 1)
    ids = new[np.abs(text)]
    # A 0 stands where a piece begins and for every run of other words; one ends the text.
    begins = text < 0
    place = np.arange(len(ids)) + np.cumsum(begins)
    wide = np.zeros(len(ids) + int(begins.sum()) + 1, np.int32)
    wide[place] = ids
    keep = np.ones(len(wide), bool)
    keep[1:] = (wide[1:] > 0) | (wide[:-1] > 0)
    wide = wide[keep]
    n_ids = len(no) + 1
    shut = zstandard.ZstdCompressor(level=1).compress
    sides = [pa.array([shut(fmindex.transform(x, n_ids).astype(np.int32).tobytes())], pa.binary()) for x in (wide, wide[::-1])]
    global_id = pa.array([shut(np.concatenate(([0], known.column("id").to_numpy()[order])).astype(np.int64).tobytes())], pa.binary())
    row = _rows(_INDEX, 1, shard=shard.column("shard")[0].as_py(), lang=shard.column("lang")[0].as_py(), n_ids=n_ids, size=len(wide), ids=global_id, forward=sides[0], reverse=sides[1])
    return pa.Table.from_batches([row])


def _dealt(shard: int, parts: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A shard's phrases, packed by part: a phrase is in the same part in every shard."""
    part = (w.mix(columns["p"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ columns["s"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order], prepend=-1))
    groups = np.split(order, cut[1:]) if len(cut) else []
    z = [_pack({name: columns[name][g] for name, _ in _GROWN}, _GROWN) for g in groups]
    return _rows(_DEALT, len(z), part=part[order[cut]], shard=shard, z=pa.array(z, pa.binary()))


def _pairs(parts: int):
    """Phrases of two words of each index: every word extended to the left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                direction = fmindex.Direction(_open(row["forward"]), row["n_ids"])
                low, count = fmindex.words(direction)
                e = direction.extend(low, count, low)
                ids = _open(row["ids"], np.int64)
                yield _dealt(row["shard"], parts, {"p": ids[e.id], "s": ids[e.of + 1], "n": e.count, "low": e.low, "back": e.other})

    return run


def _summed(min_count: int):
    """Counts of the phrases of one part over all shards; those that reach ``min_count`` get ids and live on in their shards."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        columns, sizes = _unpack(table.column("z").to_pylist(), _GROWN)
        order = np.lexsort((columns["s"], columns["p"]))
        p, s = columns["p"][order], columns["s"][order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(p)), bool), (p[1:] != p[:-1]) | (s[1:] != s[:-1]))))
        f = np.add.reduceat(columns["n"][order].astype(np.int64), first) if len(first) else first
        often = f >= min_count
        ids = (key[0].as_py() << 32) + np.arange(int(often.sum()))
        out = [_rows(_SUMMED, len(ids), id=ids, p=p[first[often]], s=s[first[often]], f=f[often])]
        of_group = np.full(len(first), -1, np.int64)
        of_group[often] = ids
        own = np.empty(len(p), np.int64)
        own[order] = np.repeat(of_group, np.diff(np.append(first, len(p))))
        ends, blobs, shards = np.cumsum(sizes), [], []
        for shard, start, end in zip(table.column("shard").to_pylist(), ends - sizes, ends):
            live = np.flatnonzero(own[start:end] >= 0) + start
            if len(live):
                shards.append(shard)
                blobs.append(_pack({"id": own[live], **{c: columns[c][live] for c in ("n", "low", "back")}}, _ALIVE))
        out.append(_rows(_SUMMED, len(blobs), shard=np.array(shards, np.int64), z=pa.array(blobs, pa.binary())))
        return pa.Table.from_batches(out, schema=_SUMMED)

    return run


def _extended(left: bool, parts: int):
    """Extensions by one word of a shard's living phrases whose other part lives too."""

    def run(_: tuple, index: pa.Table, alive: pa.Table) -> pa.Table:
        if not index.num_rows or not alive.num_rows:
            return _DEALT.empty_table()
        columns, _ = _unpack(alive.column("z").to_pylist(), _ALIVE)
        low, back, n, ids = (columns[c].astype(np.int64) for c in ("low", "back", "n", "id"))
        here, there = (low, back) if left else (back, low)
        order = np.argsort(here)
        here, there, n, ids = here[order], there[order], n[order], ids[order]
        direction = fmindex.Direction(_open(index.column("forward" if left else "reverse")[0].as_py()), index.column("n_ids")[0].as_py())
        e = direction.extend(here, n, there)
        # The other part has the new interval inside its own; phrases of one length are disjoint and sorted.
        at = np.maximum(here.searchsorted(e.low, "right") - 1, 0)
        lives = (e.low >= here[at]) & (e.low < here[at] + n[at])
        grown, part = ids[e.of[lives]], ids[at[lives]]
        place, other = e.low[lives], e.other[lives]
        found = {"p": part if left else grown, "s": grown if left else part, "n": e.count[lives], "low": place if left else other, "back": other if left else place}
        return pa.Table.from_batches([_dealt(index.column("shard")[0].as_py(), parts, found)], schema=_DEALT)

    return run


def _next_to(c: Column, more: Column) -> Column:
    return F.concat(c, F.array(more))


def phrase_counts(docs: DataFrame, min_count: int = 100) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, words`` (all word occurrences), and a table of the phrases of each length from 1 to ``DEPTH``.

    A table has ``id, lang, phrase, last, f, firsts, lasts, p, s``: ``firsts`` and ``lasts`` are the counts of the first and
    last 1, 2, ... words, ``p`` and ``s`` the ids of the phrase without its last and without its first word.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    rows = staged(texts.mapInArrow(_shards, _spark(_SHARD)))
    total = rows.filter("z is not null").groupBy("lang").agg(F.sum("n").alias("words"))
    # A word has one row in a shard at most; the number of its first row is its id in all of them.
    same = W.partitionBy("word", "lang")
    found = rows.filter("no is not null").select("shard", "no", "lang", "word", "n", F.monotonically_increasing_id().alias("_at"))
    counted = found.withColumns({"f": F.sum("n").over(same), "id": F.min("_at").over(same)})
    often = staged(counted.filter(F.col("f") >= min_count).select("shard", "no", "id", "lang", "word", "f", (F.col("id") == F.col("_at")).alias("first")))
    counts = F.array("f")
    none = F.lit(None).cast("long")
    words = often.filter("first").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", counts.alias("firsts"), counts.alias("lasts"), none.alias("p"), none.alias("s"))
    known = often.select(F.col("shard").alias("of"), "no", "id")
    coded = rows.filter("z is not null").select("shard", "lang", "z")
    index = staged(coded.groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(_build, _spark(_INDEX)))
    parts = max(1, -(-(index.agg(F.sum("size")).first()[0] or 0) // PART_ROWS))
    grown, levels = index.select("shard", "n_ids", "ids", "forward").mapInArrow(_pairs(parts), _spark(_DEALT)), [words]
    for length in range(2, fmindex.DEPTH + 1):
        before = levels[-1]
        summed = staged(grown.groupBy("part").applyInArrow(_summed(min_count), _spark(_SUMMED)))
        part = before.select(F.col("id").alias("p"), "lang", "phrase", "firsts").hint("shuffle_hash")
        rest = before.select(F.col("id").alias("s"), "last", "lasts").hint("shuffle_hash")
        named = summed.filter("id is not null").select("id", "p", "s", "f").join(part, "p").join(rest, "s")
        levels.append(staged(named.select(
            "id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f",
            _next_to(F.col("firsts"), F.col("f")).alias("firsts"), _next_to(F.col("lasts"), F.col("f")).alias("lasts"), "p", "s",
        )))
        if length < fmindex.DEPTH:
            side = "forward" if length % 2 else "reverse"
            alive = summed.filter("z is not null").select(F.col("shard").alias("of"), "z")
            grown = index.select("shard", "n_ids", side).groupBy("shard").cogroup(alive.groupBy("of")).applyInArrow(_extended(side == "forward", parts), _spark(_DEALT))
    return total, levels


def collocations(docs: DataFrame, min_count: int = 100, keep_percent: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score, cut, left_most, right_most``.

    ``left_most`` and ``right_most`` are the greatest counts of a candidate with one word more on that side.
    """
    total, levels = phrase_counts(docs, min_count)
    every = None
    for i, level in enumerate(levels[1:], 1):
        rows = level.select("id", "lang", "phrase", F.col("f").alias("a"), "firsts", "lasts")
        if i + 1 < len(levels):
            right = levels[i + 1].groupBy(F.col("p").alias("id")).agg(F.max("f").alias("right_most"))
            left = levels[i + 1].groupBy(F.col("s").alias("id")).agg(F.max("f").alias("left_most"))
            rows = rows.join(right, "id", "left").join(left, "id", "left")
        else:
            rows = rows.withColumns({"right_most": F.lit(None).cast("long"), "left_most": F.lit(None).cast("long")})
        every = rows if every is None else every.unionByName(rows)
    longer = F.coalesce(F.greatest("left_most", "right_most"), F.lit(0))
    rows = every.filter(100 * longer < keep_percent * F.col("a")).join(total.withColumnRenamed("words", "n"), "lang")
    size = F.size("firsts")
    wide = lambda c: c.cast("decimal(19,0)")

    def cut(k: Column) -> Column:
        l, r = F.get("firsts", k - 1), F.get("lasts", size - k - 1)
        return F.struct(k.alias("cut"), l.alias("l"), r.alias("r"), (wide(l) * wide(r)).alias("lr"))

    # The lowest score has the largest l * r; floors may tie, so each cut's own score decides, then the smallest cut.
    cuts = F.transform(F.sequence(F.lit(1), size - 1), cut)
    rows = rows.withColumn("cuts", cuts).withColumn("mass", wide(F.col("a")) * wide(F.col("n")) * 1000)
    rows = rows.withColumn("best", F.expr("array_min(transform(cuts, x -> struct(mass div x.lr as score, x.cut, x.l, x.r)))"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = rows.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", "best.cut", "left_most", "right_most")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut", "left_most", "right_most")


def oracle() -> str:
    """Reference SQL of the registered query: all n-grams of all pieces, counted by text."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cuts = " UNION ALL ".join(
        f"SELECT c.lang, c.words, c.a, {k} AS k, c.words[1:{k}] AS head, c.words[{k} + 1:] AS tail FROM candidates c WHERE len(c.words) > {k}" for k in range(1, 5)
    )
    inside = " UNION ALL ".join(
        f"SELECT lang, words[{i}:{i} + {n} - 1] AS words, a FROM candidates WHERE len(words) > {n} AND len(words) >= {i} + {n} - 1" for n in range(2, 5) for i in range(1, 5)
    )
    return f"""
    WITH parts AS (
      SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{small}'), '[.,;:!?\\x0A-\\x0D]')) AS part
      FROM documents
    ), listed AS (
      SELECT lang, regexp_extract_all(part, '[^\\x20\\x09]+') AS ws FROM parts
    ), grams AS (
      SELECT lang, ws[i:i + k - 1] AS words, k FROM (
        SELECT lang, ws, i, unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS k
        FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM listed)
      )
    ), counted AS (
      SELECT lang, words, count(*) AS f FROM grams GROUP BY lang, words HAVING count(*) >= 100
    ), totals AS (
      SELECT lang, sum(len(ws)) AS n FROM listed GROUP BY lang
    ), candidates AS (
      SELECT lang, words, f AS a FROM counted WHERE len(words) >= 2
    ), longest AS (
      SELECT lang, words, max(a) AS a FROM ({inside}) GROUP BY lang, words
    ), cuts AS ({cuts}
    ), scored AS (
      SELECT c.lang, c.words, c.a, c.k, h.f AS l, t.f AS r, CAST(n.n AS BIGINT) AS n,
        CAST((CAST(1000 AS HUGEINT) * c.a * CAST(n.n AS HUGEINT)) // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
      FROM cuts c JOIN counted h ON h.lang = c.lang AND h.words = c.head
        JOIN counted t ON t.lang = c.lang AND t.words = c.tail JOIN totals n ON n.lang = c.lang
        LEFT JOIN longest g ON g.lang = c.lang AND g.words = c.words
      WHERE g.a IS NULL OR 100 * g.a < 100 * c.a
    ), lowest AS (
      SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank,
      array_to_string(words, ' ') AS phrase, a, l, r, n, score
    FROM lowest QUALIFY rank <= 2000"""
