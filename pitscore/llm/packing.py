"""Hierarchical packing of documents into windows of several context sizes.

The task that reads a partition also tokenises and packs it, so no token is shuffled. Documents above the
longest window give whole windows; what is left of them, and all other documents, are routed to the
smallest tier that holds them. Tiers are packed from long to short: the longest piece opens a window, its
gap takes the longest pieces that fit, which come from shorter tiers, and one cut closes the last gap, so
a window is exactly full. What remains of a partition is cut into powers of two; one sequence is padded.
Step groups join windows of one tier with an equal number of tokens.

Tokens: each white-space chunk is tokenised once per worker process and remembered within a bound, over tasks too. The vocabulary's
pretokens never contain or cross white space, so ids of chunks joined are the ids of the text.

Defined results: a null or empty text is its end id alone; rows without ``doc_id`` and repeated rows are
packed like others; other columns are not looked at; an empty table gives no sequence.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pitscore.llm.common import slices
from pitscore.llm.subwords import remembered

TIERS = (256, 512, 1024, 2048)
#: Token budget of a step group; documents packed together; both bound what a task holds.
STEP_TOKENS, POOL_DOCS = 65_536, 20_000
END = 1
VOCABULARY = "word_bpe_49k.json"


class Packer:
    """Packs ``(document, start, length)`` pieces; ``emit(pieces, tier)`` takes a finished sequence."""

    def __init__(self, tiers: tuple[int, ...], emit: Callable[[list[tuple[int, int, int]], int], None]):
        self.tiers, self.emit = tiers, emit
        self.pool: list[tuple[int, int, int]] = []

    def add(self, doc: int, length: int) -> None:
        top, start = self.tiers[-1], 0
        while length - start >= top:
            self.emit([(doc, start, top)], top)
            start += top
        if length > start:
            bisect.insort(self.pool, (length - start, doc, start))

    def _take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most ``most`` tokens."""
        k = bisect.bisect_right(self.pool, (most, 1 << 62, 0))
        return self.pool.pop(k - 1) if k else None

    def _fill(self, first: tuple[int, int, int], size: int) -> bool:
        """One window of ``size`` tokens; false if the pool cannot fill it, which leaves all as it was."""
        if first[0] + sum(p[0] for p in self.pool[: 2 * size]) < size:
            return False
        pieces, gap = [first], size - first[0]
        while gap and (piece := self._take(gap)):
            pieces.append(piece)
            gap -= piece[0]
        if gap:  # the shortest piece left is longer than the gap: cut it
            length, doc, start = self.pool.pop(0)
            pieces.append((gap, doc, start))
            bisect.insort(self.pool, (length - gap, doc, start + gap))
        self.emit([(doc, start, n) for n, doc, start in pieces], size)
        return True

    def pack(self, last: bool) -> None:
        """Fill windows, long tiers first; at the end also the remainder."""
        for size, below in zip(reversed(self.tiers), [*reversed(self.tiers[:-1]), 0]):
            while first := self._take(size):
                if first[0] <= below or not self._fill(first, size):
                    bisect.insort(self.pool, first)
                    break
        if not last:
            return
        left = sum(p[0] for p in self.pool)
        size = self.tiers[-1]
        while left:
            while size > left and size > self.tiers[0]:
                size //= 2
            pieces, room = [], min(size, left)
            left -= room
            while room:
                length, doc, start = self.pool.pop()
                pieces.append((doc, start, min(length, room)))
                if length > room:
                    self.pool.append((length - room, doc, start + room))
                room -= pieces[-1][2]
            self.emit(pieces, size if sum(p[2] for p in pieces) == size else self.tiers[-1])


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, tier, step, ids, ids_crc32``.

    ``ids`` (unsigned 16-bit, little-endian, as binary) is left empty without ``with_ids``. Sequence and
    step numbers are unique; their high bits are the partition's number.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, base = remembered(path), TaskContext.get().partitionId() << 40
        docs_in: dict[int, tuple] = {}
        out: list[tuple] = []
        count = {"sequence": 0, "step": 0, "doc": 0}
        steps: dict[int, list[int]] = {}

        def emit(pieces: list[tuple[int, int, int]], tier: int) -> None:
            step = steps.setdefault(tier, [0, 0])
            if step[1] % max(1, STEP_TOKENS // tier) == 0:
                step[0], count["step"] = count["step"], count["step"] + 1
            step[1] += 1
            offset = 0
            for doc, start, length in pieces:
                doc_id, ids = docs_in[doc]
                part = ids[start : start + length]
                out.append((doc_id, start, length, len(ids), base + count["sequence"], offset, tier, base + step[0], part.astype("<u2").tobytes() if with_ids else None, zlib.crc32(part.astype("<u4").tobytes())))
                offset += length
            count["sequence"] += 1

        names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step", "ids", "ids_crc32")
        kinds: list[pa.DataType] = []

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * len(names)
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            out.clear()
            return batch

        packer = Packer(tiers, emit)
        for batch in slices(batches):
            kinds[:] = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
            ids, bounds = tokens.encode(batch.column("text"), end=END)
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                docs_in[count["doc"]] = (doc_id, ids[bounds[i] : bounds[i + 1]].copy())
                packer.add(count["doc"], int(bounds[i + 1] - bounds[i]))
                count["doc"] += 1
            if len(packer.pool) > POOL_DOCS:
                packer.pack(last=False)
                alive = {doc for _, doc, _ in packer.pool}
                for doc in [d for d in docs_in if d not in alive]:
                    del docs_in[doc]
            yield rows()
        packer.pack(last=True)
        if out:
            yield rows()

    schema = f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step bigint, ids binary, ids_crc32 bigint"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, tier, step, n_tokens, ids`` from pieces with ids."""
    from pyspark.sql import functions as F

    listed = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = pieces.groupBy("sequence_id", "tier", "step").agg(listed.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["ids"]))
    return grouped.select("sequence_id", "tier", "step", F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("n_tokens"), joined.alias("ids"))
