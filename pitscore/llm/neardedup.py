"""MinHash near-duplicates by an LSH forest.

A document is its set of distinct word 5-grams. Documents with equal sets form a class and go on as one.
``TREES`` signature orders sort the classes by a label of ``BASE + DEEP`` MinHash values. Classes that agree
on the first ``BASE`` values of an order are a region; inside it the neighbours in sorted order, which have
the longest common prefixes, are candidates. A pair at similarity 0.85 misses all orders with a chance below
1e-4; at 0.9 below 1e-6. Candidates whose signatures are within five deviations of the threshold are
confirmed on the full sets.

Candidates are checked in two steps: each class with its nearest neighbours first, then the other
neighbours, where both ends are still in different components. A group of near copies so needs few checks.

The depth adapts to the region: one larger than the neighbour window is cut by its next MinHash values, one
more at a time, until its parts fit; only parts that agree on all ``BASE + DEEP`` values and still do not fit are
dealt into chunks. Parts give nearest neighbours; what these cannot settle is compared in blocks. Large regions that share members are a family. Members outside the family's
largest component are the open ones; every open member is compared with every member of the family, in tasks of
two blocks of ``BLOCK`` members, by one matrix product over the shingles that both blocks have. A task
returns at most one row for each of its members, so no list of pairs exists anywhere and nothing is capped.

Defined results: null, empty and word-less texts have an empty set and are linked with nothing; texts below
five words have one shingle; rows without ``doc_id`` stay alone, are kept and have ``n_shingles`` 0; repeated rows share one
result (of different texts under one id the class with the smallest id counts); other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscore.llm import words as w
from pitscore.llm.common import slices, staged
from pitscore.llm.components import components

SHINGLE, TREES, BASE, DEEP = 5, 16, 5, 3
#: Neighbours taken in sorted order, and members of a block of a large family.
NEIGHBOURS, BLOCK = 12, 1024
#: Five deviations of a signature's estimate.
SLACK = 0.16
#: Bits of the filter that keeps texts without candidates out of the second reading.
FILTER_BITS = 1 << 23
_BITS = np.uint64(12)
_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, (2, TREES * (BASE + DEEP)), dtype=np.uint64) | np.uint64(1)


def _shingle_sets(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, starts, ends, doc = w.words(texts, w.SPACE)
    d, h = w.shingles(w.span_hashes(low, starts, ends), doc, len(texts), SHINGLE)
    return h, d.searchsorted(np.arange(len(texts))), d.searchsorted(np.arange(len(texts)), "right")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = BASE + DEEP
    for batch in slices(batches):
        h, lo, hi = _shingle_sets(batch.column("text"))
        full = np.flatnonzero(hi > lo)
        sig = np.zeros((len(full), TREES * k), np.uint16)
        tmp = np.empty_like(h)
        for i in range(TREES * k if len(full) else 0):
            np.multiply(h, _SEEDS[0, i], out=tmp)
            np.bitwise_xor(tmp, tmp >> np.uint64(29), out=tmp)
            np.multiply(tmp, _SEEDS[1, i], out=tmp)
            sig[:, i] = w.mix(np.minimum.reduceat(tmp, lo[full])) & np.uint64((1 << int(_BITS)) - 1)
        levels = sig.reshape(len(full), TREES, k).astype(np.uint64)
        region, deep = np.zeros((2, len(full), TREES), np.uint64)
        for j in range(k):
            if j < BASE:
                region = (region << _BITS) | levels[:, :, j]
            else:
                deep = (deep << _BITS) | levels[:, :, j]
        ids = batch.column("doc_id").take(pa.array(full))
        tag = [np.add.reduceat(w.mix(h ^ np.uint64(s)), lo[full]).view(np.int64) if len(full) else np.zeros(0, np.int64) for s in (1, 2)]
        lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * TREES, pa.int32()), pa.array(a.astype(np.int64).ravel()))
        yield pa.record_batch(
            {
                "doc_id": ids, "n": pa.array((hi - lo)[full]), "s1": pa.array(tag[0]), "s2": pa.array(tag[1]),
                "regions": lists(region), "deeps": lists(deep), "sig": pa.array([s.tobytes() for s in sig], pa.binary()),
            }
        )


def _sets_of(wanted: np.ndarray):
    """Shingle sets of the texts whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(wanted.view(np.uint8), bitorder="little")
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column("bit").to_numpy()] > 0))
            for part in slices(iter([batch])):
                h, lo, hi = _shingle_sets(part.column("text"))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "shingles": pa.array([h[a:b].tobytes() for a, b in zip(lo, hi)], pa.binary())})

    return run


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
        own = {c: batch.column(c) for c in ("a", "b", "na", "nb")}
        yield pa.record_batch({**own, "est": pa.array((a == b).mean(axis=1) if batch.num_rows else np.zeros(0))})


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common = []
        for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.minimum(y.searchsorted(x), len(y) - 1)
            common.append(int((y[at] == x).sum()))
        yield pa.record_batch({**{c: batch.column(c) for c in ("a", "b", "na", "nb")}, "common": pa.array(common, pa.int64())})


def _compared(percent: int):
    """Links between the open members of one block and all members of another, as ``a, b`` of one component."""

    def run(_: tuple, table: pa.Table) -> pa.Table:
        cls = table.column("cls").combine_chunks()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        open_ = table.column("open").to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(open_), np.arange(len(sets))
        size = np.array([len(x) for x in sets])
        row = np.repeat(right, size)
        values, at, seen = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(seen > 1)
        common = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        for i in range(0, len(shared), 4096):
            part = shared[i : i + 4096]
            a, b = at.searchsorted([part[0], part[-1] + 1])
            place = np.minimum(part.searchsorted(at[a:b]), len(part) - 1)
            hit = part[place] == at[a:b]
            inside = np.zeros((len(right), len(part)), np.float32)
            inside[row[a:b][hit], place[hit]] = 1
            common += inside[left] @ inside.T
        linked = 100 * common >= percent * (size[left][:, None] + size[None, :] - common)
        label = right.astype(np.int64)
        while True:
            low = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
            new = label.copy()
            np.minimum.at(new, left, low)
            back = np.where(linked, new[left][:, None], len(label)).min(0, initial=len(label))
            new = np.minimum(new, back)
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != right)
        return pa.table({"a": cls.take(pa.array(label[moved])), "b": cls.take(pa.array(moved))})

    return run


class _Forest:
    """Classes with their labels, and the exact check of candidate pairs."""

    def __init__(self, docs: DataFrame, percent: int):
        self.percent, self.kind = percent, docs.schema["doc_id"].dataType.simpleString()
        of = "n bigint, s1 bigint, s2 bigint, regions array<bigint>, deeps array<bigint>, sig binary"
        texts = docs.filter("doc_id is not null").select("doc_id", "text")
        rows = staged(texts.mapInArrow(_signatures, f"doc_id {self.kind}, {of}"))
        narrow = rows.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("cls"))
        named = rows.select("doc_id", "s1", "s2", "n").join(narrow, ["s1", "s2", "n"])
        self.member = staged(named.groupBy("doc_id").agg(F.min(F.struct("cls", "n")).alias("m")).select("doc_id", "m.cls", "m.n"))
        heads = self.member.filter("doc_id = cls").select("doc_id")
        classes = rows.join(heads, "doc_id", "left_semi").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "cls")
        labels = classes.select("cls", F.posexplode(F.arrays_zip("regions", "deeps"))).select("cls", F.col("pos").alias("tree"), F.col("col.regions").alias("region"), F.col("col.deeps").alias("deep"))
        sizes = labels.groupBy("tree", "region").agg(F.count("*").alias("size")).filter("size > 1")
        self.labels = staged(labels.join(sizes, ["tree", "region"]))
        self.large = self.labels.filter(F.col("size") > NEIGHBOURS + 1).select("cls", "tree", "region", "deep")
        self.any_large = not self.large.isEmpty()
        self.parts = self._parts()
        heads = self.labels.select("cls").distinct()
        self.classes = staged(classes.join(heads, "cls", "left_semi").select("cls", "n", "sig"))
        found = self.classes.select(_bit("cls").alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("x"))
        wanted = np.zeros(FILTER_BITS // 64, np.int64)
        for r in found.collect():
            wanted[r.w] = r.x
        sets = texts.withColumn("bit", _bit("doc_id")).mapInArrow(_sets_of(wanted), f"doc_id {self.kind}, shingles binary").withColumnRenamed("doc_id", "cls")
        self.sets = staged(sets.join(heads, "cls", "left_semi").dropDuplicates(["cls"]))

    def _parts(self) -> DataFrame:
        """``cls, tree, region, deep, depth, part, chunk``: regions, the large ones cut at the depth where they fit."""
        small = self.labels.filter(F.col("size") <= NEIGHBOURS + 1).select("cls", "tree", "region", "deep", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("chunk"))
        if not self.any_large:
            return small
        rows, depth = self.large, F.lit(DEEP)
        for d in range(1, DEEP + 1):
            rows = rows.withColumn(f"p{d}", F.shiftrightunsigned("deep", int(_BITS) * (DEEP - d)))
        for d in range(DEEP, 0, -1):
            key = ["tree", "region", f"p{d}"]
            counts = rows.select(*key).groupBy(*key).agg(F.count("*").alias(f"s{d}"))
            rows = rows.join(counts, key)
            depth = F.when(F.col(f"s{d}") <= NEIGHBOURS + 1, d).otherwise(depth) if d < DEEP else depth
        part = F.coalesce(*[F.when(depth == d, F.col(f"p{d}")) for d in range(1, DEEP + 1)])
        chunk = F.when((depth == DEEP) & (F.col(f"s{DEEP}") > NEIGHBOURS + 1), F.pmod(F.xxhash64("cls", "tree"), F.ceil(F.col(f"s{DEEP}") / 256))).otherwise(F.lit(0).cast("long"))
        return staged(small.unionByName(rows.select("cls", "tree", "region", "deep", depth.alias("depth"), part.alias("part"), chunk.alias("chunk"))))

    def neighbours(self, parts: DataFrame, first: int, last: int) -> DataFrame:
        """Pairs of the ``first``-th to ``last``-th neighbours in the sorted order of each part."""
        order = W.partitionBy("tree", "region", "depth", "part", "chunk").orderBy("deep", "cls")
        after = F.array_compact(F.array(*[F.lead("cls", i).over(order) for i in range(first, last + 1)]))
        near = parts.select("cls", after.alias("after")).select("cls", F.explode("after").alias("other"))
        return near.filter("cls <> other").select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()

    def close(self, pairs: DataFrame) -> DataFrame:
        """``a, b, na, nb`` of the pairs that may be linked by their sizes and signatures."""
        a, b = (self.classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"sig_{x}")) for x in ("a", "b"))
        joined = pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        estimated = joined.mapInArrow(_estimates, f"a {self.kind}, b {self.kind}, na bigint, nb bigint, est double")
        return staged(estimated.filter(F.col("est") >= self.percent / 100 - SLACK))

    def links(self, close: DataFrame) -> DataFrame:
        """Pairs at the threshold, confirmed on the full sets."""
        sets = self.sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a"))
        joined = close.select("a", "b", "na", "nb").join(sets, "a").join(self.sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b")), "b")
        shared = joined.select("a", "b", "na", "nb", "set_a", "set_b").mapInArrow(_shared, f"a {self.kind}, b {self.kind}, na bigint, nb bigint, common bigint")
        return staged(shared.filter(100 * F.col("common") >= self.percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"))

    def apart(self, pairs: DataFrame, links: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components of the links."""
        of = staged(components(links))
        a, b = (of.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b"))
        joined = pairs.join(a, "a", "left").join(b, "b", "left")
        return joined.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")

    def in_families(self, links: DataFrame) -> DataFrame:
        """Links of large regions beyond the neighbour window."""
        if not self.any_large:
            return links
        large = self.large.select("tree", "region", "cls")
        least = large.groupBy("tree", "region").agg(F.min("cls").alias("first"))
        joined = large.join(least, ["tree", "region"]).select(F.col("cls").alias("a"), F.col("first").alias("b")).distinct()
        family = components(joined).select(F.col("node").alias("cls"), F.col("component").alias("family"))
        of = components(links).select(F.col("node").alias("cls"), "component")
        member = staged(family.join(of, "cls", "left").select("family", "cls", F.coalesce("component", "cls").alias("component")))
        main = member.groupBy("family", "component").agg(F.count("*").alias("k")).groupBy("family").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("size"), F.max("k").alias("most"))
        main = main.filter("most < size").select("family", "main", F.ceil(F.col("size") / BLOCK).alias("blocks"), F.ceil((F.col("size") - F.col("most")) / BLOCK).alias("opens"))
        rows = member.join(main, "family").withColumn("open", F.col("component") != F.col("main")).join(self.sets, "cls")
        every, some = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.sequence(F.lit(0).cast("long"), F.col("opens") - 1)
        own = F.pmod(F.xxhash64("cls"), F.col("blocks"))
        mine = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("opens"))
        # An open member goes to the tasks of its open block with every block, and like all members to its own block's.
        there = F.when(F.col("open"), F.transform(every, lambda b: F.struct(mine.alias("o"), b.alias("b"), F.lit(True).alias("open")))).otherwise(F.array().cast("array<struct<o:bigint,b:bigint,open:boolean>>"))
        here = F.transform(F.filter(some, lambda o: ~F.col("open") | (o != mine)), lambda o: F.struct(o.alias("o"), own.alias("b"), F.lit(False).alias("open")))
        dealt = rows.select("family", "cls", "shingles", F.explode(F.concat(there, here)).alias("t")).select("family", "t.o", "t.b", "t.open", "cls", "shingles")
        more = dealt.groupBy("family", "o", "b").applyInArrow(_compared(self.percent), f"a {self.kind}, b {self.kind}")
        return staged(links.unionByName(more))


def _bit(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, class_id, component_id, kept``.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id reachable over links
    with ``100 * intersection >= percent * union``.
    """
    forest = _Forest(docs, percent)
    links = forest.links(forest.close(forest.neighbours(forest.parts, 1, 1)))
    # Whole regions go on to all their neighbours; members of large ones are compared with their whole family.
    further = forest.close(forest.apart(forest.neighbours(forest.parts.filter("depth = 0"), 2, NEIGHBOURS), links))
    links = staged(links.unionByName(forest.links(further)))
    component = staged(components(forest.in_families(links)))
    found = forest.member.join(component.select(F.col("node").alias("cls"), "component"), "cls", "left").select(
        F.col("doc_id"), F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), F.coalesce("component", "cls").alias("component_id")
    )
    own: Column = F.col("doc_id")
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("class_id", own).alias("class_id"),
        F.coalesce("component_id", own).alias("component_id"), F.coalesce(own == F.coalesce("component_id", own), F.lit(True)).alias("kept"),
    )
