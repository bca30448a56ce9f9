"""Odd rows, clashing columns and empty tables through every operator: rows whole, results defined."""

from __future__ import annotations

import pyarrow as pa
import pytest

from pitscore.llm import common, decontamination, fingerprints, infill, licenses, lmscore, neardedup, packing, secrets, sharding, substrings, toxicity
from tests.llm.fixtures import documents, odd_rows

LABELS = [(1, 1), (4, 0), (7, 1), (None, 1), (8, None)]
ITEMS = [(1, "two words"), (2, None), (None, "word"), (3, ""), (3, "x, " * 40)]


def _toxicity(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, toxic int")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def _benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


PER_ROW = {
    "near_duplicates": lambda spark, d: neardedup.near_duplicates(d),
    "decontamination": lambda spark, d: decontamination.occurrences(d, _benchmark(spark)),
    "licenses": lambda spark, d: licenses.scan(d),
    "secrets": lambda spark, d: secrets.scan(d),
    "lm_scores": lambda spark, d: lmscore.score(d),
    "sharding": lambda spark, d: sharding.uniform_shards(d, 4),
    "toxicity": _toxicity,
    "substrings": lambda spark, d: substrings.remove_repeats(d),
    "fingerprints": lambda spark, d: fingerprints.match(d, fingerprints.lexicon(d)),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_odd_rows(spark, name):
    rows = odd_rows()
    found = PER_ROW[name](spark, documents(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)


PER_ROW["packing"] = lambda spark, d: packing.pack(d)
PER_ROW["infill"] = lambda spark, d: infill.fill_in_middle(d)


@pytest.mark.parametrize("rows", [[(1, "")], [(1, None), (2, "  ")], [(1, ""), (2, None), (3, "\n"), (4, "word")]])
@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_wordless_slices(spark, name, rows):
    docs = documents(spark, rows).repartition(len(rows), "doc_id")
    found = PER_ROW[name](spark, docs).collect()
    assert sorted({r.doc_id for r in found}) == [i for i, _ in rows]


def test_labels_without_words(spark):
    docs = documents(spark, [(i, " " * i) for i in range(12)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {0.0}


def test_sharding_helper_names(spark):
    names = ("_first", "_run", "_ends", "_s", "_r", "_before", "_row", "_part", "_at", "_again", "data", "n", "counts", "a.b")
    docs = spark.createDataFrame([(i, *names) for i in range(30)], ["doc_id", *names])
    found = sharding.uniform_shards(docs, 4)
    assert found.columns == ["doc_id", *names, "shard", "slot"]
    assert sorted((r.doc_id, r["a.b"], r._run) for r in found.collect()) == [(i, "a.b", "_run") for i in range(30)]


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_empty_table(spark, name):
    assert PER_ROW[name](spark, documents(spark, [])).collect() == []


def test_packing_odd_rows(spark):
    rows = odd_rows()
    pieces = packing.pack(documents(spark, rows)).collect()
    assert {str(p.doc_id) for p in pieces} == {str(i) for i, _ in rows}
    assert [(p.length, p.doc_tokens) for p in pieces if p.doc_id in (1, 2, 3)] == [(1, 1)] * 3
    assert packing.pack(documents(spark, [])).collect() == []


def test_defined_results(spark):
    docs = documents(spark, odd_rows())
    near = {r.doc_id: r for r in neardedup.near_duplicates(docs).collect()}
    assert (near[1].n_shingles, near[1].component_id, near[1].kept) == (0, 1, True)
    assert (near[5].n_shingles, near[9].component_id, near[9].kept, near[4].kept) == (1, 4, False, True)
    hits = {r.doc_id: r for r in decontamination.occurrences(docs, _benchmark(spark)).collect()}
    assert (hits[6].n_words, hits[6].n_hit, hits[6].items, hits[3].n_words) == (2, 2, [1], 0)
    assert (hits[5].n_hit, hits[10].items) == (0, [3])
    scores = _toxicity(spark, docs).collect()
    assert all(0 <= r.score <= 1 for r in scores) and all(r.score == 0 for r in scores if r.n_sentences == 0)
    cut = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert cut[9].n_removed == cut[9].n_bytes and cut[4].n_spans == 1 and cut[8].n_removed == 30_000 and cut[5].n_removed == 0


def test_slices_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "b" * 10])})
    assert [b.num_rows for b in common.slices(iter([batch, batch]), limit=12)] == [2, 1, 2, 1] and calls == [1]
    monkeypatch.undo()
    common.release()
