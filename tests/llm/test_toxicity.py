"""Held-out accuracy, offending sentences, and independence from held-out labels."""

from __future__ import annotations

import random
import zlib

from pitscore.llm import toxicity
from tests.llm.fixtures import documents, prose

BAD = ["moron", "scumbag", "filth", "vermin"]


def _corpus():
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(500):
        text = prose(rng, rng.choice((2, 5, 20)))
        toxic = i % 5 == 0
        if toxic:
            text += f" You {rng.choice(BAD)}, go away! " + prose(rng, 3)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out(spark):
    rows, labels = _corpus()
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    scores = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    wrong = [i for i in held if (scores[i].score >= 0.5) != bool(labels[i][1])]
    assert len(wrong) <= 0.03 * len(held)
    found = [i for i in held if scores[i].offending]
    for i in found:
        s = scores[i].offending[0]
        assert any(b in rows[i][1][s.start : s.end] for b in BAD)
    flipped = spark.createDataFrame([(i, 1 - y if i in set(held) else y) for i, y in labels], "doc_id bigint, toxic int")
    again = toxicity.score(docs, toxicity.fit(docs, flipped)).collect()
    assert {r.doc_id: r.score for r in again} == {i: r.score for i, r in scores.items()}
    assert {r.doc_id for r in toxicity.filter_documents(docs, toxicity.fit(docs, known)).collect()} == {i for i, r in scores.items() if r.score < 0.5}


def test_cap_keeps_decisions(spark, monkeypatch):
    rng = random.Random(2)
    # A word of all toxic documents that most documents with it have although they are clean.
    rows = [(i, prose(rng, 3) + (" So mild." if i % 10 == 0 or i % 3 == 0 else "")) for i in range(600)]
    docs, known = documents(spark, rows), spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    whole = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 60)
    assert whole == {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}


def test_long_document_does_not_end_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 1000)
    docs = documents(spark, [(i, "x " * (5000 if i % 2 else 10)) for i in range(40)])
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id bigint, toxic int")
    short = [i for i in range(0, 40, 2) if zlib.crc32(str(i).encode()) % 5 != 0]
    got = toxicity.sample(docs, known, 0).collect()
    assert sorted(r.doc_id for r in got) == short
    assert abs(sum(r.weight for r in got) - sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(40))) < 1e-9
