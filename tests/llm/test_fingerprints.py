"""Fingerprints: equal texts, edited texts, and the order of next documents over buckets."""

from __future__ import annotations

import hashlib
import random

from pitscore.llm import fingerprints
from tests.llm.fixtures import documents, prose


def test_next_and_edited(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 4000)
    rng = random.Random(4)
    rows = [(i * 7, prose(rng, rng.choice((1, 4, 12, 30)))) for i in range(120)]
    rows += [(10_000, rows[5][1]), (10_001, ""), (10_002, None), (10_003, rows[5][1])]
    rng.shuffle(rows)
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in fingerprints.match(docs, fingerprints.lexicon(docs, 0.005, 0.5)).collect()}
    ids = sorted((i for i, _ in rows), reverse=True)
    text = {i: t or "" for i, t in rows}
    for a, b in zip(ids, [*ids[1:], ids[0]]):
        k = len(text[a]) // 3
        edited = text[a][: len(text[a]) - k] + text[b][:k]
        assert got[a].n_chars == len(text[a]) and got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[a].near_next == fingerprints.likeness(got[a].fingerprint, got[b].fingerprint)
    assert got[10_000].fingerprint == got[10_003].fingerprint == got[35].fingerprint and got[10_001].fingerprint == got[10_002].fingerprint
    long = [r for r in got.values() if r.n_chars > 300]
    assert sum(r.near_edited for r in long) / len(long) > 0.15
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)


def test_lexicon_band(spark):
    rows = [(i, " ".join(["all", "half" if i % 2 else "", f"own{i}"])) for i in range(100)]
    known = fingerprints.lexicon(documents(spark, rows), 0.02, 0.6)
    assert len(known) == 1
