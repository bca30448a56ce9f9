"""Wu-Manber search against a scan of all windows, in one and in several blocks of patterns."""

from __future__ import annotations

import random

import pytest

from pitscore.llm import decontamination
from tests.llm.fixtures import ALNUM_WORDS, documents, lower, prose


@pytest.mark.parametrize("patterns", [decontamination.PATTERNS, 40])
def test_windows(spark, monkeypatch, patterns):
    monkeypatch.setattr(decontamination, "PATTERNS", patterns)
    rng = random.Random(9)
    items = [(i, prose(rng, rng.choice((1, 3, 5)))) for i in range(12)] + [(20, "One, two"), (21, "solo"), (22, items_twice := prose(rng, 4)), (23, items_twice)]
    rows = []
    for i in range(60):
        words = prose(rng, 6).split()
        if i % 3:
            source = rng.choice(items)[1].split()
            a = rng.randrange(len(source))
            words[3:3] = source[a : a + rng.choice((5, 13, 14, 40))]
        rows.append((i, " ".join(words).upper() if i % 2 else ";".join(words)))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = ALNUM_WORDS.findall(lower(t))
        for j in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[j : j + 13]), set()).add(i)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for r in decontamination.occurrences(documents(spark, rows), bench).collect():
        w = ALNUM_WORDS.findall(lower(dict(rows)[r.doc_id]))
        hit, found = [0] * len(w), set()
        for m in {len(k) for k in windows}:
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in windows:
                    found |= windows[tuple(w[j : j + m])]
                    hit[j : j + m] = [1] * m
        assert (r.n_words, r.n_hit, r.items) == (len(w), sum(hit), sorted(found))


def test_clean_documents_keep_their_columns(spark):
    docs = documents(spark, [(1, "alpha beta gamma"), (2, "delta")])
    bench = spark.createDataFrame([(1, "Delta")], "item_id bigint, text string")
    kept = decontamination.clean_documents(docs, bench)
    assert kept.columns == docs.columns and [(r.doc_id, r["items"]) for r in kept.collect()] == [(1, "other")]
