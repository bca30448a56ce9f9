"""FM-index steps and phrase counts against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitscore.llm import fmindex, phrases
from tests.llm.fixtures import documents, lower, odd_rows

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def test_index_both_ways():
    rng = np.random.default_rng(2)
    ids = np.concatenate(([0], rng.integers(0, 6, 3000), [0])).astype(np.int32)
    n_ids = 6
    ways = [fmindex.Direction(fmindex.transform(x, n_ids), n_ids) for x in (ids, ids[::-1])]
    low, count = fmindex.words(ways[0])
    live = [((w + 1,), int(low[w]), int(low[w]), int(count[w])) for w in range(n_ids - 1)]
    for length in range(2, fmindex.DEPTH + 1):
        left = length % 2 == 0
        here = 1 if left else 2
        live.sort(key=lambda x: x[here])
        cols = [np.array([x[i] for x in live]) for i in (here, 3, 3 - here)]
        e = ways[0 if left else 1].extend(*cols)
        live = []
        for of, i, a, n, b in zip(e.of, e.id, e.low, e.count, e.other):
            live.append((int(of), int(i), int(a), int(b), int(n)))
        # Rebuild the phrases from the interval each one came from.
        grown = []
        for of, i, a, b, n in live:
            word = before[of] if length > 2 else (of + 1,)
            phrase = (i, *word) if left else (*word, i)
            grown.append((phrase, a if left else b, b if left else a, n))
        plain = Counter(tuple(ids[j : j + length].tolist()) for j in range(len(ids) - length + 1) if (ids[j : j + length] > 0).all())
        assert {p: n for p, _, _, n in grown} == dict(plain)
        grown.sort(key=lambda x: x[2] if length + 1 <= fmindex.DEPTH and (length + 1) % 2 else x[1])
        live, before = grown, [g[0] for g in grown]


def brute(rows, min_count, keep_percent=100, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split(lower(text or "")):
            ws = WORD.findall(piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    live = {k: a for k, a in f.items() if a >= min_count and len(k[1]) > 1}
    dropped = {(lang, w[i:j]) for (lang, w), a in live.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * a >= keep_percent * f[lang, w[i:j]]}
    out = []
    for lang in n:
        rows_of = []
        for (of, w), a in live.items():
            if of == lang and (lang, w) not in dropped:
                score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
                rows_of.append((-score, -a, " ".join(w).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("min_count,keep,top", [(3, 100, 2000), (5, 80, 7), (1000, 100, 2000)])
def test_brute_force(spark, min_count, keep, top):
    rng = random.Random(min_count)
    vocabulary = ["the", "The", "of", "é", "new", "york", "x" * 40, "漢字", "a\x00b"] + [f"w{i}" for i in range(20)]
    said = ["new york city council met", "in order to", "of the of the of the of the"]

    def text():
        out = []
        for _ in range(rng.randint(0, 30)):
            out.append(rng.choice(said) if rng.random() < 0.2 else rng.choice(vocabulary))
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " : "]))
        return "".join(out)

    rows = [(rng.choice(("en", "de", None, "und", "en")), text()) for _ in range(300)] + [("en", t) for _, t in odd_rows()] + [("xx", None), ("yy", "!")]
    docs = documents(spark, [(i, t) for i, (_, t) in enumerate(rows)]).drop("lang")
    langs = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(rows)], "doc_id bigint, lang string")
    docs = docs.join(langs, "doc_id").withColumns({c: F.lit("c") for c in ("shard", "no", "z", "id", "p", "s", "phrase", "l", "r")}).repartition(4)
    got = phrases.collocations(docs, min_count, keep, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute(rows, min_count, keep, top)


@pytest.mark.parametrize("rows", [[], [(1, "")], [(1, None), (2, "  ")], [(1, "one")]])
def test_no_phrases(spark, rows):
    assert phrases.collocations(documents(spark, rows), 1).collect() == []


def test_words_get_their_ids_without_a_join(spark, monkeypatch):
    """Ids of frequent words come from the pass that counts them: no join of words, whatever share of them is frequent."""
    plans, write = [], phrases.staged
    monkeypatch.setattr(phrases, "staged", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    _, levels = phrases.phrase_counts(documents(spark, [(i, "one two three") for i in range(8)]).repartition(4), 8)
    assert sorted((r.phrase, r.f) for r in levels[0].collect()) == [("one", 8), ("three", 8), ("two", 8)]
    assert levels[0].select("id").distinct().count() == 3
    assert [r.phrase for r in levels[2].collect()] == ["one two three"]
    assert not any(re.search(r"Join .*word#", plan) for plan in plans)
