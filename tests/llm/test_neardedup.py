"""Near duplicates against all pairs, with a hot group and chains."""

from __future__ import annotations

import random

from pitscore.llm import neardedup
from tests.llm.fixtures import SPACE_WORDS, documents, lower, prose


def _sets(rows):
    out = {}
    for i, t in rows:
        w = SPACE_WORDS.findall(lower(t or ""))
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def _components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def _edited(rng, text, k):
    words = text.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = "edit" + str(rng.random())
    return " ".join(words)


def test_all_pairs(spark):
    rng = random.Random(5)
    texts = [prose(rng, 20) for _ in range(60)]
    texts += [_edited(rng, rng.choice(texts[:20]), rng.choice((1, 2, 4))) for _ in range(60)]
    hub = prose(rng, 30)
    texts += [hub] * 5 + [_edited(rng, hub, rng.choice((1, 2, 3))) for _ in range(90)]
    chain = [prose(rng, 40)]
    for _ in range(8):
        chain.append(_edited(rng, chain[-1], 3))
    rows = list(enumerate(texts + chain + ["one", "one", "a b c d", "a  B c d", ""]))
    rng.shuffle(rows)
    sets = _sets(rows)
    expected = _components(sets)
    got = {r.doc_id: r for r in neardedup.near_duplicates(documents(spark, rows)).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert max(list(expected.values()).count(c) for c in set(expected.values())) > neardedup.NEIGHBOURS + 1
