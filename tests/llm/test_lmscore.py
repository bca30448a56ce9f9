"""Word scores by hand; the attention model is a probability and scores positions once."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa

from pitscore.llm import attention, lmscore
from pitscore.llm.subwords import Subwords
from tests.llm.fixtures import SPACE_WORDS, documents, lower, prose


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 2000)
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice((1, 6, 20)))) for i in range(80)] + [(200, "WORD  word\tWord\x0b!"), (201, None), (202, "")]
    words = {i: [*SPACE_WORDS.findall(lower(t or "")), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    c = collections.Counter(x for i, w in words.items() if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    for r in lmscore.score(documents(spark, rows)).collect():
        w = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0


def _trained():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 60, 200)
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    # After an even id comes its successor: a rule that the model can learn.
    ids = np.zeros(bounds[-1], np.uint16)
    for a, b in zip(bounds, bounds[1:]):
        x = 2 * rng.integers(10, 40, (b - a + 1) // 2)
        ids[a:b] = np.stack([x, x + 1], 1).ravel()[: b - a]
        ids[b - 1] = attention.END
    counts = np.bincount(ids, minlength=lmscore.IDS).astype(float)
    return attention.train(counts, np.zeros((0, 3), np.int64), ids, bounds, steps=60), ids, bounds


def test_model_is_a_distribution():
    model, ids, bounds = _trained()
    context = ids[bounds[3] : bounds[3] + 5].copy()
    total = 0.0
    texts = np.tile(np.append(context, 0), (lmscore.IDS, 1)).astype(np.uint16)
    texts[:, -1] = np.arange(lmscore.IDS)
    logs = attention.log_probabilities(model, texts.ravel(), np.arange(lmscore.IDS + 1) * texts.shape[1])
    total = np.exp(logs.reshape(texts.shape)[:, -1]).sum()
    assert abs(total - 1) < 0.01


def test_windows_score_each_position_once():
    bounds = np.array([0, 0, 1, 17, 45, 161])
    first, size, scored = attention.windows(bounds)
    seen = np.zeros(bounds[-1], int)
    for f, s, c in zip(first, size, scored):
        seen[f + c : f + s] += 1
    assert (seen == 1).all()


def test_later_ids_do_not_matter():
    model, ids, bounds = _trained()
    a = ids[bounds[5] : bounds[6]].copy()
    b = a.copy()
    b[-1] = 33
    one, two = (attention.log_probabilities(model, x, np.array([0, len(x)])) for x in (a, b))
    assert np.allclose(one[:-1], two[:-1])


def test_split_words():
    flat, bounds = lmscore.split_words(pa.array(["A  b\n", "", " \t", "ÑÉ c"]))
    assert flat.to_pylist() == ["a", "b", "ÑÉ", "c"] and bounds.tolist() == [0, 2, 2, 2, 4]


def test_neighbours_cross_blanks(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 500)
    monkeypatch.setattr(lmscore, "SLICE_IDS", 40)
    monkeypatch.setattr(lmscore, "SAMPLE_DOCS", 3)
    given, train = {}, attention.train
    monkeypatch.setattr(attention, "train", lambda counts, pairs, ids, bounds: given.update(counts=counts, pairs=pairs, sample=ids) or train(counts, pairs, ids, bounds, steps=5))
    rows = [(i, "hello, sir" if i % 2 else "hello world hello") for i in range(60)] + [(60, None), (61, "")]
    lmscore.score(documents(spark, rows).repartition(3)).collect()
    tokens = Subwords(public_tokenizers.path(lmscore.VOCABULARY))
    expected = collections.Counter()
    place = attention.places(given["counts"])
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            ids = [attention.START, *(x for e in tokens.chunks((t or "").split()) for x in e), attention.END]
            expected.update((int(place[a]), int(place[b])) for a, b in zip(ids, ids[1:]))
    assert {(a, b): n for a, b, n in given["pairs"].tolist()} == expected
    hello, world = (place[tokens.chunks([x])[0][0]] for x in ("hello", "world"))
    comma = place[tokens.chunks(["hello,"])[0][1]]
    assert min(expected[hello, world], expected[hello, comma]) > 10


def test_attention_learns_from_all_training_texts(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 500)
    monkeypatch.setattr(lmscore, "SLICE_IDS", 40)
    monkeypatch.setattr(lmscore, "SAMPLE_DOCS", 3)
    given, learnt = {}, attention.learnt
    monkeypatch.setattr(attention, "learnt", lambda m, total, n: given.update(start=m, n=n, end=learnt(m, total, n)) or given["end"])
    rows = [(i, "hello, sir " * (i % 7) if i % 2 else "hello world hello") for i in range(60)] + [(60, None), (61, "")]
    lmscore.score(documents(spark, rows).repartition(3)).collect()
    tokens = Subwords(public_tokenizers.path(lmscore.VOCABULARY))
    sizes = [1 + sum(len(e) for e in tokens.chunks((t or "").split())) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    assert given["n"] == sum(-(-s // attention.WINDOW) for s in sizes)
    assert not np.allclose(given["start"].weights["o"], given["end"].weights["o"])


def test_pass_lowers_the_loss():
    model, ids, bounds = _trained()
    total, n = attention.passed(model, iter([(ids, bounds)] * 30))
    assert n == 30 * sum(-(-s // attention.WINDOW) for s in np.diff(bounds))
    after = attention.learnt(model, total, n)
    assert attention.log_probabilities(after, ids, bounds).mean() >= attention.log_probabilities(model, ids, bounds).mean()


def test_gradient():
    rng = np.random.default_rng(3)
    p = {k: (rng.standard_normal(s) * 0.3) for k, s in attention.SHAPES.items()}
    table, row = rng.standard_normal((attention.ROWS, attention.CLASSES)), rng.integers(0, 5, (3, attention.WINDOW))
    classes, live = rng.integers(0, attention.CLASSES, row.shape), (np.arange(attention.WINDOW) < np.array([[16], [9], [1]])).astype(float)

    def loss() -> float:
        x = p["e"][row] + p["p"]
        a = x @ p["wq"] @ (x @ p["wk"]).transpose(0, 2, 1) / 4 + np.triu(np.full((attention.WINDOW,) * 2, -1e9), 1)
        a = np.exp(a - a.max(2, keepdims=True))
        z = a / a.sum(2, keepdims=True) @ (x @ p["wv"]) @ p["o"] + table[row]
        z -= np.log(np.exp(z).sum(2, keepdims=True))
        return -(np.take_along_axis(z, classes[:, :, None], 2)[:, :, 0] * live).sum() / live.sum()

    found = attention._gradient(p, table, row, classes, live)
    for key, at in (("e", (2, 3)), ("p", (4, 1)), ("wq", (0, 5)), ("wk", (7, 2)), ("wv", (3, 3)), ("o", (1, 30))):
        values = []
        for step in (1e-5, -2e-5, 1e-5):
            p[key][at] += step
            values.append(loss())
        assert math.isclose((values[0] - values[1]) / 2e-5, found[key][at], rel_tol=1e-3, abs_tol=1e-7)


def test_far_exponents_are_shifted():
    """Weights so large that powers of exponents overflow give the gradient of exponents shifted by their greatest."""
    rng = np.random.default_rng(5)
    row = rng.integers(0, 50, (40, attention.WINDOW))
    classes, live = rng.integers(0, attention.CLASSES, row.shape), np.ones(row.shape, np.float32)
    table = rng.standard_normal((attention.ROWS, attention.CLASSES)).astype(np.float32)
    table -= table.max(1, keepdims=True)
    for size, far in ((0.3, False), (1.0, True)):
        p = {k: (rng.standard_normal(s) * size).astype(np.float32) for k, s in attention.SHAPES.items()}
        x = p["e"][row] + p["p"]
        assert attention._beyond((x @ p["wq"]) @ (x @ p["wk"]).transpose(0, 2, 1) / 4) == far
        found = attention._gradient(p, table, row, classes, live)
        exact = attention._gradient({k: v.astype(float) for k, v in p.items()}, table.astype(float), row, classes, live.astype(float))
        for key in p:
            assert np.isfinite(found[key]).all()
            assert np.linalg.norm(found[key] - exact[key]) <= 0.01 * np.linalg.norm(exact[key])


def test_scores_do_not_depend_on_the_batch():
    model, ids, bounds = _trained()
    scores = [attention.log_probabilities(model, ids, bounds, batch=n) for n in (7, 512, 4096)]
    assert all(np.allclose(s, scores[0], atol=1e-4) for s in scores)
