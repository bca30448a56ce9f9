"""Every id in exactly one piece, no sequence above its window, little padding, full step groups."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from pitscore.llm import packing, subwords
from pitscore.llm.subwords import remembered
from tests.llm.fixtures import documents, prose


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(packing, "POOL_DOCS", 40)
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice((1, 2, 5, 20, 120)))) for i in range(150)] + [(200, "Don't 3.14 <|endoftext|> ©é́ x y\n\nz"), (201, None), (202, "<|ENDOFTEXT|>  A")]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    frame = packing.pack(documents(spark, rows).coalesce(2)).cache()
    pieces = defaultdict(list)
    for p in frame.collect():
        pieces[p.doc_id].append(p)
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces[doc_id], key=lambda p: p.start):
            part = ids[at : at + p.length]
            assert p.start == at and p.doc_tokens == len(ids)
            assert np.frombuffer(p.ids, "<u2").tolist() == part and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding, windows = 0, defaultdict(list)
    for s in packing.sequences(frame).collect():
        assert len(s.ids) == 2 * s.n_tokens and s.n_tokens <= 2048
        padding += 0 if s.n_tokens & (s.n_tokens - 1) == 0 else 2048 - s.n_tokens
        windows[s.step].append(s.tier)
    assert padding <= 2 * 2048
    assert all(len(set(w)) == 1 and sum(w) <= packing.STEP_TOKENS for w in windows.values())
    offsets = defaultdict(list)
    for p in frame.collect():
        offsets[p.sequence_id].append((p.offset, p.length))
    for parts in offsets.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0


def test_memory_outlives_a_task(spark):
    """Tasks that run one after the other in one worker share its encoder."""
    path = public_tokenizers.path(packing.VOCABULARY)

    def known(batches):
        tokens = remembered(path)
        for batch in batches:
            before = tokens.n
            ids, _ = tokens.encode(batch.column("text"), packing.END)
            yield pa.record_batch({"before": [before], "ids": [ids.tolist()]})

    expected = Tokenizer.from_file(path).encode("some words here", add_special_tokens=False).ids + [packing.END]
    rows = documents(spark, [(1, "some words here")]).select("text").coalesce(1)
    first, second = (rows.mapInArrow(known, "before bigint, ids array<bigint>").first() for _ in range(2))
    assert first.ids == second.ids == expected and second.before > 0


def test_forgets_and_starts_anew(monkeypatch):
    monkeypatch.setattr(subwords, "MEMORY_CHUNKS", 3)
    path = public_tokenizers.path(packing.VOCABULARY)
    plain, tokens = Tokenizer.from_file(path), subwords.Subwords(path)
    for text in ("one two three", "three four", "one two five", "six"):
        ids, _ = tokens.encode(pa.array([text]), packing.END)
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, packing.END]


def test_words_are_merged_together(monkeypatch):
    """Words of letters need no tokeniser, words and texts have the ids that it gives."""
    path, rng = public_tokenizers.path(packing.VOCABULARY), random.Random(9)
    plain, tokens = Tokenizer.from_file(path), subwords.Subwords(path)
    letters = "abcdefghijklmnopqrstuvwxyzßàçèéêñöøüÿ"
    words = list(dict.fromkeys("".join(rng.choices(rng.choice((letters, "aeinst")), k=rng.randint(1, 30))) for _ in range(4000)))
    expected = [e.ids for e in plain.encode_batch(words, add_special_tokens=False)]
    asked, slow = [], tokens.tokenizer
    monkeypatch.setattr(tokens, "tokenizer", type("T", (), {"encode_batch_fast": lambda self, x, **k: asked.extend(x) or slow.encode_batch_fast(x, **k)})())
    assert tokens.chunks(words) == expected
    assert all(len(x.encode()) > subwords.LONGEST[-1] for x in asked)
    assert tokens.chunks(odd := ["x" * 40, "a÷b", "×", "don't", "é" * 17, "3a", ""]) == [e.ids for e in plain.encode_batch(odd, add_special_tokens=False)]
    for text in ("ÀÉ Éá ÇA × Þß", "ÀÉ È×È ÇA ÞE.", "É<|x", "Ÿ Ǖ İ Éé"):
        assert tokens.encode(pa.array([text]), packing.END)[0].tolist() == [*plain.encode(text, add_special_tokens=False).ids, packing.END]
