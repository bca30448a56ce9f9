"""Boundary sets against sorted arrays; cuts and round trip against a regular expression."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitscore.llm import infill
from pitscore.llm.boundaries import ARRAY, BITMAP, RUNS, BoundarySet
from tests.llm.fixtures import documents, odd_rows, prose

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _check(positions: np.ndarray) -> None:
    s = BoundarySet(positions)
    assert len(s) == len(positions)
    assert (s.select(np.arange(len(positions))) == positions).all()
    asked = np.unique(np.concatenate((positions, positions + 1, np.maximum(positions - 1, 0), [0, 1 << 16, 1 << 20])))
    assert (s.rank(asked) == positions.searchsorted(asked)).all()


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 300_000), max_size=200))
def test_any_set(values):
    _check(np.array(sorted(values), np.int64))


def test_every_form():
    rng = np.random.default_rng(1)
    dense = np.flatnonzero(rng.random(65_536) < 0.4)
    runs = np.concatenate([np.arange(a, a + 500) for a in range(131_072, 190_000, 1000)])
    sparse = np.sort(rng.choice(np.arange(196_608, 262_144), 50, replace=False))
    whole = np.concatenate((dense, runs, sparse, np.arange(327_680, 393_216)))
    assert [c.form for c in BoundarySet(whole).containers] == [BITMAP, RUNS, ARRAY, RUNS]
    _check(whole)


def brute(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = TOKEN.findall(text)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return doc_id, len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("rate", [50, 100])
def test_brute_force(spark, rate):
    rng = random.Random(4)
    rows = odd_rows() + [(i, prose(rng, rng.randint(1, 30)) + rng.choice(("", " ", "\n\n", "\x0b é "))) for i in range(100, 300)]
    rows += [(300, "a <P> b"), (301, "x<M>"), (302, "  "), (303, "<S"), (304, "漢" * 70_000 + " ñ")]
    found = infill.fill_in_middle(documents(spark, rows), rate=rate).withColumn("text", infill.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:6] for r in found), key=key) == sorted((brute(i, t, rate) for i, t in rows), key=key)
    assert sorted((str(r.doc_id), r.text) for r in found) == sorted((str(i), t or "") for i, t in rows)
    assert rate == 50 or {r.form for r in found} == {"plain", "spm", "psm"}
