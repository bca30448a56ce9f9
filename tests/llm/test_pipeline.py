"""Every stage against brute force on one small corpus, and the pipeline as a whole."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as cp
from pitscore.llm import secrets
from tests.llm.fixtures import documents, odd_rows, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(12)
    items = [(i, prose(rng, 4)) for i in range(5)]
    rows, labels = [], []
    for i in range(100, 400):
        text = prose(rng, 8)
        if i % 6 == 0:
            text += " What a worthless clown."
        if i % 17 == 0:
            text += " " + items[0][1]
        if i % 13 == 0:
            text += " password=abcdef123 end."
        rows.append((i, text))
        labels.append((i, int(i % 6 == 0)))
    rows += [(900, rows[1][1]), (901, rows[1][1] + " More.")] + odd_rows()
    documents(spark, rows, clash=False).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages(spark, folder, tmp_path):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id: r.text for r in docs.collect()})
    toxic, near, clean, safe = seen
    planted = {i for i, t in rows if t and "worthless clown" in t}
    assert len(set(toxic) & planted) <= 2 and len(set(toxic) | planted) >= len({i for i, _ in rows}) - 2
    assert {900, 901} & set(near) == set() and 101 in near
    assert len([r for r in rows if r[0] in (4, 9)]) == 3 and 4 in near and 9 not in near
    assert {i for i in near if i is not None and 100 <= i < 400 and i % 17 == 0} & set(clean) == set()
    assert all("password=abcdef123" not in (t or "") for t in safe.values()) and any("[SECRET] end." in (t or "") for t in safe.values())
    assert {i: t for i, t in clean.items() if "password" not in (t or "") and i not in (8, 12)}.items() <= safe.items()
    assert [(r.doc_id, r.n_chars) for r in docs.collect() if r.n_chars != (len(r.text) if r.text is not None else None)] == []


def test_run(spark, folder):
    path, rows = folder
    pieces = cp.run(spark, path).collect()
    assert {"doc_id", "start", "length", "ids", "sequence_id"} <= set(pieces[0].asDict())
    total: dict = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert all(total[p.doc_id] == p.doc_tokens for p in pieces if p.doc_id not in (7, None))


def test_empty_documents(spark, folder, tmp_path):
    path, _ = folder
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, path).collect() == []


def test_marks_are_not_secrets(spark):
    assert secrets.RULES[0].key == "assign@1"
