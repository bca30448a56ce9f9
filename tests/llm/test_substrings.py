"""Removed bytes against a scan of all 400-byte windows."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np

from pitscore.llm import substrings
from tests.llm.fixtures import documents, prose


def _expected(texts: list[bytes]) -> list[tuple]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - 399):
            seen[t[i : i + 400]] = seen.get(t[i : i + 400], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def test_all_windows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_BYTES", 20_000)
    rng = random.Random(6)
    shared = [prose(rng, 25) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = [prose(rng, rng.choice((1, 5, 15)))]
        if rng.random() < 0.7:
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            parts.append(p[a : a + rng.choice((380, 400, 401, 450, 900))])
        texts.append(rng.choice(("", " ", "\n")).join([*parts, prose(rng, 2)]))
    texts += [texts[0], texts[0], "ab" * 500, "xyz " * 300, "q" * 399, "q" * 400, "r" * 401, (line := prose(rng, 6)) * 3, None, "", shared[0][:400], shared[0][1:401]]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in substrings.remove_repeats(documents(spark, rows).repartition(3)).collect()}
    assert line
    for (i, _), e in zip(rows, _expected([(t or "").encode() for t in texts])):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == e


def test_runs_inside_windows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_BYTES", 20_000)
    rng = random.Random(12)
    texts = []
    for k, run in enumerate(("q", " ", "-", "x, ", "=-", "| --- ", "0123456789abcdefghijklmnopqrs")):
        for size, total in ((100, 400), (60, 450), (200, 600), (150, 900), (300, 900)):
            head, tail = (prose(rng, 12)[-size:], prose(rng, 12)[: size // 2 if k % 2 else 0])
            passage = head + (run * 900)[: total - len(head) - len(tail)] + tail
            texts += [prose(rng, 6) + "#" + passage + "%" + prose(rng, 5), prose(rng, 5) + "@" + passage + "!" + prose(rng, 6)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in substrings.remove_repeats(documents(spark, rows).repartition(3)).collect()}
    for (i, _), e in zip(rows, _expected([t.encode() for t in texts])):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == e


def test_shuffles_of_finished_steps_are_freed(spark, monkeypatch):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> set[str]:
        files = manager.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    substrings.free_shuffles(spark)
    time.sleep(2)
    before, calls, free = shuffled(), [], substrings.free_shuffles
    monkeypatch.setattr(substrings, "free_shuffles", lambda s: calls.append(len(shuffled() - before)) or free(s))
    long = "".join(random.Random(4).choices("abcdefgh ", k=4000))
    texts, spans = substrings.repeated(documents(spark, [(1, long), (2, "x" + long), (3, long[:700]), (4, None)]))
    assert len(calls) >= 4 and max(calls) > 0
    del texts, spans
    for _ in range(20):
        free(spark)
        time.sleep(0.5)
        if not shuffled() - before:
            break
    assert not shuffled() - before


def test_long_tables_are_gone_before_the_texts_meet_their_runs(spark, tmp_path, monkeypatch):
    """When ``repeated`` ends, only texts and disjoint runs in order are left on the disk."""
    paths, write = [], substrings.written
    monkeypatch.setattr(substrings, "written", lambda df, *parts: paths.append(write(df, *parts)) or paths[-1])
    long = prose(random.Random(4), 40)
    texts, spans = substrings.repeated(documents(spark, [(1, long), (2, "x" + long + long[:600]), (3, long[:700]), (4, None), (5, "short")]))
    folder = spark._jvm.org.apache.hadoop.fs.Path(paths[0])
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    left = [f.getPath().getName() for f in files.listStatus(folder)]
    assert [x for x in left if x.startswith("part=")] == ["part=text"]
    assert not [p for p in paths[1:] if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p)) and any("part=" not in f.getPath().getName() and f.getPath().getName() != "_SUCCESS" for f in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(p)))]
    assert texts.count() == 5
    for r in spans.collect():
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:])) and all(s.start < s.end for s in r.spans)


def test_numbers_need_one_exchange_of_few_ranges(spark, monkeypatch):
    """The driver samples rows for every range: their count follows the rows, not the session's partitions, and no table is broadcast."""
    monkeypatch.setattr(substrings, "RANGE_ROWS", 2)
    monkeypatch.setattr(substrings, "RANGES", 5)
    rows = [(0, 5, 0, 1), (1, 5, 0, 1), (0, 7, 1, 2), (1, 8, 1, 1), (2, -3, 1, 1), (0, -3, 1, 4), (3, 9, 9, 1), (4, 7, 2, 1), (5, -3, 1, 1), (6, 5, 0, 1), (7, 1, 1, 1), (8, 1, 1, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        found = substrings._numbered(spark.createDataFrame(rows, "of bigint, a bigint, b bigint, n bigint"), ["a", "b"], 3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert plan.count("Exchange") == 1 and "rangepartitioning(a" in plan and ", 5), REPARTITION_BY_NUM" in plan and "Join" not in plan
    total = {k: sum(n for _, a, b, n in rows if (a, b) == k) for k in {(a, b) for _, a, b, _ in rows}}
    assert sorted((r.of, r.a, r.b) for r in got) == sorted((of, a, b) for of, a, b, _ in rows if total[a, b] > 1)
    ids = {(r.a, r.b): {x.id for x in got if (x.a, x.b) == (r.a, r.b)} for r in got}
    assert all(len(x) == 1 and min(x) > 3 << 54 for x in ids.values())
    in_order = [min(ids[k]) for k in sorted(ids)]
    assert in_order == sorted(set(in_order))


def test_periods_are_those_of_the_bytes():
    rng = np.random.default_rng(2)
    grams = [bytes(rng.integers(97, 99, 40, dtype=np.uint8)) for _ in range(300)] + [(bytes(rng.integers(0, 256, q, dtype=np.uint8)) * 40)[:40] for q in range(1, 41)]
    expected = [any(g[:-q] == g[q:] for q in range(1, substrings.PERIOD + 1)) for g in grams]
    found = substrings._periodic(np.frombuffer(b"".join(grams), np.uint8), np.arange(len(grams)) * substrings.GRAM)
    assert found.tolist() == expected and any(expected) and not all(expected)
