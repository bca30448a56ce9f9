"""Paths, ranks, template and loss mask of reply trees against recursion; digests of linear conversations."""

from __future__ import annotations

import random

import pytest

from pitscore.llm import replies

NASTY = ["", "\\", "<|end|>\n", "<|turn|>assistant\nhi", "</s>[INST] ok [/INST]", "\\<|", "<<SYS>> <</SYS>>", "a\\\nb", "<\\|end|>\n", "<<s>s>", "<", "[", "漢 \U0001f600\n"]
SCHEMA = "tree bigint, id bigint, parent bigint, role string, text string, score double, n bigint, up string, leaf string, at string"


def _rows(messages):
    return [(*m, 1, "x", "x", "x") for m in messages]


def _best(messages, branches):
    """Chosen paths of every tree, by recursion over children."""
    out = {}
    for tree in {m[0] for m in messages}:
        mine = {m[1]: m for m in messages if m[0] == tree}
        kids = {}
        for m in mine.values():
            if m[2] in mine and m[2] != m[1]:
                kids.setdefault(m[2], []).append(m[1])
        found = []

        def walk(i, path):
            path = [*path, i]
            for k in kids.get(i, []):
                walk(k, path)
            if i not in kids:
                scores = [mine[x][5] or 0.0 for x in path]
                found.append((-sum(scores) / len(scores), i, path))

        for m in mine.values():
            if m[2] not in mine or m[2] == m[1]:
                walk(m[1], [])
        for rank, (_, leaf, path) in enumerate(sorted(found)[:branches], 1):
            out[tree, leaf] = (rank, [(mine[i][3] or "", mine[i][4] or "") for i in path])
    return out


@pytest.mark.parametrize("branches", [1, 3])
def test_trees(spark, branches):
    rng = random.Random(branches)
    messages = []
    for tree in range(12):
        for i in range(rng.randint(1, 30)):
            parent = None if i == 0 else rng.randrange(max(0, i - 3), i)
            messages.append((tree, i, parent, rng.choice(("user", "assistant", "a\nb", None)), rng.choice(NASTY), rng.choice((None, *map(float, range(40))))))
    messages += [(50, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)]
    messages += [(51, i, 0 if i else None, "assistant", "x", float(i)) for i in range(200)]
    messages += [(52, 0, 99, "user", "orphan", 1.0), (52, 1, 1, "user", "own parent", 0.5)]
    cyclic = [(53, 0, 1, "user", "c", 1.0), (53, 1, 0, "user", "c", 1.0), (53, 2, 0, "user", "c", 1.0)]
    df = spark.createDataFrame(_rows(messages + cyclic), SCHEMA).repartition(5)
    formatted = replies.format_trees(df, branches).collect()
    expected = _best(messages, branches)
    assert {(r.tree, r.leaf): (r.rank, replies.parse(r.formatted)) for r in formatted} == expected
    for r in formatted:
        turns = expected[r.tree, r.leaf][1]
        assert replies.learnt(r.formatted, r.loss) == "".join(t for role, t in turns if role == "assistant")
        assert [replies.unescape(r.formatted[s.start : s.end]) for s in r.loss] == [t for role, t in turns if role == "assistant"]
        assert r.n_turns == len(turns) and not any(c in replies.unescape("") for c in replies.CONTROL)


def test_escapes(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    texts = NASTY + ["".join(rng.choice(["\\", *replies.CONTROL, "<", "|", "s>", "/", "\n", "INST]"]) for _ in range(12)) for _ in range(200)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", replies.escape(F.col("t")).alias("e")).collect():
        assert replies.unescape(r.e) == r.t and not any(c in r.e for c in replies.CONTROL)


def test_odd_rows(spark):
    rows = [(None, 0, None, None), (1, None, "user", None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 5, None, "x"), (None, 0, "assistant", "y")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, tree string, id int")
    got = {r.tree: r for r in replies.read_back(replies.format_trees(replies.message_trees(df))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {None: 2, 1: 4, 2: 1}
    assert got[1].content == "user\n\nuser\na\nuser\na\nuser\nb\n" and got[None].learnt == "y"
    empty = replies.read_back(replies.format_trees(replies.message_trees(df.limit(0))))
    assert empty.collect() == []
    alone = spark.createDataFrame(_rows([(1, None, None, "assistant", "p", 1.0), (1, None, None, "user", "q", 1.0), (1, 4, None, "user", None, None), (1, 4, None, "user", None, None)]), SCHEMA)
    assert sorted(replies.parse(r.formatted)[0] for r in replies.format_trees(alone, 2).collect()) == [("assistant", "p"), ("user", ""), ("user", "q")]
