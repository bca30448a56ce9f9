"""Chat formatting of reply trees: paths by self-joins, branches ranked by score, one conversation per path.

Messages name the message they answer. Self-joins double the step from a message to its ancestors until every
message has met its root, which gives its depth and the score of its whole path in as many rounds as the
longest path has binary digits. A leaf is a branch; the best ``branches`` leaves of a tree by mean score are
kept, and their paths are enumerated by self-joins in the other direction: a run of messages is halved, from the
widest step to the narrowest, until every message of the path stands alone. Only keys travel through these
rounds; texts meet their paths once, and the running place of each turn comes from one ordered window.

Template: ``<|turn|>`` role, line end, text, ``<|end|>`` and a line end. Inside texts and roles a backslash is
doubled and every control string is broken by a backslash behind its first character, so control strings of
this and of other templates never occur in an escaped text; line ends of a role get a backslash as well.

Defined results: null texts and roles are empty ones; messages without id, tree or an existing parent in
their tree are roots; of repeated rows of one id the first by parent, role, text and score counts; messages
on a cycle have no root and are in no path; ties of scores go to the smaller leaf id; other columns are not
looked at. One path is one output row, so a path must fit into a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscore.llm.common import slices, staged

TURN, END = "<|turn|>", "<|end|>"
# Control strings of common chat templates; every string that begins with <| is covered by the first.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")


def escape(text: Column) -> Column:
    """Text without any control string, reversibly."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def message_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: each turn answers the one before.

    Turns with the same number are ordered by role and text; rows without ``conv_id`` are one conversation.
    """
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.row_number().over(order).cast("long") - 1
    return rows.select("tree", at.alias("id"), "role", "text").withColumn("parent", F.when(F.col("id") > 0, F.col("id") - 1)).withColumn("score", F.lit(0.0))


def _links(messages: DataFrame) -> DataFrame:
    """``tree, id, parent, score`` with a parent only where it exists."""
    keys = messages.select("tree", "id", "parent", "score")
    there = keys.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there")).distinct()
    same = F.col("k.tree").eqNullSafe(F.col("p.tree")) & (F.col("k.parent") == F.col("p.parent"))
    found = keys.alias("k").join(there.alias("p"), same, "left")
    return found.select("k.tree", "k.id", F.when(F.col("p.there") & (F.col("k.parent") != F.col("k.id")), F.col("k.parent")).alias("parent"), F.coalesce("k.score", F.lit(0.0)).alias("score"))


def _ancestors(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``tree, id, depth, total`` (score of the path from the root) of all messages with a root, and the step tables.

    Table ``j`` leads each message of depth ``2**j`` or more to its ancestor ``2**j`` steps above.
    """
    # `up` is the ancestor reached, `n` the messages passed and `total` their score; a message with no `up` has met its root.
    now, steps = staged(links.select("tree", "id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("n"), F.col("score").alias("total"))), []
    messages = now.count()
    # No path is longer than all messages: what is left then is a cycle.
    while 1 << len(steps) <= messages and not now.filter("up is not null").isEmpty():
        active, rooted = now.filter("up is not null"), now.filter("up is null")
        steps.append(active.select("tree", "id", "up"))
        above = now.select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("n").alias("m"), F.col("total").alias("more"))
        same = F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.up"))
        further = active.alias("a").join(above.alias("b"), same).select("a.tree", "a.id", F.col("b.next").alias("up"), (F.col("n") + F.col("m")).alias("n"), (F.col("total") + F.col("more")).alias("total"))
        now = staged(further.unionByName(rooted))
    return now.filter("up is null").drop("up").withColumnRenamed("n", "depth"), steps


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``tree, leaf, rank, at, id``: the messages of the best ``branches`` root-to-leaf paths of each tree, from the root on."""
    links = staged(_links(messages))
    rooted, steps = _ancestors(links)
    answered = links.filter("parent is not null").select("tree", F.col("parent").alias("id")).distinct()
    same = F.col("r.tree").eqNullSafe(F.col("p.tree")) & (F.col("r.id") == F.col("p.id"))
    leaves = rooted.alias("r").join(answered.alias("p"), same, "left_anti")
    order = W.partitionBy("tree").orderBy(F.desc("mean"), "id")
    best = leaves.withColumn("mean", F.col("total") / F.col("depth")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= branches)
    # A run is `n` messages that end at `id`, `at` being the place of its first one.
    runs = best.select("tree", F.col("id").alias("leaf"), "rank", F.col("id").alias("end"), F.col("depth").alias("n"), F.lit(0).cast("long").alias("at"))
    for j in range(len(steps) - 1, -1, -1):
        long = F.col("n") > (1 << j)
        up = steps[j].select("tree", F.col("id").alias("end"), "up")
        same = F.col("r.tree").eqNullSafe(F.col("s.tree")) & (F.col("r.end") == F.col("s.end"))
        cut = runs.filter(long).alias("r").join(up.alias("s"), same).select("r.tree", "leaf", "rank", "r.end", "up", "n", "at")
        first = F.struct(F.col("up").alias("end"), (F.col("n") - (1 << j)).alias("n"), F.col("at").alias("at"))
        last = F.struct(F.col("end").alias("end"), F.lit(1 << j).cast("long").alias("n"), (F.col("at") + F.col("n") - (1 << j)).alias("at"))
        halves = cut.select("tree", "leaf", "rank", F.explode(F.array(first, last)).alias("run")).select("tree", "leaf", "rank", "run.end", "run.n", "run.at")
        runs = staged(runs.filter(~long).unionByName(halves))
    return runs.select("tree", "leaf", "rank", "at", F.col("end").alias("id"))


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Per chosen path: ``tree, leaf, rank, n_turns, formatted, loss``.

    ``messages`` has ``tree, id, parent, role, text, score``. ``loss`` lists the spans (code points of
    ``formatted``, end exclusive) of the texts of assistant turns.
    """
    cols = ("tree", "id", "parent", "role", "text", "score")
    plain = messages.select("tree", "id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    first = W.partitionBy("tree", "id").orderBy("parent", "role", "text", "score")
    once = plain.filter("id is not null").withColumn("k", F.row_number().over(first)).filter("k = 1").select(*cols)
    alone = plain.filter("id is null")
    once = staged(once)
    way = paths(once, branches)
    same = F.col("w.tree").eqNullSafe(F.col("m.tree")) & (F.col("w.id") == F.col("m.id"))
    turns = way.alias("w").join(once.alias("m"), same).select("w.tree", "leaf", "rank", "at", "role", "text")
    turns = turns.unionByName(alone.select("tree", F.lit(None).cast(once.schema["id"].dataType).alias("leaf"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("at"), "role", "text"))
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    body = escape(F.col("text"))
    # Rows without an id are paths of their own, told apart by a running number.
    own = F.when(F.col("leaf").isNull(), F.monotonically_increasing_id())
    turns = turns.select("tree", "leaf", "rank", "at", (F.col("role") == "assistant").alias("learnt"), head.alias("head"), body.alias("body"), own.alias("own"))
    size = F.length("head") + F.length("body") + len(END) + 1
    path = W.partitionBy("tree", "leaf", "own").orderBy("at")
    turns = turns.withColumn("start", F.sum(size).over(path) - F.length("body") - len(END) - 1)
    span = F.when(F.col("learnt"), F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.length("body")).cast("long").alias("end")))
    turn = F.struct("at", F.concat("head", "body", F.lit(f"{END}\n")).alias("turn"), span.alias("span"))
    grouped = turns.groupBy("tree", "leaf", "own").agg(F.first("rank").alias("rank"), F.array_sort(F.collect_list(turn)).alias("turns"))
    loss = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return grouped.select(
        "tree", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), loss.alias("loss"),
    )


_HEADER = re.compile(r"(?s)((?:[^\\\n]|\\.)*+)\n")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns, from the formatted text alone."""
    turns = []
    for part in formatted.split(f"{END}\n")[:-1]:
        if not part.startswith(TURN):
            raise ValueError("a turn without its mark")
        head = _HEADER.match(part, len(TURN))
        turns.append((unescape(head[1]), unescape(part[head.end() :])))
    return turns


def learnt(formatted: str, loss: list[dict]) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescape(formatted[s["start"] : s["end"]]) for s in loss)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per path, read from ``formatted`` and ``loss`` alone: ``tree, leaf, n_turns, content, learnt, formatted_chars``.

    ``content`` is role, line end, text and line end of each turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(pa.record_batch([b.column(c) for c in ("tree", "leaf", "text", "loss")], ["tree", "leaf", "text", "loss"]) for b in batches):
            texts, spans = batch.column("text").to_pylist(), batch.column("loss").to_pylist()
            turns = [parse(t) for t in texts]
            yield pa.record_batch(
                {
                    "tree": batch.column("tree"),
                    "leaf": batch.column("leaf"),
                    "n_turns": pa.array([len(t) for t in turns], pa.int64()),
                    "content": pa.array(["".join(f"{role}\n{text}\n" for role, text in t) for t in turns], pa.string()),
                    "learnt": pa.array([learnt(t, s) for t, s in zip(texts, spans)], pa.string()),
                    "formatted_chars": pa.array([len(t) for t in texts], pa.int64()),
                }
            )

    kind = {f.name: f.dataType.simpleString() for f in formatted.schema}
    rows = formatted.select("tree", "leaf", F.col("formatted").alias("text"), "loss")
    return rows.mapInArrow(run, f"tree {kind['tree']}, leaf {kind['leaf']}, n_turns bigint, content string, learnt string, formatted_chars bigint")


def oracle() -> str:
    """Reference SQL of the registered query."""
    chars = "replace(x, '\\', '\\\\')"
    for c in CONTROL:
        chars = f"replace({chars}, '{c}', '{c[0]}\\{c[1:]}')"
    role, text = chars.replace("(x,", "(role,"), chars.replace("(x,", "(text,")
    extra = len(TURN) + len(END) + 2
    return f"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    )
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum({extra} + length(replace({role}, chr(10), '\\' || chr(10))) + length({text})) AS BIGINT) AS formatted_chars
    FROM rows GROUP BY conv_id"""
