"""Fill-in-middle: texts cut at two token boundaries and put together around a gap.

The token ends of all texts of a slice are one ``BoundarySet`` over its bytes. A text's ``u``-th boundary is
the ``rank`` of its first byte plus ``u``; ``select`` returns both cut offsets of all texts at once. Draws are
hashed from the seed and ``doc_id``, so they do not depend on order or partitioning.

Defined results: null and empty texts are ``plain`` with no token and an empty output; a text without tokens
cannot occur otherwise, for blanks alone are one token; rows without ``doc_id`` draw as if the id were an empty
string; repeated rows are cut alike; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscore.llm import words as w
from pitscore.llm.boundaries import BoundarySet
from pitscore.llm.common import slices

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(seed: int, doc_id: str = "doc_id") -> list[Column]:
    """Four unsigned 32-bit numbers from the hex sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def token_ends(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sorted distinct byte positions of all text starts, text ends and token ends.

    A token is blanks with the word behind them, or the blanks that end a text: tokens end where words end and
    where texts end.
    """
    gap = w.SPACE[raw]
    end = np.zeros(len(raw) + 1, bool)
    end[1:-1] = ~gap[:-1] & gap[1:]
    end[off] = True
    return np.flatnonzero(end)


def _cut(batches: Iterator[pa.RecordBatch], rate: int, spm: int) -> Iterator[pa.RecordBatch]:
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for batch in slices(batches):
        texts = batch.column("text")
        raw, off = w.text_bytes(texts)
        ends = BoundarySet(token_ends(raw, off))
        first = ends.rank(off)
        n = np.diff(first)
        h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
        marked = np.zeros(len(n), bool)
        for m in (PREFIX, SUFFIX, MIDDLE):
            marked |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        plain = (n == 0) | marked | (h3 % 100 >= rate)
        a, b = h1 % (n + 1), h2 % (n + 1)
        start, stop = ends.select(first[:-1] + np.minimum(a, b)), ends.select(first[:-1] + np.maximum(a, b))
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        form = np.where(plain, "plain", np.where(h4 % 100 < spm, "spm", "psm"))
        data, out = raw.tobytes(), []
        for i, kind in enumerate(form.tolist()):
            x, y, z, e = int(off[i]), int(start[i]), int(stop[i]), int(off[i + 1])
            if kind == "plain":
                out.append(data[x:e])
            elif kind == "psm":
                out.append(b"".join((marks[0], data[x:y], marks[1], data[z:e], marks[2], data[y:z])))
            else:
                out.append(b"".join((marks[1], data[z:e], marks[0], data[x:y], marks[2], data[y:z])))
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n": pa.array(n),
                "form": pa.array(form.tolist(), pa.string()),
                "prefix_chars": pa.array(points[start] - points[off[:-1]], mask=plain),
                "middle_chars": pa.array(points[stop] - points[start], mask=plain),
                "output": pa.array(out, pa.binary()).cast(pa.string()),
            }
        )


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Per row: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``rate`` of 100 documents are transformed, ``spm`` of 100 of those with the suffix first.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", *draws(seed))
    schema = f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return rows.mapInArrow(lambda batches: _cut(batches, rate, spm), schema)


def restore(output: Column, form: Column) -> Column:
    """The text, rebuilt from an output and its form alone; marks do not occur in transformed texts."""
    behind = lambda m: F.substring_index(output, m, -1)
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    psm = F.concat(between(PREFIX, SUFFIX), behind(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), behind(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def oracle() -> str:
    """Reference SQL of the registered query."""
    token = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
    hashed = ", ".join(f"CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""
    WITH rows AS (
      SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
    ), drawn AS (
      SELECT doc_id, t, regexp_extract_all(t, '{token}') AS units, {hashed} FROM rows
    ), cut AS (
      SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
        greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
      FROM drawn
    ), parts AS (
      SELECT doc_id, t, n, form, coalesce(array_to_string(units[1:a], ''), '') AS p,
        coalesce(array_to_string(units[a + 1:b], ''), '') AS m, coalesce(array_to_string(units[b + 1:], ''), '') AS s
      FROM cut
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n, form,
      CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
      sha256(t) AS restored_sha256
    FROM parts"""
