"""Small made-up corpora and brute-force helpers."""

from __future__ import annotations

import random
import re

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SYLLABLES = "an er th in on re ti es or ou ha nd ñe éa ü".split()


def lower(text: str) -> str:
    return text.translate({i: i + 32 for i in range(65, 91)})


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize()


def prose(rng: random.Random, n: int) -> str:
    return ". ".join(sentence(rng, rng.randint(4, 14)) for _ in range(n)) + "."


#: Odd rows: null and empty texts, white space, a long text, repeated rows, no id, quotes, other scripts.
def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    long = prose(rng, 4000)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, long), (5, "word"), (6, "Two words"), (7, prose(rng, 8)), (7, None), (8, "a" * 30_000),
        (9, long), (9, long), (None, "no id here, none at all"), (None, None), (10, "x, " * 3000), (11, "漢字 и кириллица \U0001f600 \x00 end."), (12, "'quoted' \"text\" | a,b"),
    ]


CLASHES = (
    "n", "cls", "sig", "text_crc32", "shard", "slot", "_part", "_at", "blob", "findings", "items", "n_words", "n_hit", "score", "block", "word", "uid",
    "symbol", "identifiers", "licenses", "start", "length", "bucket", "edge", "held_out", "toxic", "component",
)


def documents(spark, rows: list[tuple], clash: bool = True):
    """``doc_id, text, lang, source, n_chars`` and, if asked for, columns named like helper columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df = df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    return df.select("*", *[F.lit("other").alias(c) for c in CLASHES]) if clash else df
