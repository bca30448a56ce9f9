"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every text is addressed by the hash of its content. The ledger, a Parquet folder, holds for each blob the
rule versions that have scanned it and what they found. A scan reads the texts of blobs with unseen rule
versions alone, one copy of each, appends to the ledger and joins the findings back to all rows.

Positions are code points, end exclusive: the pieces between matches, from ``split``, and the matches,
from ``regexp_extract_all``, alternate, so running sums of their lengths are the spans.

Defined results: a null text counts as empty and has no findings; repeated rows and equal texts share
one scan; rows without ``doc_id`` are scanned like others; columns of the input named ``blob`` or
``findings`` are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscore.llm import common
from pitscore.session import scratch_dir


@dataclass(frozen=True)
class Rule:
    """``name@version``; a match counts if ``group`` has ``least`` code points or more."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs are maximal, so a run below the least length may as well not match at all.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Up to the END line if that has the next five dashes; else headers, base64 lines and a short last line, also
# commented, quoted or with line ends written as \\n. Groups repeat possessively, which Java does without recursion.
_GAP = r"""(?:\\[rn]|[\s"'+,;>#*|/\\])"""
_KEY = rf"""(?:{_GAP}*+[A-Z][A-Za-z-]{{1,30}}:\x20[^\r\n\\]*+)*+(?:{_GAP}*+[A-Za-z0-9+/=]{{16,}}+(?![A-Za-z0-9+/=_.:-]))++(?:{_GAP}*+[A-Za-z0-9+/=]++(?=[\x20\t"',;+]*+(?:[\r\n\\]|\z))){{0,2}}+"""
MORE_RULES = (
    Rule("private_key", rf"-----BEGIN [A-Z0-9 ]{{0,40}}PRIVATE KEY(?: BLOCK)?-----(?:(?>[\s\S]*?(?=-----))-----END [A-Z0-9 ]{{0,40}}PRIVATE KEY(?: BLOCK)?-----|{_KEY})?+", version=2),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("url_password", r"://[^\x20\x09-\x0D:/@]{1,256}:[^\x20\x09-\x0D/@]{1,256}@"),
)
RULES = BASE_RULES + MORE_RULES
FINDINGS = "array<struct<kind:string,start:bigint,end:bigint>>"
#: In the ledger a finding carries the key of its rule, so those of other versions are told apart.
_LEDGER = "array<struct<rule:string,kind:string,start:bigint,end:bigint>>"
_NONE = f"cast(array() as {FINDINGS})"


#: Hits of one text whose places are summed together.
CHUNK = 128


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _found(text: Column, rule: Rule, order: int) -> Column:
    """Findings of one rule with their place for sorting: ``start, order, end, kind``."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    rows = F.arrays_zip(F.split(text, rule.pattern, -1).alias("piece"), hits.alias("hit"), sized.alias("value"))
    width = lambda r: (F.length(r["piece"]) + F.length(r["hit"])).cast("long")
    span = lambda at, r: F.struct(
        (at + F.length(r["piece"])).alias("start"), F.lit(order).alias("ord"), (at + width(r)).alias("end"), F.lit(rule.name).alias("kind"), F.length(r["value"]).alias("size")
    )
    zero = F.lit(0).cast("long")

    def placed(chunk: Column, at: Column) -> Column:
        none = F.expr("cast(array() as array<struct<start:bigint,ord:int,end:bigint,kind:string,size:int>>)")
        step = lambda s, r: F.struct((s["at"] + width(r)).alias("at"), F.concat(s["out"], F.array(span(s["at"], r))).alias("out"))
        return F.aggregate(chunk, F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"])

    def in_chunks(hits: Column) -> Column:
        """Running places: of whole chunks first, then inside each, so no long list is copied for each hit."""
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / CHUNK).cast("int")), lambda j: F.slice(hits, j * CHUNK + 1, CHUNK))
        ends = lambda c: F.aggregate(
            F.transform(c, lambda x: F.aggregate(x, zero, lambda s, r: s + width(r))),
            F.struct(zero.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out")),
            lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
            lambda s: s["out"],
        )
        return _bound(chunks, lambda c: F.flatten(F.zip_with(c, ends(c), placed)))

    spans = F.filter(_bound(F.filter(rows, lambda r: r["hit"].isNotNull()), in_chunks), lambda x: x["size"] >= rule.least)
    return F.when(text.rlike(rule.pattern), spans)


def findings(text: Column, rules: tuple[Rule, ...], pending: Column | None = None) -> Column:
    """All findings of the rules (those in ``pending`` only), by start, then in the order of the rules."""
    parts = []
    for i, rule in enumerate(rules):
        found = _found(text, rule, i)
        parts.append(F.coalesce(found if pending is None else F.when(F.array_contains(pending, rule.key), found), F.expr("cast(array() as array<struct<start:bigint,ord:int,end:bigint,kind:string,size:int>>)")))
    return F.transform(F.array_sort(F.concat(*parts)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def new_ledger(spark) -> str:
    """Folder for a ledger of this application, in the shared folder."""
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/ledger-{uuid.uuid4().hex}"
    spark.createDataFrame([], f"blob string, rules array<string>, findings {_LEDGER}").write.parquet(path)
    common._WRITTEN.append(path)
    return path


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """``docs`` with ``blob`` and ``findings``; unseen pairs of blob and rule version are scanned and recorded."""
    spark = docs.sparkSession
    ledger = ledger or new_ledger(spark)
    keys = F.array(*[F.lit(r.key) for r in rules])
    names = [c for c in docs.columns if c not in ("blob", "findings")]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*[f"`{c}`" for c in names]).withColumn("blob", F.sha2(text, 256))
    known = spark.read.parquet(ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    pending = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
    heads = rows.groupBy("blob").agg(F.min("doc_id").alias("head")).join(known, "blob", "left").select("blob", "head", pending.alias("pending")).filter(F.size("pending") > 0)
    heads = heads.select(F.col("blob").alias("_blob"), "head", "pending")
    texts = rows.select("doc_id", "text", "blob").join(heads.hint("shuffle_hash"), (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("head")))
    key_of = F.map_from_arrays(F.array(*[F.lit(r.name) for r in rules]), keys)
    keyed = F.transform(findings(text, rules, F.col("pending")), lambda x: F.struct(F.element_at(key_of, x["kind"]).alias("rule"), x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    fresh = texts.select("blob", F.col("pending").alias("rules"), keyed.alias("findings"))
    fresh.dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    current = spark.read.parquet(ledger).select("blob", F.explode("findings").alias("f")).filter(F.col("f.rule").isin([r.key for r in rules]))
    found = current.groupBy("blob").agg(F.collect_set(F.struct("f.kind", "f.start", "f.end")).alias("found"))
    order = F.map_from_arrays(F.array(*[F.lit(r.name) for r in rules]), F.array(*[F.lit(i) for i in range(len(rules))]))
    listed = F.transform(
        F.array_sort(F.transform("found", lambda x: F.struct(x["start"], F.element_at(order, x["kind"]), x["end"], x["kind"].alias("kind"), x.alias("f")))), lambda x: x["f"]
    )
    return rows.join(found.select("blob", listed.alias("findings")), "blob", "left").select(
        *[f"`{c}`" for c in names], "blob", F.coalesce("findings", F.expr(_NONE)).alias("findings")
    )


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every found span replaced; overlapping spans share one mark."""
    state = F.aggregate(
        found,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(x["end"].alias("at"), F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark)).alias("out")),
        ).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))),
        lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(found) > 0, state).otherwise(text)
