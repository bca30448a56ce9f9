"""Registered queries of the numbered operators, with reference SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitscore.llm import decontamination, fingerprints, infill, licenses, lmscore, neardedup, packing, phrases, replies, secrets, sharding, substrings, toxicity
from pitscore.llm.common import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.occurrences(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), decontamination.contaminated().alias("contaminated"), "items",
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", *[F.array_join(c, ",").alias(c) for c in ("identifiers", "licenses", "families")])


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.name for r in secrets.BASE_RULES]
    base = F.filter("findings", lambda x: x["kind"].isin(kinds))
    count = [F.size(F.filter("findings", _of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return rows.select("doc_id", *count, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("findings")).alias("spans"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    return sharding.uniform_shards(rows, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending"
    )


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.match(docs, fingerprints.lexicon(docs))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    messages = replies.message_trees(rows.select(*own.columns).unionByName(own))
    back = replies.read_back(replies.format_trees(messages))
    return back.select(
        F.col("tree").alias("conv_id"), "n_turns", F.sha2("content", 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_ALL = (
    op1_near_duplicates, op2_packing, op3_decontamination, op4_licenses, op5_secrets, op6_lm_scores, op7_sharding, op8_toxicity,
    op9_substrings, op10_fingerprints, op11_chat, op12_phrases, op13_infill,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op4_licenses": licenses.oracle(), "op11_chat": replies.oracle(), "op12_phrases": phrases.oracle(), "op13_infill": infill.oracle()}
