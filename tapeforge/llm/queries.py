"""The registered queries of the package and the SQL that must give their rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeforge.llm import (conversations, decontaminate, line_dedup, online_packing, oracles, packing, pii, quality,
                           simhash, spelling, token_files, toxicity, url_filter, warc)
from tapeforge.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HELD_OUT = "pmod(crc32(cast(doc_id as string)), 4) = 2"


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(table(spark, sf, "documents"))


URL_RULES = [url_filter.Rule(*r.split()) for r in (
    "allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")]


@query()
def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf, "pages"), URL_RULES)


@query()
def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query()
def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each line that an earlier one of the corpus repeats."""
    return line_dedup.repeats(table(spark, sf, "documents"))


@query()
def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.measure(table(spark, sf, "documents"))


@query()
def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    index = token_files.write(table(spark, sf, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, index, folder)


@query()
def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each contaminated document and test item; a document without a row is clean."""
    return decontaminate.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = warc.write(table(spark, sf, "pages"), folder)
    return warc.read(spark, index, folder).drop("url")


@query()
def op9_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    parts = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packing.pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def toxicity_model(docs: DataFrame, spark: SparkSession, sf: str) -> toxicity.ToxicityModel:
    """Learned from the labelled rows outside the held-out quarter."""
    return toxicity.learn(docs, table(spark, sf, "labels").where(f"not ({HELD_OUT})"))


@query()
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, spark, sf))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query(oracles.OP11)
def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage."""
    rows = table(spark, sf, "conversations")
    return conversations.repair(conversations.damaged(rows), rows)


@query()
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Every word with its near words and its form."""
    return spelling.variants(table(spark, sf, "documents"))


@query()
def op13_online_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every document with its place."""
    return online_packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


# --- the columns of the queries above that SQL can state, for comparison ---------------------

@query(oracles.BASE_PII)
def base_pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    return op1_pii(spark, sf).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


@query(oracles.BASE_URL)
def base_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    return op2_url_filter(spark, sf).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


@query(oracles.BASE_QUALITY)
def base_quality_counts(spark: SparkSession, sf: str) -> DataFrame:
    return op5_quality_rules(spark, sf).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@query(oracles.BASE_WARC)
def base_warc_records(spark: SparkSession, sf: str) -> DataFrame:
    return op8_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("double"))


@query(oracles.OP12)
def base_spelling_forms(spark: SparkSession, sf: str) -> DataFrame:
    """All of op12, its one column of whole numbers with nulls as a double, which both engines hand over alike."""
    return op12_spelling_variants(spark, sf).withColumn("form_n", F.col("form_n").cast("double"))
