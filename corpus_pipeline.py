"""Documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeforge.llm import decontaminate, near_copies, pii, queries, toxicity
from tapeforge.session import cut_lineage

TOXIC_FROM = 0.3  # score from which a document is rejected


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is learned from the labelled documents that the stage is given."""
    return toxicity.reject(docs, queries.toxicity_model(docs, spark, sf_dir), TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.packed(docs)


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies),
          ("benchmark decontamination", drop_contaminated), ("pii", mask_personal_data), ("best-fit packing", pack)]
ORACLE_SQL = None  # compression, seeded hashing, tokenizers and genetic search have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read back as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
