"""Labelled window corpora and their manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeforge.schemas import FEATURE_COLS, MANIFEST


def read_corpus(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Model columns of the corpus table; a split filter prunes partitions."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(df["split"] == split)
    return df.select("window_id", "bar", *FEATURE_COLS, "label")


def write_corpus(df: DataFrame, path: str) -> None:
    """One table partitioned by split and type instead of one file per window."""
    df.write.mode("overwrite").partitionBy("split", "type").parquet(path)


def read_manifest(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """JSON manifest: one object per line, or one array per file. Order is ``shuffled_idx``, not the file's."""
    return spark.read.schema(MANIFEST).option("multiLine", array_file).json(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
