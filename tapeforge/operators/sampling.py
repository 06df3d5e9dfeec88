"""Deterministic samples, shuffles and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeforge.functions.ranking import hash_rank
from tapeforge.schemas import TRAIN_FRACTION, VAL_FRACTION


def random_baseline(indexed: DataFrame, length: int, max_horizon: int, seed: int,
                    size: Column | int | None) -> DataFrame:
    """Random window ends per symbol without replacement, out of [length, n - horizon - 1).

    ``size`` is a number or an expression of ``n_bars`` per symbol; None takes every eligible bar.
    """
    pool = indexed.where((F.col("bar_idx") >= length) & (F.col("bar_idx") < F.col("n_bars") - max_horizon - 1))
    if size is None:
        return pool.select("symbol", F.col("bar_idx").alias("end_idx"))
    return (
        hash_rank(pool.select("symbol", "bar_idx", "n_bars"), seed, ["symbol", "bar_idx"], ["symbol"], limit=size)
        .select("symbol", F.col("bar_idx").alias("end_idx"))
    )


def random_windows(starts: DataFrame, size: int, seed: int) -> DataFrame:
    """``size`` random windows per symbol out of those given."""
    return hash_rank(starts, seed, ["symbol", "start_idx"], ["symbol"], limit=size).drop("hash_rank")


def random_per_category(events: DataFrame, size: int, seed: int, category: str = "category") -> DataFrame:
    """``size`` random events of every category, for review."""
    return hash_rank(events, seed, ["symbol", "start_idx"], [category], limit=size).drop("hash_rank")


def strided_baseline(indexed: DataFrame, warmup: int = 390, stride: int = 10) -> DataFrame:
    return indexed.where((F.col("bar_idx") >= warmup) & ((F.col("bar_idx") - warmup) % stride == 0))


def shuffled(manifest: DataFrame, seed: int, ids: list[str]) -> DataFrame:
    """Assign ``shuffled_idx`` 0..n-1 in seeded random order (replaces an existing one)."""
    return hash_rank(manifest.drop("shuffled_idx"), seed, ids, out="shuffled_idx")


def with_validation_split(shuffled_rows: DataFrame, fraction: float) -> DataFrame:
    """First int(n * fraction) rows of the shuffled order become validation."""
    n = shuffled_rows.agg(F.count(F.lit(1))).scalar()
    cut = F.floor(n * F.lit(float(fraction)))
    return shuffled_rows.withColumn(
        "split", F.when(F.col("shuffled_idx") < cut, "validation").otherwise("training"))


def with_corpus_slice(manifest: DataFrame, train: float = TRAIN_FRACTION, val: float = VAL_FRACTION) -> DataFrame:
    """train / val / eval by position; boundaries use floating sums (0.72 + 0.08 is just below 0.8)."""
    n = manifest.agg(F.count(F.lit(1))).scalar()
    idx = F.col("shuffled_idx")
    train_end = F.floor(n * F.lit(float(train)))
    val_end = F.floor(n * F.lit(float(train) + float(val)))
    return manifest.withColumn(
        "slice", F.when(idx < train_end, "train").when(idx < val_end, "val").otherwise("eval"))
