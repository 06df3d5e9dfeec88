"""Binning and histograms with the edge rules of the numeric library they replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def linear_edges(low: float, high: float, count: int) -> list[float]:
    """``count`` evenly spaced edges, both ends included."""
    step = (high - low) / (count - 1)
    return [low + step * i for i in range(count - 1)] + [high]


def bin_by_edges(col: Column, edges: list[float], close_last: bool = True) -> Column:
    """0-based left-closed bin of ``col``; null outside. The last bin may include its right edge."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        right = edges[i + 1]
        last = close_last and i == len(edges) - 2
        inside = (col >= F.lit(float(edges[i]))) & ((col <= F.lit(right)) if last else (col < F.lit(right)))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def even_bin(col: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin of ``col`` among ``bins`` equal bins of [low, high], last one closed."""
    raw = F.floor(F.try_divide(col - low, high - low) * bins).cast("int")
    return F.when((col >= low) & (col <= high), F.least(raw, F.lit(bins - 1)))


def histogram(df: DataFrame, keys: list[str], value: str, low: Column, high: Column, bins: int) -> DataFrame:
    """Counts and density per bin; low/high may be literals or columns of ``df``."""
    d = df.withColumn("bin", even_bin(F.col(value), low, high, bins)).withColumn("_w", (high - low) / bins)
    counts = d.where("bin is not null").groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.max("_w").alias("_w"))
    # At most ``bins`` rows per key remain, so this window is small.
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("density", F.try_divide(F.col("n"), total * F.col("_w"))).drop("_w")


def clipped(col: Column, bound: Column) -> Column:
    return F.greatest(F.least(col, bound), -bound)
