"""Labelled window sets: planning, mining negatives, splits and composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeforge.functions.ranking import quantiles
from tapeforge.operators.geometry import channel_positions
from tapeforge.operators.indexing import window_starts
from tapeforge.operators.sampling import shuffled, with_validation_split
from tapeforge.operators.windows import normalised_windows

CHANNEL_SLACK = 0.30


def corpus_plan(families: DataFrame, positive: str) -> DataFrame:
    """(type, original_idx, label) rows from a table of (type, n); the positive family must be present."""
    if families.where(F.col("type") == positive).isEmpty():
        raise ValueError(f"positive family {positive!r} is not in the plan")
    rows = families.where("n > 0").select(
        "type", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("original_idx"))
    return rows.withColumn("label", (F.col("type") == positive).cast("int"))


def relabel(manifest: DataFrame, positive: str) -> DataFrame:
    """Make another family the positive class; an absent family is an error."""
    if manifest.where(F.col("type") == positive).isEmpty():
        raise ValueError(f"family {positive!r} is not in this corpus")
    return manifest.withColumn("label", (F.col("type") == positive).cast("int"))


def confirmed_negative(indexed: DataFrame, length: int, stride: int, rule: str = "reference",
                       chunk: int | None = None) -> DataFrame:
    """Every ``stride``-th window with ``negative``: whether it cannot be a rising wedge.

    A window is a possible wedge only if both slopes rise, the lines pass the
    convergence test and all closes stay within 30% of the channel through the
    first bar. ``rule='reference'`` tests slope_high > slope_low, the rule as
    published; 'corrected' tests that the lines really close in.
    """
    if rule not in ("reference", "corrected"):
        raise ValueError(f"rule must be 'reference' or 'corrected', got {rule!r}")
    closing = (F.col("slope_high") > F.col("slope_low") if rule == "reference"
               else F.col("slope_low") > F.col("slope_high"))
    possible = ((F.col("slope_high") > 0) & (F.col("slope_low") > 0) & closing
                & (F.col("rel_min") >= -CHANNEL_SLACK) & (F.col("rel_max") <= 1 + CHANNEL_SLACK))
    return channel_positions(indexed, length, stride, chunk).withColumn("negative", ~possible)


def mine_negatives(indexed: DataFrame, length: int, stride: int, val_fraction: float, seed: int,
                   rule: str = "reference", check: bool = True) -> DataFrame:
    """Manifest rows of confirmed negatives, shuffled and split."""
    starts = (confirmed_negative(indexed, length, stride, rule).where("negative").select("symbol", "start_idx", "end_idx")
              if check else window_starts(indexed, length, stride))
    order = shuffled(starts, seed, ["symbol", "start_idx"])
    times = indexed.select("symbol", "bar_idx", "ts")
    split = with_validation_split(order, val_fraction)
    return (
        split.join(times.select("symbol", F.col("bar_idx").alias("start_idx"), F.col("ts").alias("date_start")),
                   ["symbol", "start_idx"])
        .join(times.select("symbol", F.col("bar_idx").alias("end_idx"), F.col("ts").alias("date_end")),
              ["symbol", "end_idx"])
        .select(F.lit(0).alias("label"), F.lit("real_negative").alias("type"), "symbol", "start_idx", "end_idx",
                "shuffled_idx", "split", "date_start", "date_end")
    )


def corpus_rows(indexed: DataFrame, negatives: DataFrame, length: int) -> DataFrame:
    """Corpus table rows of mined windows: normalised bars, no trendlines, label 0."""
    starts = negatives.select("symbol", "start_idx", "end_idx")
    bars = normalised_windows(indexed, starts, length)
    ids = negatives.select("symbol", "start_idx", F.col("shuffled_idx").alias("window_id"), "type", "split")
    return bars.join(ids, ["symbol", "start_idx"]).select(
        "window_id", "type", "split", F.col("pos").alias("bar"),
        *[F.col(c).cast("float").alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.lit(None).cast("float").alias("lower_trendline"), F.lit(None).cast("float").alias("upper_trendline"),
        F.lit(0).cast("tinyint").alias("segment"), F.lit(0).cast("tinyint").alias("label"))


def merge_manifests(manifest: DataFrame, extra: DataFrame, seed: int, ids: list[str]) -> DataFrame:
    """Append rows and reshuffle everything."""
    return shuffled(manifest.unionByName(extra, allowMissingColumns=True), seed, ids)


def composition(manifest: DataFrame) -> DataFrame:
    """Rows and fraction by split and label with all subtotals ('all')."""
    n = manifest.agg(F.count(F.lit(1))).scalar()
    cube = manifest.cube("split", "label").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("split").alias("_s"), F.grouping("label").alias("_l"))
    return cube.select(F.when(F.col("_s") == 1, "all").otherwise(F.col("split")).alias("split"),
                       F.when(F.col("_l") == 1, "all").otherwise(F.col("label").cast("string")).alias("label"),
                       "n", (F.col("n") / n).alias("fraction"))


def class_weights(manifest: DataFrame) -> DataFrame:
    """Balanced weights n / (2 n_c)."""
    n = manifest.agg(F.count(F.lit(1))).scalar()
    return manifest.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "weight", n / (F.lit(2.0) * F.col("n")))


def parameter_spread(meta: DataFrame, keys: list[str], params: list[str]) -> DataFrame:
    """p5, median and p95 of shape parameters per family."""
    rows = F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in params])
    long = meta.select(*keys, F.explode(rows).alias("_p")).select(*keys, "_p.*")
    return quantiles(long, [*keys, "param"], ("value", {"p5": .05, "p50": .5, "p95": .95}))


def best_epoch(log: DataFrame, metric: str = "val_auc", keys: list[str] | None = None) -> DataFrame:
    """The row with the highest metric, the first epoch on ties."""
    best = F.max_by(F.struct(*[F.col(c) for c in log.columns if c not in (keys or [])]),
                    F.struct(F.col(metric), -F.col("epoch")))
    grouped = log.groupBy(*keys) if keys else log.groupBy()
    return grouped.agg(best.alias("_b")).select(*(keys or []), "_b.*")


def slice_rows(manifest: DataFrame, first: Column, last: Column) -> DataFrame:
    """Rows of a shuffled manifest by position; a filter, not a sort."""
    return manifest.where((F.col("shuffled_idx") >= first) & (F.col("shuffled_idx") < last))
