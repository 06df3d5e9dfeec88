"""Scan, detect, backtest and compare window sizes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tapeforge.functions.ranking import quantiles
from tapeforge.operators.detection import cluster_events, score_windows, select_nonoverlapping, shape_score
from tapeforge.operators.forward import gap_columns, long_outcomes, outcomes_at, volatility_trend_steps
from tapeforge.operators.geometry import envelope_windows, with_apex, with_geometry
from tapeforge.session import cut_lineage

CARRY = ["ts", "close", "session_minute", "day_no", "vol_trend"]


def scan(indexed: DataFrame, length: int, fit_bars: int | None = None, stride: int = 1,
         scorer: Column | None = None, at: DataFrame | None = None, chunk: int | None = None) -> DataFrame:
    """Every window with geometry, containment, gaps, volatility trend and score: one shuffle of the bars."""
    fit = length if not fit_bars else min(fit_bars, length)
    fits = envelope_windows(indexed, length, fit_bars, stride, at=at, carry=CARRY,
                            carry_start=["ts", "day_no", "next_day_idx"], chunk=chunk,
                            features=volatility_trend_steps(length, fit_bars))
    out = with_apex(with_geometry(fits, fit), fit)
    out = gap_columns(out.withColumnsRenamed({"ts": "date_end", "ts_start": "date_start"}))
    out = out.withColumn("score", shape_score() if scorer is None else scorer)
    return out.drop("day_no", "day_no_start", "next_day_idx_start")


def detections(windows: DataFrame, threshold: float) -> DataFrame:
    return windows.where(F.col("score") >= threshold)


def detect_with_model(indexed: DataFrame, length: int, scorer: Callable[[np.ndarray], np.ndarray], threshold: float,
                      fit_bars: int | None = None, stride: int = 1, chunk: int | None = None) -> DataFrame:
    """Detections of an external batch model, with geometry fitted only where it fired.

    The hits are written once: they are few, and they both choose the windows to
    measure and carry the scores.
    """
    hits = cut_lineage(score_windows(indexed, length, scorer, stride, chunk).where(F.col("score") >= threshold))
    measured = scan(indexed, length, fit_bars, at=hits, chunk=chunk).drop("score")
    return measured.join(hits, ["symbol", "start_idx", "end_idx"])


def detect_top(indexed: DataFrame, length: int, threshold: float, top: int | None = 5, stride: int = 5,
               fit_bars: int | None = None, scorer: Column | None = None, chunk: int | None = None) -> DataFrame:
    """Best non-overlapping detections per symbol, in time order within a symbol."""
    hits = detections(scan(indexed, length, fit_bars, stride, scorer, chunk=chunk), threshold)
    slim = hits.select("symbol", "start_idx", "end_idx", "score", "date_start", "date_end")
    return select_nonoverlapping(slim, length, top, chunk=chunk)


def backtest(indexed: DataFrame, hits: DataFrame, horizons: list[int], digits: int | None = 3,
             chunk: int | None = None) -> DataFrame:
    """Detections joined to the outcome of their last bar. The hits are written once: they choose the bars to look at."""
    hits = cut_lineage(hits)
    return hits.join(outcomes_at(hits, indexed, horizons, digits, *([chunk] if chunk else [])), ["symbol", "end_idx"])


def backtest_summary(results: DataFrame, horizons: list[int], keys: list[str] | None = None) -> DataFrame:
    """Win rate, mean and median return and mean favourable excursion per horizon (bearish = win)."""
    keys = [*(keys or []), "horizon"]
    long = long_outcomes(results, [k for k in keys if k != "horizon"], horizons, ["ret", "mfe", "win"])
    done = long.where("win is not null")
    plain = done.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.col("win").cast("int")) * 100).alias("win_rate"),
        F.avg("ret").alias("avg_return"), F.avg("mfe").alias("avg_mfe"))
    return plain.join(quantiles(done, keys, ("ret", {"median_return": 0.5})), keys)


def compare_windows(indexed: DataFrame, sizes: list[int], threshold: float, horizons: list[int],
                    chunk: int | None = None) -> DataFrame:
    """Non-overlapping backtests of several window sizes, one column group per size."""
    parts = []
    for size in sizes:
        chosen = detect_top(indexed, size, threshold, top=None, stride=max(1, size // 25), chunk=chunk)
        res = cut_lineage(backtest(indexed, chosen, horizons, digits=None, chunk=chunk))
        parts.append(backtest_summary(res, horizons).withColumn("window_size", F.lit(size)))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    wide = both.groupBy("horizon").pivot("window_size", sizes).agg(
        F.first("win_rate").alias("win_rate"), F.first("avg_return").alias("avg_return"),
        F.first("n").alias("n"))
    names = [F.col(f"{s}_{f}").alias(f"{f}_{s}bar") for s in sizes for f in ("win_rate", "avg_return", "n")]
    return wide.select("horizon", *names)


def find_events(windows: DataFrame, length: int, threshold: float, chunk: int | None = None) -> DataFrame:
    """One event per overlapping group of detections: the peak window with all its measures."""
    return cluster_events(detections(windows, threshold), length, chunk)
