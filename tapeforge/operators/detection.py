"""Scoring windows and reducing overlapping hits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tapeforge.operators.windows import chunk_for, owned, scaled_windows, spread
from tapeforge.schemas import FEATURE_COLS
from tapeforge.session import cut_lineage


def shape_score(per_convergence: float = 0.5, per_touch: float = 0.6, usual_touches: int = 5) -> Column:
    """Default scorer: a logistic of convergence and of the weaker side's touches.

    Our own stand-in for an external model; any Column over the window features
    or a batch function (see ``score_windows``) can take its place.
    """
    conv = F.greatest(F.least(F.col("convergence"), F.lit(2.0)), F.lit(-2.0))
    touches = F.least(F.col("touch_up"), F.col("touch_lo"))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(conv * per_convergence + (touches - usual_touches) * per_touch)))


def score_windows(indexed: DataFrame, length: int, scorer: Callable[[np.ndarray], np.ndarray],
                  stride: int = 1, chunk: int | None = None, batch: int = 5000) -> DataFrame:
    """Score full windows with a batch function (b, length, 5) -> (b,) on normalised bars.

    The function is shipped once per task; windows are views on one chunk, so
    memory is bounded by ``batch``. Load a model inside ``scorer`` on first call.
    """
    chunk = chunk or chunk_for(length)
    schema = "symbol string, start_idx bigint, end_idx bigint, score double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx", ignore_index=True)
        idx = pdf["bar_idx"].to_numpy()
        start = idx - length + 1
        ends = np.flatnonzero((idx // chunk == pdf["chunk"].iloc[0]) & (np.arange(len(idx)) >= length - 1)
                              & (start % stride == 0))
        scores = np.empty(len(ends))
        if len(ends):
            view = sliding_window_view(pdf[FEATURE_COLS].to_numpy(np.float64), length, axis=0)
        for i in range(0, len(ends), batch):
            scores[i:i + batch] = scorer(scaled_windows(view[ends[i:i + batch] - length + 1].transpose(0, 2, 1)))
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "start_idx": start[ends], "end_idx": idx[ends],
                             "score": scores})

    bars = spread(indexed.select("symbol", "bar_idx", *FEATURE_COLS), chunk, back=length)
    return bars.groupBy("symbol", "chunk").applyInPandas(run, schema)


def cluster_events(detections: DataFrame, max_length: int, chunk: int | None = None) -> DataFrame:
    """One row per group of overlapping detections: the peak score, first window on ties.

    A detection opens a group when no earlier one reaches it. Earlier ones that
    could start within ``max_length``, so a chunk with that halo decides locally.
    Group ids are carried across chunks through one row per (symbol, chunk); the
    final reduction is a plain aggregation with map-side combine, so a group of
    any size is fine.
    """
    chunk = chunk or chunk_for(max_length)
    payload = detections.columns
    order = Window.partitionBy("symbol", "chunk").orderBy("start_idx", "end_idx")
    reach = F.max("end_idx").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = (
        spread(detections, chunk, back=max_length, pos="start_idx")
        .withColumn("_open", F.coalesce(F.col("start_idx") > reach, F.lit(True)))
        .where(owned(chunk, "start_idx"))
    )
    local = F.max(F.when(F.col("_open"), F.col("start_idx"))).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    flagged = flagged.withColumn("_local", local)
    # One row per occupied chunk: bounded by the clock, not by the detections.
    last = flagged.groupBy("symbol", "chunk").agg(
        F.max(F.when(F.col("_open"), F.col("start_idx"))).alias("_last"))
    earlier = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("symbol", "chunk", F.max("_last").over(earlier).alias("_carry"))
    grouped = (
        flagged.join(carry, ["symbol", "chunk"])
        .withColumn("event_start", F.coalesce("_local", "_carry"))
    )
    # -start_idx prefers the first of equal scores.
    best = F.max_by(F.struct(*payload), F.struct(F.col("score"), -F.col("start_idx")))
    return (
        grouped.groupBy("symbol", "event_start")
        .agg(best.alias("_peak"), F.count(F.lit(1)).alias("n_windows"), F.max("end_idx").alias("event_end"))
        .select("_peak.*", "event_start", "event_end", "n_windows")
    )


_OPEN, _TAKEN, _DROPPED = 0, 1, 2
LONGEST_CHUNK = 1 << 18


def _resolve(pdf: pd.DataFrame, length: int, low: int, high: int, own_low: int, own_high: int) -> pd.DataFrame:
    """Decide what can be decided inside one visible stretch of starts [low, high).

    In priority order a window is dropped next to a taken one, stays open next
    to an open one or when a neighbour may be out of sight, and is taken otherwise.
    """
    pdf = pdf.sort_values(["_state", "score", "start_idx"], ascending=[False, False, True], ignore_index=True)
    starts, known = pdf["start_idx"].to_numpy(), pdf["_state"].to_numpy()
    state = np.full(high - low + 2 * length, -1, dtype=np.int8)
    out = np.empty(len(pdf), dtype=np.int32)
    for i, (s, k) in enumerate(zip(starts, known)):
        p = s - low + length
        near = state[p - length + 1:p + length]
        if k == _TAKEN:
            out[i] = _TAKEN
        elif (near == _TAKEN).any():
            out[i] = _DROPPED
        elif (near == _OPEN).any() or (s - length + 1 < low and low > 0) or s + length - 1 >= high:
            out[i] = _OPEN
        else:
            out[i] = _TAKEN
        state[p] = out[i]
    pdf["_state"] = out
    return pdf[(starts >= own_low) & (starts < own_high)]


def _settler(length: int, chunk: int, halo: int, shift: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        own_low = int(pdf["chunk"].iloc[0]) * chunk - shift
        own_high = own_low + chunk
        return _resolve(pdf.drop(columns="chunk"), length, max(own_low - halo, 0), own_high + halo,
                        own_low, own_high)

    return settle


def select_nonoverlapping(detections: DataFrame, length: int, top: int | None = None,
                          chunk: int | None = None) -> DataFrame:
    """Greedy choice of pairwise disjoint windows by score (earlier start on ties).

    Exactly the sequential result, reached in rounds: every chunk settles all
    windows whose better neighbours it can see, the rest is retried with shifted
    chunk borders and the decisions so far. The best open window is settled in
    every round, so rounds end; in practice one or two suffice. Long runs of
    steadily rising scores need more, so later rounds, which hold fewer rows, use
    longer chunks up to a fixed size. ``top`` keeps the best n per symbol.
    """
    chunk = max(chunk or chunk_for(4 * length), 2 * length)
    longest, halo = max(chunk, LONGEST_CHUNK), 4 * length
    payload = detections.columns
    schema = T.StructType([*detections.schema.fields, T.StructField("_state", T.IntegerType())])
    state = detections.withColumn("_state", F.lit(_OPEN))
    shift = 0
    while True:
        shifted = state.withColumn("_pos", F.col("start_idx") + shift)
        parts = spread(shifted, chunk, back=halo, ahead=halo, pos="_pos").drop("_pos")

        state = parts.groupBy("symbol", "chunk").applyInPandas(_settler(length, chunk, halo, shift), schema)
        state = cut_lineage(state.where(F.col("_state") != _DROPPED))
        if state.where(F.col("_state") == _OPEN).isEmpty():
            break
        chunk = min(2 * chunk, longest)
        shift = 0 if shift else chunk // 2
    chosen = state.select(*payload)
    if top is not None:
        rank = Window.partitionBy("symbol").orderBy(F.col("score").desc(), "start_idx")
        chosen = chosen.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= top).drop("_r")
    return chosen
