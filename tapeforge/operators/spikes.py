"""Stateful rejection of phantom prints, in batch and one bar at a time.

The filter is sequential: a bar is judged against the median of the last ten
accepted closes. Its whole memory is those closes and a rejection counter, so a
long series is processed in chunks whose entry states are guessed, checked
against the exit state of the chunk before, and redone only where the guess was
wrong.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tapeforge.operators.windows import spread
from tapeforge.schemas import PRICE_COLS
from tapeforge.session import cut_lineage

# Fixed values of the spike rule: deviation from the median, closes remembered, rejections in a row.
LIMIT, MEMORY, MAX_REJECTS = 0.04, 10, 3

State = tuple[list[float], int]


def step(state: State, prices: tuple[float, float, float, float], limit: float = LIMIT,
         memory: int = MEMORY, max_rejects: int = MAX_REJECTS) -> tuple[bool, State]:
    """Judge one bar (open, high, low, close): (accepted, next state).

    After ``max_rejects`` rejections in a row the next outlier is accepted and
    the old reference is forgotten.
    """
    closes, rejects = state
    if closes:
        ranked = sorted(closes)
        middle = (ranked[(len(ranked) - 1) // 2] + ranked[len(ranked) // 2]) / 2
        worst = max(abs(p / middle - 1.0) for p in prices) if middle else np.inf
        if worst > limit:
            if rejects < max_rejects:
                return False, (closes, rejects + 1)
            closes = []
    return True, ([*closes, prices[3]][-memory:], 0)


def _walk(pdf: pd.DataFrame, state: State, limit: float) -> tuple[np.ndarray, State]:
    """Judge a run of bars in order.

    After MEMORY acceptances in a row the reference is simply the last MEMORY
    closes, so up to the next outlier everything is accepted at once; only the
    stretches around outliers are stepped bar by bar.
    """
    prices = pdf[PRICE_COLS].to_numpy(np.float64)
    n, close = len(prices), prices[:, 3]
    accepted = np.ones(n, dtype=bool)
    outliers = np.empty(0, dtype=np.int64)
    if n > MEMORY:
        middle = np.median(sliding_window_view(close, MEMORY)[:-1], axis=1)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            calm = np.abs(prices[MEMORY:] / middle - 1.0).max(axis=1) <= limit
        outliers = np.flatnonzero(~calm) + MEMORY
    i = streak = 0
    while i < n:
        if streak >= MEMORY:
            k = np.searchsorted(outliers, i)
            stop = int(outliers[k]) if k < len(outliers) else n
            if stop > i:
                state, i = (close[stop - MEMORY:stop].tolist(), 0), stop
                continue
        accepted[i], state = step(state, tuple(prices[i].tolist()), limit)
        streak = (1 if len(state[0]) == 1 else streak + 1) if accepted[i] else 0
        i += 1
    return accepted, state


_STATE = "symbol string, chunk bigint, entry array<double>, entry_rejects int, leave array<double>, leave_rejects int"


def _state_row(pdf: pd.DataFrame, entry: State, leave: State) -> pd.DataFrame:
    return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]],
                         "entry": [entry[0]], "entry_rejects": [entry[1]],
                         "leave": [leave[0]], "leave_rejects": [leave[1]]})


def _guess(pdf: pd.DataFrame, chunk: int, limit: float) -> pd.DataFrame:
    """Warm up on the halo from an empty state, then run the chunk."""
    pdf = pdf.sort_values("bar_idx", ignore_index=True)
    mine = (pdf["bar_idx"] // chunk == pdf["chunk"]).to_numpy()
    if not mine.any():
        return pd.DataFrame(columns=["symbol", "chunk", "entry", "entry_rejects", "leave", "leave_rejects"])
    _, entry = _walk(pdf[~mine], ([], 0), limit)
    _, leave = _walk(pdf[mine], entry, limit)
    return _state_row(pdf, entry, leave)


def _first_state(states: pd.DataFrame) -> State:
    return list(states["entry"].iloc[0]), int(states["entry_rejects"].iloc[0])


def _redo(bars: pd.DataFrame, states: pd.DataFrame, limit: float) -> pd.DataFrame:
    entry = _first_state(states)
    _, leave = _walk(bars.sort_values("bar_idx"), entry, limit)
    return _state_row(bars, entry, leave)


def _judge(bars: pd.DataFrame, states: pd.DataFrame, limit: float) -> pd.DataFrame:
    bars = bars.sort_values("bar_idx", ignore_index=True)
    bars["accepted"], _ = _walk(bars, _first_state(states), limit)
    return bars


def spike_filter(indexed: DataFrame, limit: float = LIMIT, chunk: int = 4096, warmup: int = 256) -> DataFrame:
    """Add ``accepted`` to every bar; equal to one sequential pass over each symbol."""
    keys = ["symbol", "chunk"]
    slim = indexed.select("symbol", "bar_idx", *PRICE_COLS)
    own = slim.withColumn("chunk", F.expr(f"bar_idx div {chunk}"))
    states = cut_lineage(spread(slim, chunk, back=warmup).groupBy(*keys)
                         .applyInPandas(lambda pdf: _guess(pdf, chunk, limit), _STATE))
    # States are one small row per chunk; the loop ends when every chunk starts
    # where its predecessor stopped. Chunk 0 is right at once, so each round
    # extends the verified prefix; in practice the first check passes.
    before = Window.partitionBy("symbol").orderBy("chunk")
    while True:
        linked = states.withColumn("_e", F.lag("leave").over(before)).withColumn(
            "_r", F.lag("leave_rejects").over(before))
        wrong = linked.where("_e is not null and (entry != _e or entry_rejects != _r)")
        if wrong.isEmpty():
            break
        todo = wrong.select("symbol", "chunk", F.col("_e").alias("entry"), F.col("_r").alias("entry_rejects"))
        redone = (
            own.join(todo.select(*keys), keys, "left_semi").groupBy(*keys)
            .cogroup(todo.groupBy(*keys)).applyInPandas(lambda b, s: _redo(b, s, limit), _STATE)
        )
        states = cut_lineage(states.join(todo.select(*keys), keys, "left_anti").unionByName(redone))
    bars = indexed.withColumn("chunk", F.expr(f"bar_idx div {chunk}"))
    judged = T.StructType([*bars.schema.fields, T.StructField("accepted", T.BooleanType())])
    return bars.groupBy(*keys).cogroup(states.groupBy(*keys)).applyInPandas(
        lambda b, s: _judge(b, s, limit), judged).drop("chunk")
