"""Sliding windows over arbitrarily long series.

A series is cut into chunks of consecutive bars; each bar is also sent to the
neighbouring chunks that need it as a halo. All frames are then evaluated
inside (symbol, chunk), so one long symbol spreads over many tasks and the only
extra cost is halo / chunk duplicated rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tapeforge.schemas import FEATURE_COLS, PRICE_COLS

ZERO_RANGE = 1e-10
SALTS = 64  # tasks that the bars of one symbol are spread over when they meet a per-symbol value


def chunk_for(halo: int) -> int:
    """Chunk length that keeps the halo below about six percent of the rows."""
    return max(4096, 16 * halo)


def spread(indexed: DataFrame, chunk: int, back: int = 0, ahead: int = 0, pos: str = "bar_idx") -> DataFrame:
    """Send each row to its own chunk and to those whose frames reach it."""
    if back == 0 and ahead == 0:
        return indexed.withColumn("chunk", F.expr(f"{pos} div {chunk}"))
    return indexed.withColumn(
        "chunk",
        F.explode(F.expr(f"sequence(greatest({pos} - {ahead}, 0L) div {chunk}, ({pos} + {back}) div {chunk})")),
    )


def owned(chunk: int, pos: str = "bar_idx") -> Column:
    """True on the one copy of a row that belongs to the chunk."""
    return F.expr(f"{pos} div {chunk} = chunk")


def chunk_spec(pos: str = "bar_idx") -> WindowSpec:
    return Window.partitionBy("symbol", "chunk").orderBy(pos)


def over_chunks(indexed: DataFrame, steps: Callable[[DataFrame, WindowSpec], DataFrame], back: int = 0,
                ahead: int = 0, chunk: int | None = None) -> DataFrame:
    """Run window expressions inside chunks and return every bar once."""
    chunk = chunk or chunk_for(back + ahead)
    out = steps(spread(indexed, chunk, back, ahead), chunk_spec())
    return out.where(owned(chunk)).drop("chunk")


def moving_std(df: DataFrame, src: str, out: str, length: int, spec: WindowSpec, end: int = 0,
               sample: bool = False, need_full: bool = False) -> DataFrame:
    """Standard deviation of ``src`` over the ``length`` rows ending ``end`` rows back.

    Running sums of the chunk-centred value are differenced: O(1) a row for any
    length, measured at about an eighth of the cost of a 250-row frame. Centring
    and restarting in every chunk keep the subtraction well conditioned.
    """
    run = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("symbol", "chunk")
    d = df.withColumn("_c", F.col(src) - F.avg(src).over(whole))
    d = d.select("*", F.count("_c").over(run).alias("_n"), F.sum("_c").over(run).alias("_s"),
                 F.sum(F.col("_c") * F.col("_c")).over(run).alias("_q"))

    def diff(c: str) -> Column:
        top = F.lag(c, end).over(spec) if end else F.col(c)
        return top - F.coalesce(F.lag(c, length + end).over(spec), F.lit(0))

    d = d.select("*", diff("_n").alias("_dn"), diff("_s").alias("_ds"), diff("_q").alias("_dq"))
    n, mean = F.col("_dn"), F.try_divide("_ds", "_dn")
    var = F.greatest(F.try_divide(F.col("_dq"), n) - mean * mean, F.lit(0.0))
    if sample:
        var = F.when(n > 1, var * n / (n - 1))
    std = F.sqrt(var)
    std = F.when(n >= length, std) if need_full else F.when(n > 0, std)
    return d.withColumn(out, std).drop("_c", "_n", "_s", "_q", "_dn", "_ds", "_dq")


def sliding_extremes(df: DataFrame, wanted: dict[str, tuple[Column, Callable]], length: int, pos: str = "bar_idx") -> DataFrame:
    """Extremes of the ``length`` rows that end at each row of a (symbol, chunk), at a cost that ``length`` doesn't change.

    ``wanted`` names the results: (value, F.min or F.max). Positions are cut into blocks of ``length``. A window
    is the end of one block and the beginning of the next, so its extreme is that of two running ones: from its first row to
    the end of that block, and from the beginning of the next to its last row. Rows whose window begins before
    the chunk's rows do have a null; where rows are missing the result is undefined.
    """
    block = Window.partitionBy("symbol", "chunk", "_block")
    onward = block.orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = block.orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One shuffle serves the blocks and the chunk's own order.
    d = df.repartition("symbol", "chunk").withColumn("_block", F.expr(f"{pos} div {length}"))
    d = d.select("*", *[of(value).over(back).alias(f"_back_{n}") for n, (value, of) in wanted.items()])
    d = d.select("*", *[of(value).over(onward).alias(f"_on_{n}") for n, (value, of) in wanted.items()])
    last = {n: F.lag(f"_back_{n}", length - 1).over(chunk_spec(pos)) for n in wanted}
    d = d.select("*", *[c.alias(f"_first_{n}") for n, c in last.items()])

    def both(n: str, of: Callable) -> Column:
        pick = F.greatest if of is F.max else F.least
        return F.when(F.col(f"_first_{n}").isNotNull(), pick(f"_first_{n}", f"_on_{n}"))

    return d.select(*df.columns, *[both(n, of).alias(n) for n, (_, of) in wanted.items()])


def window_ranges(indexed: DataFrame, length: int, chunk: int | None = None) -> DataFrame:
    """Price minimum / range and volume maximum of the ``length`` bars ending at each bar.

    ``depth`` is the number of bars available so far (the fill of a rolling
    buffer); ranges are null while the window is filling. Zero ranges become 1.
    """

    def steps(df: DataFrame, spec: WindowSpec) -> DataFrame:
        return sliding_extremes(df, {"price_min": (F.least(*PRICE_COLS), F.min), "_max": (F.greatest(*PRICE_COLS), F.max),
                                     "_vmax": (F.col("volume"), F.max)}, length)

    full = F.col("bar_idx") >= length - 1

    def guarded(c: Column) -> Column:
        return F.when(full, F.when(c < ZERO_RANGE, F.lit(1.0)).otherwise(c))

    out = over_chunks(indexed, steps, back=length, chunk=chunk)
    return (
        out.withColumn("price_range", guarded(F.col("_max") - F.col("price_min")))
        .withColumn("price_min", F.when(full, F.col("price_min")))
        .withColumn("volume_max", guarded(F.col("_vmax")))
        .withColumn("depth", F.least(F.col("bar_idx") + 1, F.lit(length)))
        .drop("_max", "_vmax")
    )


def gather(starts: DataFrame, indexed: DataFrame, cols: list[str]) -> DataFrame:
    """Bars of sparse windows: explode positions, equi-join on (symbol, bar_idx)."""
    probe = starts.withColumn("bar_idx", F.explode(F.sequence("start_idx", "end_idx")))
    return (
        probe.join(indexed.select("symbol", "bar_idx", *cols), ["symbol", "bar_idx"])
        .withColumn("pos", (F.col("bar_idx") - F.col("start_idx")).cast("int"))
    )


def touched_chunks(wanted: DataFrame, chunk: int, first: str, last: str) -> DataFrame:
    """(symbol, chunk) of the chunks that the stretches [first, last] of positions lie in."""
    return wanted.select("symbol", F.explode(F.expr(f"sequence({first} div {chunk}, {last} div {chunk})")).alias("chunk")).distinct()


def window_bars(indexed: DataFrame, starts: DataFrame, length: int, cut: Callable[[np.ndarray], np.ndarray] | None = None,
                chunk: int | None = None) -> DataFrame:
    """(symbol, start_idx, end_idx, pos, open .. volume) of the given windows (symbol, start_idx, end_idx), each once.

    Only chunks in which a window ends are shuffled, with their halo, and meet their windows there; no position is
    exploded or joined. ``cut`` maps windows (b, length, 5) to the values to give out.
    """
    chunk = chunk or chunk_for(length)
    wanted = starts.select(F.col("symbol").alias("_symbol"), F.col("start_idx").alias("_start"), F.col("end_idx").alias("_end"),
                           F.expr(f"end_idx div {chunk}").alias("_chunk")).distinct()
    bars = spread(indexed.select("symbol", "bar_idx", *FEATURE_COLS), chunk, back=length)
    touched = wanted.select("_symbol", "_chunk").distinct()
    bars = bars.join(touched, (F.col("symbol") == F.col("_symbol")) & (F.col("chunk") == F.col("_chunk")), "left_semi")
    names = ["symbol", "start_idx", "end_idx", "pos", *FEATURE_COLS]

    def rows(b: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        if not len(w) or len(b) < length:
            return pd.DataFrame(columns=names)
        b = b.sort_values("bar_idx")
        at = np.searchsorted(b["bar_idx"].to_numpy(), w["_end"].to_numpy())
        known = at < len(b)
        known[known] = (b["bar_idx"].to_numpy()[at[known]] == w["_end"].to_numpy()[known]) & (at[known] >= length - 1)
        w, at = w[known], at[known]
        view = sliding_window_view(b[FEATURE_COLS].to_numpy(np.float64), length, axis=0)[at - length + 1].transpose(0, 2, 1)
        values = (view if cut is None else cut(view)).reshape(-1, len(FEATURE_COLS))
        out = {"symbol": np.repeat(w["_symbol"].to_numpy(), length), "start_idx": np.repeat(w["_start"].to_numpy(), length),
               "end_idx": np.repeat(w["_end"].to_numpy(), length), "pos": np.tile(np.arange(length, dtype=np.int32), len(w))}
        return pd.DataFrame({**out, **{c: values[:, i] for i, c in enumerate(FEATURE_COLS)}}, columns=names)

    schema = ", ".join(f"{n} {t}" for n, t in indexed.select("symbol").dtypes) + ", start_idx bigint, end_idx bigint, pos int, " + ", ".join(
        f"{c} double" for c in FEATURE_COLS)
    return bars.groupBy("symbol", "chunk").cogroup(wanted.groupBy("_symbol", "_chunk")).applyInPandas(rows, schema)


def scaled_windows(raw: np.ndarray) -> np.ndarray:
    """Windows (b, length, 5) with the prices of each scaled to [0, 1] together, and its volumes by their maximum."""
    price, vol = raw[:, :, :4], raw[:, :, 4:]
    low = price.min(axis=(1, 2), keepdims=True)
    span = price.max(axis=(1, 2), keepdims=True) - low
    top = vol.max(axis=1, keepdims=True)
    span[span < ZERO_RANGE] = 1.0
    top[top < ZERO_RANGE] = 1.0
    return np.concatenate([(price - low) / span, vol / top], axis=2)


def normalised_windows(indexed: DataFrame, starts: DataFrame, length: int, chunk: int | None = None) -> DataFrame:
    """Bars of the given windows with prices and volume scaled to [0, 1] per window; ranges are those of these windows alone."""
    return window_bars(indexed, starts, length, scaled_windows, chunk)


def lag_sequences(indexed: DataFrame, col: str, length: int = 60, chunk: int | None = None) -> DataFrame:
    """The ``length`` values before each bar as an array, with the bar's own value as target.

    Values are min-max scaled by the series range; ``low`` and ``span`` undo it.
    """
    stats = indexed.groupBy("symbol").agg(F.min(col).alias("low"), (F.max(col) - F.min(col)).alias("span"))
    # One copy of a symbol's range per salt: the bars of a hot symbol meet it in many tasks.
    stats = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    safe = F.when(F.col("span") == 0, F.lit(1.0)).otherwise(F.col("span"))
    scaled = (
        indexed.select("symbol", "bar_idx", col, F.pmod("bar_idx", F.lit(SALTS)).cast("long").alias("_salt"))
        .join(stats, ["symbol", "_salt"]).drop("_salt")
        .withColumn("target", (F.col(col) - F.col("low")) / safe)
    )

    def steps(df: DataFrame, spec: WindowSpec) -> DataFrame:
        return df.withColumn("history", F.collect_list("target").over(spec.rowsBetween(-length, -1)))

    out = over_chunks(scaled, steps, back=length, chunk=chunk)
    return out.where(F.size("history") == length).select("symbol", "bar_idx", "history", "target", "low", "span")
