"""Envelope lines of windows and the measures derived from them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from tapeforge.operators.windows import chunk_for, chunk_spec, over_chunks, spread
from tapeforge.schemas import APEX_MAX_AHEAD, OUTSIDE_TOLERANCE, TOUCH_TOLERANCE

UPPER_Q, LOWER_Q, REFITS = 0.55, 0.45, 2
TINY = 1e-12
BATCH = 512

FIT_COLS = ["a_upper", "b_upper", "a_lower", "b_lower", "price_range"]
CONTAIN_COLS = ["max_excursion", "mean_excursion", "frac_outside", "spike_share"]
TOUCH_COLS = ["touch_up", "touch_lo"]


def envelope_lines(y: np.ndarray, q: float, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and slopes of the iterated one-sided fits, one per row of ``y``.

    Least squares over all points, then over the points whose residual lies at
    or beyond the q-quantile of all residuals, repeated. A row left with fewer
    than three points keeps its last line.
    """
    n = y.shape[1]
    x = np.arange(n) - (n - 1) / 2.0
    base = y.mean(axis=1, keepdims=True)
    yc = y - base
    keep = np.ones(y.shape, dtype=bool)
    a, b = np.zeros(len(y)), np.zeros(len(y))
    for i in range(REFITS + 1):
        w = keep.astype(np.float64)
        count, sx, sxx = w.sum(axis=1), w @ x, w @ (x * x)
        wy = w * yc
        sy, sxy = wy.sum(axis=1), wy @ x
        live = count >= 3
        det = np.where(live, count * sxx - sx * sx, 1.0)
        slope = (count * sxy - sx * sy) / det
        b = np.where(live, slope, b)
        a = np.where(live, (sy - slope * sx) / np.maximum(count, 1.0), a)
        if i == REFITS:
            break
        resid = yc - (a[:, None] + b[:, None] * x)
        cut = np.quantile(resid, q, axis=1, keepdims=True)
        keep = resid >= cut if upper else resid <= cut
    return a - b * (n - 1) / 2.0 + base[:, 0], b


def _visits(near: np.ndarray) -> np.ndarray:
    """Maximal runs of True per row."""
    return near[:, 0].astype(np.int64) + (near[:, 1:] & ~near[:, :-1]).sum(axis=1)


def measure_windows(high: np.ndarray, low: np.ndarray) -> dict[str, np.ndarray]:
    """Lines and containment of a batch of windows, one row per window."""
    au, bu = envelope_lines(high, UPPER_Q, True)
    al, bl = envelope_lines(low, LOWER_Q, False)
    x = np.arange(high.shape[1], dtype=np.float64)
    up, lo = au[:, None] + bu[:, None] * x, al[:, None] + bl[:, None] * x
    gap = np.abs(up - lo)
    mean_gap = np.maximum(gap.mean(axis=1), TINY)
    breach = np.maximum(np.maximum(high - up, lo - low), 0.0) / mean_gap[:, None]
    total, worst = breach.sum(axis=1), breach.max(axis=1)
    return {
        "a_upper": au, "b_upper": bu, "a_lower": al, "b_lower": bl,
        "price_range": np.maximum(high.max(axis=1) - low.min(axis=1), TINY),
        "max_excursion": worst,
        "mean_excursion": breach.mean(axis=1),
        "frac_outside": (breach > OUTSIDE_TOLERANCE).mean(axis=1),
        "spike_share": np.where(total > TINY, worst / np.where(total > TINY, total, 1.0), 0.0),
        "touch_up": _visits(high >= up - TOUCH_TOLERANCE * gap),
        "touch_lo": _visits(low <= lo + TOUCH_TOLERANCE * gap),
    }


def _output_schema(indexed: DataFrame, carry: list[str], carry_start: list[str]) -> T.StructType:
    fields = [T.StructField("symbol", T.StringType()), T.StructField("start_idx", T.LongType()),
              T.StructField("end_idx", T.LongType())]
    fields += [T.StructField(c, T.DoubleType()) for c in FIT_COLS + CONTAIN_COLS]
    fields += [T.StructField(c, T.IntegerType()) for c in TOUCH_COLS]
    fields += [T.StructField(c, indexed.schema[c].dataType) for c in carry]
    fields += [T.StructField(f"{c}_start", indexed.schema[c].dataType) for c in carry_start]
    return T.StructType(fields)


def _window_rows(pdf: pd.DataFrame, ends: np.ndarray, length: int, fit: int, carry: list[str],
                 carry_start: list[str], columns: list[str]) -> pd.DataFrame:
    """Measure the windows of one chunk that end at row offsets ``ends``."""
    high = sliding_window_view(pdf["high"].to_numpy(np.float64), fit)
    low = sliding_window_view(pdf["low"].to_numpy(np.float64), fit)
    parts = []
    for i in range(0, len(ends), BATCH):
        first = ends[i:i + BATCH] - fit + 1
        parts.append(pd.DataFrame(measure_windows(high[first], low[first])))
    out = pd.concat(parts, ignore_index=True)
    out["symbol"] = pdf["symbol"].iloc[0]
    out["end_idx"] = pdf["bar_idx"].to_numpy()[ends]
    out["start_idx"] = out["end_idx"] - length + 1
    for c in carry:
        out[c] = pdf[c].to_numpy()[ends]
    for c in carry_start:
        out[f"{c}_start"] = pdf[c].to_numpy()[ends - length + 1]
    return out[columns]


def envelope_windows(indexed: DataFrame, length: int, fit_bars: int | None = None, stride: int = 1,
                     at: DataFrame | None = None, carry: list[str] | None = None,
                     carry_start: list[str] | None = None, chunk: int | None = None,
                     features: Callable[[DataFrame, WindowSpec], DataFrame] | None = None) -> DataFrame:
    """Envelope fit and containment of windows of ``length`` bars.

    Dense (``at`` is None): every ``stride``-th window. Sparse: the windows whose
    (symbol, end_idx) are in ``at``. Either way bars are shuffled once by
    (symbol, chunk); a task sees one chunk plus its halo, never a whole series.
    ``features`` adds frame columns inside the same chunks, before the fit, so
    they ride along in ``carry`` without another shuffle.
    """
    fit = length if not fit_bars else min(fit_bars, length)
    chunk = chunk or chunk_for(length)
    carry, carry_start = list(carry or []), list(carry_start or [])
    bars = spread(indexed, chunk, back=length)
    if features is not None:
        bars = features(bars, chunk_spec())
    need = list(dict.fromkeys(["symbol", "chunk", "bar_idx", "high", "low", *carry, *carry_start]))
    bars = bars.select(*need)
    schema = _output_schema(bars, carry, carry_start)
    columns = [f.name for f in schema.fields]

    def measure(pdf: pd.DataFrame, wanted: np.ndarray | None) -> pd.DataFrame:
        if len(pdf) < length:
            return pd.DataFrame(columns=columns)
        pdf = pdf.sort_values("bar_idx", ignore_index=True)
        idx = pdf["bar_idx"].to_numpy()
        start = idx - length + 1
        hit = (idx // chunk == pdf["chunk"].iloc[0]) & (np.arange(len(idx)) >= length - 1)
        hit &= (start % stride == 0) if wanted is None else np.isin(idx, wanted)
        ends = np.flatnonzero(hit)
        if not len(ends):
            return pd.DataFrame(columns=columns)
        return _window_rows(pdf, ends, length, fit, carry, carry_start, columns)

    if at is None:
        return bars.groupBy("symbol", "chunk").applyInPandas(lambda pdf: measure(pdf, None), schema)
    # Fresh column identities, since ``at`` may come from the very same bars.
    keys = at.select(F.col("symbol").alias("_s"), F.col("end_idx").alias("_e")).distinct().select(
        F.col("_s").alias("symbol"), F.col("_e").alias("end_idx"), F.expr(f"_e div {chunk}").alias("chunk"))
    bars = bars.join(keys.select("symbol", "chunk").distinct(), ["symbol", "chunk"], "left_semi")
    return (
        bars.groupBy("symbol", "chunk").cogroup(keys.groupBy("symbol", "chunk"))
        .applyInPandas(lambda b, k: measure(b, k["end_idx"].to_numpy()), schema)
    )


def with_geometry(fits: DataFrame, n: int) -> DataFrame:
    """Scale-free slopes, travel, widths and convergence from fitted lines over ``n`` bars."""
    rng = F.col("price_range")
    w0 = (F.col("a_upper") - F.col("a_lower")) / rng
    w1 = ((F.col("a_upper") + F.col("b_upper") * (n - 1)) - (F.col("a_lower") + F.col("b_lower") * (n - 1))) / rng
    return (
        fits.withColumn("m_upper", F.col("b_upper") / rng)
        .withColumn("m_lower", F.col("b_lower") / rng)
        .withColumn("travel_upper", F.col("m_upper") * n)
        .withColumn("travel_lower", F.col("m_lower") * n)
        .withColumn("width_start", w0)
        .withColumn("width_end", w1)
        .withColumn("convergence", F.when(F.col("width_start") > 1e-9,
                                          1 - F.col("width_end") / F.col("width_start")).otherwise(F.lit(0.0)))
        .withColumn("mid_travel", (F.col("travel_upper") + F.col("travel_lower")) / 2)
    )


def with_apex(fits: DataFrame, n: int) -> DataFrame:
    """Where the lines cross: bars ahead of the last bar, price there, and the apex verdict."""
    closing = F.col("b_upper") - F.col("b_lower")
    converging = closing < -TINY
    cross = (F.col("a_lower") - F.col("a_upper")) / closing
    return (
        fits.withColumn("apex_ahead", F.when(converging, cross - (n - 1)))
        .withColumn("apex_min", F.coalesce(F.rint("apex_ahead"), F.lit(0.0)).cast("long"))
        .withColumn("apex_price", F.when(converging, F.col("a_upper") + F.col("b_upper") * cross)
                    .otherwise(F.lit(0.0)))
        .withColumn("apex_ok", F.coalesce(F.col("apex_ahead") <= APEX_MAX_AHEAD, F.lit(False)))
    )


# --- the same fit as plain DataFrame steps, for sparse point sets -------------

def envelope_fit_sql(points: DataFrame, keys: list[str], x: str = "pos") -> DataFrame:
    """Envelope lines of windows given as rows (keys, x, high, low), in built-in functions only.

    Every round is a window function over the same ``keys``, so all rounds of
    both sides share one shuffle; a partition is one window, hence small. A round
    that would keep fewer than three points changes nothing, so the fit before it stands.
    """
    whole = Window.partitionBy(*keys)
    d = points.select(*keys, x, "high", "low", F.lit(True).alias("_ku"), F.lit(True).alias("_kl"))
    for i in range(REFITS + 1):
        upper, lower = F.when(F.col("_ku"), F.col("high")), F.when(F.col("_kl"), F.col("low"))
        d = d.select("*", F.regr_intercept(upper, x).over(whole).alias("_au"),
                     F.regr_slope(upper, x).over(whole).alias("_bu"),
                     F.regr_intercept(lower, x).over(whole).alias("_al"),
                     F.regr_slope(lower, x).over(whole).alias("_bl"))
        if i == REFITS:
            break
        d = d.withColumn("_ru", F.col("high") - (F.col("_au") + F.col("_bu") * F.col(x)))
        d = d.withColumn("_rl", F.col("low") - (F.col("_al") + F.col("_bl") * F.col(x)))
        d = d.select(*keys, x, "high", "low", "_ku", "_kl",
                     (F.col("_ru") >= F.percentile("_ru", F.lit(UPPER_Q)).over(whole)).alias("_nu"),
                     (F.col("_rl") <= F.percentile("_rl", F.lit(LOWER_Q)).over(whole)).alias("_nl"))
        d = d.select(*keys, x, "high", "low", *[
            F.when(F.count_if(new).over(whole) >= 3, F.col(new)).otherwise(F.col(old)).alias(old)
            for new, old in (("_nu", "_ku"), ("_nl", "_kl"))])
    return d.groupBy(*keys).agg(
        F.first("_au").alias("a_upper"), F.first("_bu").alias("b_upper"),
        F.first("_al").alias("a_lower"), F.first("_bl").alias("b_lower"),
        F.greatest(F.max("high") - F.min("low"), F.lit(TINY)).alias("price_range"))


def visit_runs(near: Column, spec: WindowSpec) -> Column:
    """1 where a run of ``near`` begins; sum it to count visits."""
    return (near & ~F.coalesce(F.lag(near).over(spec), F.lit(False))).cast("int")


def touch_counts(points: DataFrame, keys: list[str], value: str, upper: str, lower: str,
                 pos: str = "pos") -> DataFrame:
    """Visits of ``value`` to each of two given lines, per window."""
    spec = Window.partitionBy(*keys).orderBy(pos)
    tol = F.greatest(F.col(upper) - F.col(lower), F.lit(1e-9)) * TOUCH_TOLERANCE
    marked = points.select(
        *keys, visit_runs(F.col(value) >= F.col(upper) - tol, spec).alias("_u"),
        visit_runs(F.col(value) <= F.col(lower) + tol, spec).alias("_l"))
    return marked.groupBy(*keys).agg(F.sum("_u").cast("int").alias("touch_up"),
                                     F.sum("_l").cast("int").alias("touch_lo"))


def simple_slopes(points: DataFrame, keys: list[str], x: str = "pos") -> DataFrame:
    """Ordinary least-squares slopes of highs and lows per window."""
    return points.groupBy(*keys).agg(F.regr_slope("high", x).alias("slope_high"),
                                     F.regr_slope("low", x).alias("slope_low"))


def rolling_slopes(indexed: DataFrame, length: int, stride: int = 1, cols: tuple[str, ...] = ("high", "low"),
                   chunk: int | None = None) -> DataFrame:
    """(symbol, start_idx, end_idx, slope_<col>): ordinary least-squares slopes of every ``stride``-th window of ``length`` bars.

    Running sums of y and of x y, both counted from the chunk's middle and mean, are differenced: a window costs the same
    whatever its length, and the bars are shuffled once.
    """
    chunk = chunk or chunk_for(length)
    whole = Window.partitionBy("symbol", "chunk")

    def steps(df: DataFrame, spec: WindowSpec) -> DataFrame:
        run = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        d = df.select("symbol", "chunk", "bar_idx", (F.col("bar_idx") - F.col("chunk") * chunk - chunk // 2).cast("double").alias("_x"),
                      *[(F.col(c) - F.avg(c).over(whole)).alias(f"_{c}") for c in cols])
        d = d.select("*", *[s for c in cols for s in (F.sum(f"_{c}").over(run).alias(f"_s_{c}"),
                                                      F.sum(F.col("_x") * F.col(f"_{c}")).over(run).alias(f"_sx_{c}"))])
        d = d.select("*", *[(F.col(f"_{k}_{c}") - F.coalesce(F.lag(f"_{k}_{c}", length).over(spec), F.lit(0.0))).alias(f"_d{k}_{c}")
                            for c in cols for k in ("s", "sx")])
        middle, spread_x = F.col("_x") - (length - 1) / 2, length * (length * length - 1) / 12
        return d.select("symbol", "chunk", "bar_idx", *[
            (F.try_divide(F.col(f"_dsx_{c}") - middle * F.col(f"_ds_{c}"), F.lit(spread_x))).alias(f"slope_{c}") for c in cols])

    start = F.col("bar_idx") - length + 1
    out = over_chunks(indexed.select("symbol", "bar_idx", *cols), steps, back=length, chunk=chunk)
    return out.where((start >= 0) & (start % stride == 0)).select(
        "symbol", start.alias("start_idx"), F.col("bar_idx").alias("end_idx"), *[f"slope_{c}" for c in cols])


def channel_positions(indexed: DataFrame, length: int, stride: int = 1, chunk: int | None = None) -> DataFrame:
    """(symbol, start_idx, end_idx, slope_high, slope_low, rel_min, rel_max) of every ``stride``-th window.

    Slopes are least-squares ones from prefix moments; rel_min and rel_max say where the closes lie between the
    lines of these slopes through the first high and low (0: on the lower, 1: on the upper). A task holds one chunk with its
    halo, and windows are views on it, a bounded number at a time.
    """
    chunk = chunk or chunk_for(length)
    schema = "symbol string, start_idx bigint, end_idx bigint, slope_high double, slope_low double, rel_min double, rel_max double"
    names = [c.split()[0] for c in schema.split(", ")]

    def slopes(y: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = np.arange(len(y)) - len(y) / 2
        y = y - y.mean()
        s, sx = (np.r_[0.0, np.cumsum(v)] for v in (y, x * y))
        ds, dsx = s[ends + 1] - s[ends + 1 - length], sx[ends + 1] - sx[ends + 1 - length]
        return (dsx - (x[ends] - (length - 1) / 2) * ds) / (length * (length * length - 1) / 12)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx", ignore_index=True)
        idx = pdf["bar_idx"].to_numpy()
        ends = np.flatnonzero((idx // chunk == pdf["chunk"].iloc[0]) & (np.arange(len(idx)) >= length - 1)
                              & ((idx - length + 1) % stride == 0))
        if not len(ends):
            return pd.DataFrame(columns=names)
        high, low, close = (pdf[c].to_numpy(np.float64) for c in ("high", "low", "close"))
        up, lo = slopes(high, ends), slopes(low, ends)
        least, most = np.empty(len(ends)), np.empty(len(ends))
        x, view = np.arange(length), sliding_window_view(close, length)
        for i in range(0, len(ends), BATCH):
            first = ends[i:i + BATCH] - length + 1
            line = low[first, None] + lo[i:i + BATCH, None] * x
            width = high[first, None] + up[i:i + BATCH, None] * x - line + 1e-10
            with np.errstate(divide="ignore", invalid="ignore"):
                rel = np.where(width != 0, (view[first] - line) / width, np.nan)
            least[i:i + BATCH], most[i:i + BATCH] = np.fmin.reduce(rel, axis=1), np.fmax.reduce(rel, axis=1)
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "start_idx": idx[ends] - length + 1, "end_idx": idx[ends],
                             "slope_high": up, "slope_low": lo, "rel_min": least, "rel_max": most})

    bars = spread(indexed.select("symbol", "bar_idx", "high", "low", "close"), chunk, back=length)
    return bars.groupBy("symbol", "chunk").applyInPandas(run, schema)


def fit_accuracy(pairs: DataFrame) -> DataFrame:
    """Fitted against known slopes per side: correlation, mean error, scale."""
    long = pairs.select(F.explode(F.array(
        F.struct(F.lit("upper").alias("side"), F.col("true_upper").alias("t"), F.col("m_upper").alias("f")),
        F.struct(F.lit("lower").alias("side"), F.col("true_lower").alias("t"), F.col("m_lower").alias("f")),
    )).alias("p")).select("p.*")
    return long.groupBy("side").agg(F.corr("t", "f").alias("pearson_r"),
                                    F.avg(F.abs(F.col("t") - F.col("f"))).alias("mae"),
                                    F.avg(F.abs("t")).alias("mean_abs_slope"))
