"""Windows, geometry, gates, detection and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeforge.functions.scalars import rounded, slope_class
from tapeforge.operators import detection, forward, geometry, indexing, sampling, spikes
from tapeforge.operators import windows as win
from tapeforge.operators.gates import categorise, direction_split
from tapeforge.plans import corpus, detect, jobs, learning
from tapeforge.schemas import FEATURE_COLS
from workload.base import (CATEGORY, CHUNK, FIT, HORIZONS, LOOKBACK, N, SEED, THRESHOLD, VOL_WINDOW, decided,
                           decided_sql, events_sql, filtered, filtered_sql, forward_sql, idx_sql, indexed, query,
                           r, rs, stats_rows, stored_windows, text_ts, ts, windows, windows_sql)
from workload.tables import negatives_sql, normal_sql

FIT_COLS = ["a_upper", "b_upper", "a_lower", "b_lower", "price_range"]
GEO_COLS = ["m_upper", "m_lower", "travel_upper", "travel_lower", "width_start", "width_end", "convergence", "mid_travel"]


def _frame(back: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {back} PRECEDING AND CURRENT ROW)"


# --- windows ------------------------------------------------------------------

@query(f"""WITH {idx_sql()}, w AS (SELECT symbol, bar_idx, least({N}, bar_idx + 1) AS depth,
min(least(open, high, low, close)) {_frame(N - 1)} AS lo, max(greatest(open, high, low, close)) {_frame(N - 1)} AS hi,
max(volume) {_frame(N - 1)} AS vm FROM idx)
SELECT symbol, bar_idx, CAST(depth AS BIGINT) AS depth, CASE WHEN depth = {N} THEN round(lo + 3e-8, 6) END AS price_min,
CASE WHEN depth = {N} THEN round(CASE WHEN hi - lo < 1e-10 THEN 1.0 ELSE hi - lo END + 3e-8, 6) END AS price_range,
CASE WHEN depth = {N} THEN CASE WHEN vm < 1e-10 THEN 1.0 ELSE vm END END AS volume_max FROM w""")
def w1_w2_window_ranges(spark, sf):
    return win.window_ranges(indexed(spark, sf), N, CHUNK).select(
        "symbol", "bar_idx", F.col("depth").cast("long").alias("depth"), *r("price_min", "price_range"), "volume_max")


@query(f"WITH {windows_sql()}, {normal_sql()} SELECT symbol, start_idx, CAST(pos AS INT) AS pos, {rs(*FEATURE_COLS)} FROM nrm")
def w3_normalised_windows(spark, sf):
    ix = indexed(spark, sf)
    return win.normalised_windows(ix, indexing.window_starts(ix, N), N, CHUNK).select(
        "symbol", "start_idx", "pos", *r(*FEATURE_COLS))


RET = "CASE WHEN bar_idx = 0 THEN 0.0 ELSE (close - lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx)) / lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx) * 100 END"
SIGMA = f"sg AS (SELECT *, stddev_pop(r) {_frame(LOOKBACK - 1)} AS sigma FROM (SELECT *, {RET} AS r FROM idx))"
STRICT = f"""st0 AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx) - 1 AS q FROM idx),
st AS (SELECT *, CASE WHEN count(q) {_frame(VOL_WINDOW - 1)} = {VOL_WINDOW} THEN stddev_samp(q) {_frame(VOL_WINDOW - 1)} END AS sigma_strict FROM st0)"""


@query(f"WITH {idx_sql()}, {SIGMA} SELECT symbol, bar_idx, {rs('sigma')} FROM sg")
def w4_trailing_volatility(spark, sf):
    return forward.trailing_volatility(indexed(spark, sf), LOOKBACK, CHUNK).select("symbol", "bar_idx", *r("sigma"))


@query(f"WITH {idx_sql()}, {STRICT} SELECT symbol, bar_idx, {rs('sigma_strict')} FROM st")
def w5_strict_volatility(spark, sf):
    return forward.strict_volatility(indexed(spark, sf), VOL_WINDOW, CHUNK).select("symbol", "bar_idx", *r("sigma_strict"))


@query(f"WITH {windows_sql()} SELECT symbol, end_idx, {rs('vol_trend')} FROM win")
def w6_volatility_trend(spark, sf):
    d = forward.volatility_trend(indexed(spark, sf), N, FIT, CHUNK)
    return d.where(F.col("bar_idx") >= N - 1).select("symbol", F.col("bar_idx").alias("end_idx"), *r("vol_trend"))


RETS = [f"ret_{h}" for h in HORIZONS]


@query(f"WITH {idx_sql()}, {forward_sql()} SELECT symbol, bar_idx, {rs(*RETS)} FROM fwd")
def w7_forward_returns(spark, sf):
    return forward.forward_returns(indexed(spark, sf), HORIZONS, CHUNK).select("symbol", "bar_idx", *r(*RETS))


def excursion_sql(digits: int | None = 3, name: str = "exc") -> str:
    def rnd(e: str) -> str:
        return e if digits is None else f"round({e}, {digits})"

    cols = []
    for h in HORIZONS:
        nxt = f"OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        at = f"lead(close, {h}) OVER (PARTITION BY symbol ORDER BY bar_idx)"
        cols += [f"{rnd(f'({at} - close) / close * 100')} AS ret_{h}",
                 f"CASE WHEN {at} IS NOT NULL THEN {rnd(f'(max(high) {nxt} - close) / close * 100')} END AS mae_{h}",
                 f"CASE WHEN {at} IS NOT NULL THEN {rnd(f'(close - min(low) {nxt}) / close * 100')} END AS mfe_{h}",
                 f"{at} < close AS win_{h}"]
    return f"{name} AS (SELECT symbol, bar_idx, close AS entry_price, {', '.join(cols)} FROM idx)"


EXC = [f"{f}_{h}" for h in HORIZONS for f in ("ret", "mae", "mfe")]
EXC_OUT = ", ".join([f"round({c}, 3) + 0.0 AS {c}" for c in EXC] + [f"CAST(CAST(win_{h} AS INT) AS DOUBLE) AS win_{h}" for h in HORIZONS])


def _exc_cols():
    return [(F.round(c, 3) + 0.0).alias(c) for c in EXC] + [F.col(f"win_{h}").cast("int").cast("double").alias(f"win_{h}")
                                                            for h in HORIZONS]


@query(f"WITH {idx_sql()}, {excursion_sql()} SELECT symbol, bar_idx, {EXC_OUT} FROM exc")
def w8_excursions(spark, sf):
    return forward.excursions(indexed(spark, sf), HORIZONS, CHUNK).select("symbol", "bar_idx", *_exc_cols())


ZS = [f"z_{h}" for h in HORIZONS]


@query(f"""WITH {idx_sql()}, {SIGMA}, {forward_sql()} SELECT symbol, bar_idx,
{', '.join(f'round(CASE WHEN sigma > 1e-9 THEN ret_{h} / (sigma * sqrt({h})) END + 3e-8, 6) + 0.0 AS z_{h}' for h in HORIZONS)} FROM sg JOIN fwd USING (symbol, bar_idx)""")
def w9_normalised_returns(spark, sf):
    return forward.normalised_returns(indexed(spark, sf), HORIZONS, LOOKBACK, CHUNK).select("symbol", "bar_idx", *r(*ZS))


@query(f"WITH {windows_sql()} SELECT symbol, start_idx, CAST(n_gaps AS INT) AS n_gaps, CAST(gap_pos AS INT) AS gap_pos FROM win")
def w10_day_gaps(spark, sf):
    return windows(spark, sf).select("symbol", "start_idx", "n_gaps", "gap_pos")


@query(f"""WITH {events_sql()} SELECT symbol, start_idx, end_idx, event_start, event_end, n_windows, {rs('score')} FROM ev""")
def w11_cluster_events(spark, sf):
    d = detect.detections(windows(spark, sf), THRESHOLD).select("symbol", "start_idx", "end_idx", "score")
    return detection.cluster_events(d, N, CHUNK).select("symbol", "start_idx", "end_idx", "event_start", "event_end",
                                                        "n_windows", *r("score"))


def greedy_sql(src: str, n: int = N, out: str = "gre") -> str:
    """Greedy choice by recursion over the detections in score order; scores rounded to break engine noise."""
    return f"""
{out}_k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(score, 9) DESC, start_idx) AS k FROM {src}),
{out}_r(symbol, k, start_idx, taken, chosen) AS (
  SELECT symbol, k, start_idx, TRUE, [start_idx] FROM {out}_k WHERE k = 1
  UNION ALL
  SELECT n.symbol, n.k, n.start_idx, len(list_filter(p.chosen, lambda x: abs(x - n.start_idx) < {n})) = 0,
    CASE WHEN len(list_filter(p.chosen, lambda x: abs(x - n.start_idx) < {n})) = 0 THEN list_append(p.chosen, n.start_idx) ELSE p.chosen END
  FROM {out}_r p JOIN {out}_k n ON n.symbol = p.symbol AND n.k = p.k + 1),
{out} AS (SELECT d.* FROM {out}_r c JOIN {out}_k d ON d.symbol = c.symbol AND d.k = c.k WHERE taken)"""


DET9 = f"det AS (SELECT * FROM win WHERE score >= {THRESHOLD})"


def _ranked(df):
    """Scores to nine digits, so that equal shapes tie the same way in every engine."""
    return df.withColumn("score", F.round("score", 9))


@query(f"WITH RECURSIVE {windows_sql()}, {DET9}, {greedy_sql('det')} SELECT symbol, start_idx, {rs('score')} FROM gre")
def w12_nonoverlapping(spark, sf):
    d = _ranked(detect.detections(windows(spark, sf), THRESHOLD).select("symbol", "start_idx", "end_idx", "score"))
    return detection.select_nonoverlapping(d, N, chunk=CHUNK).select("symbol", "start_idx", *r("score"))


@query(f"""WITH RECURSIVE {windows_sql()}, {DET9}, {greedy_sql('det')}
SELECT symbol, start_idx, {rs('score')} FROM gre QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY k) <= 3""")
def o4_top_nonoverlapping(spark, sf):
    d = _ranked(detect.detections(windows(spark, sf), THRESHOLD).select("symbol", "start_idx", "end_idx", "score"))
    return detection.select_nonoverlapping(d, N, top=3, chunk=CHUNK).orderBy("symbol", "start_idx").select(
        "symbol", "start_idx", *r("score"))


@query(f"""WITH {idx_sql()}, m AS (SELECT symbol, min(close) AS low, max(close) - min(close) AS span FROM idx GROUP BY symbol),
s AS (SELECT symbol, bar_idx, m.low AS low, span, (close - m.low) / CASE WHEN span = 0 THEN 1.0 ELSE span END AS v FROM idx JOIN m USING (symbol))
SELECT a.symbol, a.bar_idx, round(any_value(a.v) + 3e-8, 6) + 0.0 AS target, round(sum(b.v * (b.bar_idx - a.bar_idx + 61)), 4) + 0.0 AS weighted,
round(any_value(a.v * a.span + a.low) + 3e-8, 6) + 0.0 AS restored
FROM s a JOIN s b ON a.symbol = b.symbol AND b.bar_idx BETWEEN a.bar_idx - 60 AND a.bar_idx - 1 WHERE a.bar_idx >= 60 GROUP BY a.symbol, a.bar_idx""")
def w13_lag_sequences(spark, sf):
    d = win.lag_sequences(indexed(spark, sf), "close", 60, CHUNK)
    weighted = F.aggregate(F.transform("history", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return d.select("symbol", "bar_idx", *r("target"), rounded(weighted, 4).alias("weighted"),
                    rounded(F.col("target") * F.col("span") + F.col("low") + 3e-8).alias("restored"))


def _rails(spark, sf):
    """Bars of every window with two level lines at the window's quartile-like rails (plain averages)."""
    ix = indexed(spark, sf)
    rows = win.gather(indexing.window_starts(ix, N), ix, ["high", "low", "close"])
    keys = ["symbol", "start_idx"]
    rails = rows.groupBy(*keys).agg(F.avg("high").alias("upper"), F.avg("low").alias("lower"))
    return rows.join(rails, keys)


@query(f"""WITH {windows_sql()}, rl AS (SELECT symbol, start_idx, avg(high) AS upper, avg(low) AS lower FROM wpts GROUP BY ALL),
nr AS (SELECT symbol, start_idx, pos, close >= upper - greatest(upper - lower, 1e-9) * 0.18 AS nu,
  close <= lower + greatest(upper - lower, 1e-9) * 0.18 AS nl FROM wpts JOIN rl USING (symbol, start_idx)),
ru AS (SELECT symbol, start_idx, nu AND NOT coalesce(lag(nu) OVER w, FALSE) AS vu, nl AND NOT coalesce(lag(nl) OVER w, FALSE) AS vl
  FROM nr WINDOW w AS (PARTITION BY symbol, start_idx ORDER BY pos))
SELECT symbol, start_idx, CAST(count(*) FILTER (WHERE vu) AS INT) AS touch_up, CAST(count(*) FILTER (WHERE vl) AS INT) AS touch_lo
FROM ru GROUP BY ALL""")
def w14_touch_counts(spark, sf):
    return geometry.touch_counts(_rails(spark, sf), ["symbol", "start_idx"], "close", "upper", "lower")


# --- geometry -----------------------------------------------------------------

@query(f"WITH {windows_sql()} SELECT symbol, start_idx, {rs(*FIT_COLS)} FROM win")
def g1_g3_envelope_fit(spark, sf):
    return geometry.envelope_windows(indexed(spark, sf), N, FIT, chunk=CHUNK).select("symbol", "start_idx", *r(*FIT_COLS))


@query(f"WITH {windows_sql()} SELECT symbol, start_idx, {rs(*FIT_COLS)} FROM win")
def g1_envelope_fit_sql(spark, sf):
    ix = indexed(spark, sf)
    rows = win.gather(indexing.window_starts(ix, N), ix, ["high", "low"]).where(F.col("pos") >= N - FIT)
    points = rows.withColumn("pos", F.col("pos") - (N - FIT))
    return geometry.envelope_fit_sql(points, ["symbol", "start_idx"]).select("symbol", "start_idx", *r(*FIT_COLS))


@query(f"WITH {windows_sql(N, N)} SELECT symbol, start_idx, {rs(*GEO_COLS)} FROM win")
def g2_whole_window_geometry(spark, sf):
    return geometry.with_geometry(geometry.envelope_windows(indexed(spark, sf), N, chunk=CHUNK), N).select(
        "symbol", "start_idx", *r(*GEO_COLS))


CONTAIN = ["max_excursion", "mean_excursion", "frac_outside", "spike_share"]


@query(f"WITH {windows_sql()} SELECT symbol, start_idx, touch_up, touch_lo, {rs(*CONTAIN)} FROM win")
def g4_containment(spark, sf):
    return geometry.envelope_windows(indexed(spark, sf), N, FIT, chunk=CHUNK).select(
        "symbol", "start_idx", "touch_up", "touch_lo", *r(*CONTAIN))


@query(f"""WITH {windows_sql()} SELECT symbol, start_idx, round(x_cross - {FIT - 1}, 4) + 0.0 AS apex_ahead,
round(CASE WHEN x_cross IS NOT NULL THEN a_upper + b_upper * x_cross ELSE 0.0 END, 4) + 0.0 AS apex_price,
coalesce(x_cross - {FIT - 1} <= 360, FALSE) AS apex_ok FROM win""")
def g5_p14_apex(spark, sf):
    return windows(spark, sf).select("symbol", "start_idx", rounded("apex_ahead", 4).alias("apex_ahead"),
                                     rounded("apex_price", 4).alias("apex_price"), "apex_ok")


LIVE = "(score >= threshold AND geometry)"


def _stat(e: str, digits: int, name: str, gated: bool = False) -> str:
    return f"CASE WHEN {LIVE} THEN round(CAST({e} AS DOUBLE), {digits}) + 0.0 ELSE {'NULL' if gated else '0.0'} END AS {name}"


@query(f"""WITH {decided_sql()} SELECT symbol, start_idx, pattern,
CASE WHEN {LIVE} THEN CASE WHEN pattern = 'wedge' THEN round(close * greatest(1.034 - 0.146 * mid_travel, 0.0) / 100, 4) END ELSE 0.0 END AS proj_move_usd,
{_stat('b_upper', 6, 'slope_upper')}, {_stat('b_lower', 6, 'slope_lower')},
{_stat('mid_travel', 4, 'stat_mid_travel')}, {_stat('convergence', 4, 'stat_convergence', True)},
CASE WHEN quality_gate THEN {_stat('touch_up', 0, 'q', True).rsplit(' AS ', 1)[0]} END AS stat_touch_up,
CASE WHEN quality_gate THEN {_stat('max_excursion', 4, 'q', True).rsplit(' AS ', 1)[0]} END AS stat_max_excursion FROM dec""")
def g6_p17_signal_stats(spark, sf):
    return stats_rows(spark, sf).select("symbol", "start_idx", "pattern", "proj_move_usd", "slope_upper", "slope_lower",
                                        "stat_mid_travel", "stat_convergence", "stat_touch_up", "stat_max_excursion")


@query(f"""WITH {windows_sql(N, N)}, tr AS (SELECT symbol, start_idx, regr_slope(high, pos) AS th, regr_slope(low, pos) AS tl FROM wpts GROUP BY ALL),
p AS (SELECT 'upper' AS side, th / price_range AS t, m_upper AS f FROM win JOIN tr USING (symbol, start_idx)
  UNION ALL SELECT 'lower', tl / price_range, m_lower FROM win JOIN tr USING (symbol, start_idx))
SELECT side, round(corr(t, f) + 3e-8, 6) AS pearson_r, round(avg(abs(t - f)) + 3e-8, 6) AS mae, round(avg(abs(t)) + 3e-8, 6) AS mean_abs_slope FROM p GROUP BY side""")
def g7_fit_accuracy(spark, sf):
    ix = indexed(spark, sf)
    rows = win.gather(indexing.window_starts(ix, N), ix, ["high", "low"])
    keys = ["symbol", "start_idx"]
    fits = geometry.with_geometry(geometry.envelope_windows(ix, N, chunk=CHUNK), N)
    pairs = fits.join(geometry.simple_slopes(rows, keys), keys).select(
        "m_upper", "m_lower", (F.col("slope_high") / F.col("price_range")).alias("true_upper"),
        (F.col("slope_low") / F.col("price_range")).alias("true_lower"))
    return geometry.fit_accuracy(pairs).select("side", *r("pearson_r", "mae", "mean_abs_slope"))


@query(f"""WITH {windows_sql()}, o AS (SELECT symbol, start_idx, regr_slope(high, pos) AS slope_high, regr_slope(low, pos) AS slope_low FROM wpts GROUP BY ALL)
SELECT symbol, start_idx, {rs('slope_high', 'slope_low')} FROM o""")
def g8_simple_slopes(spark, sf):
    """Slopes of all windows from prefix moments."""
    return geometry.rolling_slopes(indexed(spark, sf), N, chunk=CHUNK).select("symbol", "start_idx", *r("slope_high", "slope_low"))


# --- gates --------------------------------------------------------------------

@query(f"WITH {windows_sql()} SELECT symbol, start_idx, {CATEGORY} AS category FROM win")
def p11_category(spark, sf):
    return categorise(windows(spark, sf)).select("symbol", "start_idx", "category")


@query(f"""WITH {windows_sql()} SELECT symbol, start_idx, CASE WHEN mid_travel >= 0.15 THEN 'rising' WHEN mid_travel <= -0.15 THEN 'falling' ELSE 'flat' END AS slope FROM win""")
def p12_slope_class(spark, sf):
    return windows(spark, sf).select("symbol", "start_idx", slope_class(F.col("mid_travel")).alias("slope"))


@query(f"""WITH {windows_sql()}, c AS (SELECT *, {CATEGORY} AS category FROM win)
SELECT symbol, start_idx, CASE WHEN mid_travel < 0 THEN 'down-sloping' ELSE 'up-sloping' END AS direction FROM c WHERE category = 'CLEAN' AND mid_travel <> 0""")
def p13_direction_split(spark, sf):
    return direction_split(categorise(windows(spark, sf))).select("symbol", "start_idx", "direction")


@query(f"WITH {decided_sql()} SELECT symbol, start_idx, pattern, quality_ok FROM dec")
def p15_quality_gate(spark, sf):
    return decided(spark, sf).select("symbol", "start_idx", "pattern", "quality_ok")


@query(f"WITH {decided_sql()} SELECT symbol, start_idx, pattern, detection, signal FROM dec")
def p16_decide_documented(spark, sf):
    return decided(spark, sf).select("symbol", "start_idx", "pattern", "detection", "signal")


@query(f"WITH {decided_sql('executed')} SELECT symbol, start_idx, pattern, detection, signal FROM dec")
def p16_decide_executed(spark, sf):
    return decided(spark, sf, "executed").select("symbol", "start_idx", "pattern", "detection", "signal")


def _negative_rows(spark, sf, rule):
    return corpus.confirmed_negative(indexed(spark, sf), N, 10, rule, CHUNK).select("symbol", "start_idx", "negative", *r("slope_high", "rel_min"))


@query(f"WITH {negatives_sql()} SELECT symbol, start_idx, negative, {rs('slope_high', 'rel_min')} FROM neg")
def p18_confirmed_negative(spark, sf):
    return _negative_rows(spark, sf, "reference")


@query(f"WITH {negatives_sql('slope_low > slope_high')} SELECT symbol, start_idx, negative, {rs('slope_high', 'rel_min')} FROM neg")
def p18_confirmed_negative_corrected(spark, sf):
    return _negative_rows(spark, sf, "corrected")


# --- scoring ------------------------------------------------------------------

@query(f"WITH {windows_sql()} SELECT symbol, start_idx, {rs('score')} FROM win WHERE start_idx % 3 = 0")
def x1_score_by_expression(spark, sf):
    return detect.scan(indexed(spark, sf), N, FIT, stride=3, chunk=CHUNK).select("symbol", "start_idx", *r("score"))


@query(f"WITH {windows_sql()}, {normal_sql()} SELECT symbol, start_idx, {rs('score')} FROM (SELECT symbol, start_idx, close AS score FROM nrm WHERE pos = {N - 1})")
def x1_score_by_batch_function(spark, sf):
    def last_close(batch):
        return batch[:, -1, 3]

    return detection.score_windows(indexed(spark, sf), N, last_close, chunk=CHUNK).select("symbol", "start_idx", *r("score"))


@query(f"""WITH {windows_sql()}, {normal_sql()} SELECT w.symbol, w.start_idx, round(n.close + 3e-8, 6) + 0.0 AS score, {rs('convergence', 'max_excursion')}, w.touch_up
FROM win w JOIN nrm n ON n.symbol = w.symbol AND n.start_idx = w.start_idx AND n.pos = {N - 1} WHERE n.close >= 0.6""")
def x1_model_then_geometry(spark, sf):
    def last_close(batch):
        return batch[:, -1, 3]

    return detect.detect_with_model(indexed(spark, sf), N, last_close, 0.6, FIT, chunk=CHUNK).select(
        "symbol", "start_idx", *r("score", "convergence", "max_excursion"), "touch_up")


COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in learning.FEATURES)


@query(f"""WITH {windows_sql()} SELECT symbol, count(*) AS windows, count(*) FILTER (WHERE {COMPLETE}) AS scored, count(*) FILTER (WHERE {COMPLETE}) AS probabilities,
 0.0 AS largest_gradient FROM win GROUP BY symbol""")
def x2_window_classifier(spark, sf):
    """Spark ML classifier trained on window measures; label = the window was followed by a fall.

    The fit itself is iterative, so what is compared is its optimality (the gradient of the penalised likelihood at
    the coefficients is zero) and completeness (every window is there, scored where it has all features).
    """
    w = stored_windows(spark, sf)
    fwd = forward.forward_returns(indexed(spark, sf), [6]).select("symbol", F.col("bar_idx").alias("end_idx"), "ret_6")
    train = w.join(fwd, ["symbol", "end_idx"]).where("ret_6 is not null").withColumn("label", (F.col("ret_6") < 0).cast("int"))
    model = learning.fit_window_classifier(train)
    slope = learning.fit_gradient(train, model).agg(F.round(F.max(F.abs("gradient")), 4)).scalar()
    return learning.score_with_model(w, model).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("windows"), F.count("score").alias("scored"),
        F.count_if(F.col("score").between(0, 1)).alias("probabilities")).withColumn("largest_gradient", slope)


@query(f"""WITH RECURSIVE {windows_sql()}, {DET9.replace('score >=', 'start_idx % 5 = 0 AND score >=')}, {greedy_sql('det')}
SELECT symbol, start_idx, end_idx, {ts('date_start')}, {ts('date_end')}, {rs('score')} FROM gre
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY k) <= 5""")
def k1_detect(spark, sf):
    d = detect.detect_top(indexed(spark, sf), N, THRESHOLD, 5, 5, FIT, F.round(detection.shape_score(), 9), CHUNK)
    return d.select("symbol", "start_idx", "end_idx", text_ts("date_start").alias("date_start"),
                    text_ts("date_end").alias("date_end"), *r("score"))


@query(f"""WITH {windows_sql()}, {excursion_sql()} SELECT w.symbol, w.start_idx, {EXC_OUT}
FROM win w JOIN exc ON exc.symbol = w.symbol AND exc.bar_idx = w.end_idx WHERE score >= {THRESHOLD}""")
def k2_backtest(spark, sf):
    hits = detect.detections(windows(spark, sf), THRESHOLD).select("symbol", "start_idx", "end_idx", "score")
    return detect.backtest(indexed(spark, sf), hits, HORIZONS, chunk=CHUNK).select("symbol", "start_idx", *_exc_cols())


def summary_sql(src: str, keys: str = "") -> str:
    parts = [f"SELECT {keys}{h} AS horizon, ret_{h} AS ret, mfe_{h} AS mfe, win_{h} AS win FROM {src}" for h in HORIZONS]
    return f"""(SELECT {keys}horizon, count(*) AS n, avg(CAST(win AS INT)) * 100 AS win_rate, avg(ret) AS avg_return,
quantile_cont(ret, 0.5) AS median_return, avg(mfe) AS avg_mfe FROM ({' UNION ALL '.join(parts)}) WHERE win IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {windows_sql()}, {excursion_sql()}, bt AS (SELECT w.symbol, w.start_idx, exc.* EXCLUDE (symbol)
FROM win w JOIN exc ON exc.symbol = w.symbol AND exc.bar_idx = w.end_idx WHERE score >= {THRESHOLD})
SELECT horizon, n, {rs('win_rate', 'avg_return', 'median_return', 'avg_mfe')} FROM {summary_sql('bt')}""")
def a5_backtest_summary(spark, sf):
    study = jobs.backtest_study(indexed(spark, sf), N, THRESHOLD, HORIZONS, FIT, stride=1, chunk=CHUNK)
    return study["summary"].select("horizon", "n", *r("win_rate", "avg_return", "median_return", "avg_mfe"))


# --- baselines and samples ----------------------------------------------------

BASE = f"""base AS (SELECT symbol, end_idx FROM (SELECT symbol, bar_idx AS end_idx, n_bars,
row_number() OVER (PARTITION BY symbol ORDER BY md5(concat_ws(':', '{SEED}', symbol, CAST(bar_idx AS VARCHAR))), bar_idx) - 1 AS k
FROM idx WHERE bar_idx >= {N} AND bar_idx < n_bars - {max(HORIZONS)} - 1) WHERE k < least(20000, n_bars // 4))"""


@query(f"WITH {idx_sql()}, {BASE} SELECT symbol, end_idx FROM base")
def u3_random_baseline(spark, sf):
    return sampling.random_baseline(indexed(spark, sf), N, max(HORIZONS), SEED, F.expr("n_bars div 4"))


@query(f"""WITH {filtered_sql()} SELECT symbol, start_idx, category FROM flt
QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws(':', '{SEED}', symbol, CAST(start_idx AS VARCHAR))), symbol, start_idx) <= 8""")
def u5_random_per_category(spark, sf):
    return sampling.random_per_category(filtered(spark, sf), 8, SEED).select("symbol", "start_idx", "category")


@query(f"WITH {idx_sql()} SELECT symbol, bar_idx, close FROM idx WHERE bar_idx >= {VOL_WINDOW} AND (bar_idx - {VOL_WINDOW}) % 10 = 0")
def u6_strided_baseline(spark, sf):
    return sampling.strided_baseline(indexed(spark, sf), VOL_WINDOW, 10).select("symbol", "bar_idx", "close")


# --- spike filter -------------------------------------------------------------

SPIKE_LIMIT = 3.0


def spike_sql(src: str, limit: float = SPIKE_LIMIT) -> str:
    """One recursion step per bar; the state is the list of accepted closes and the rejection count."""
    dev = ("greatest(abs(n.open / m - 1), abs(n.high / m - 1), abs(n.low / m - 1), abs(n.close / m - 1))")
    return f"""
spk(symbol, bar_idx, accepted, closes, rejects) AS (
  SELECT symbol, bar_idx, TRUE, [close], 0 FROM {src} WHERE bar_idx = 0
  UNION ALL
  SELECT symbol, bar_idx, NOT out OR rejects >= 3,
    CASE WHEN NOT out THEN list_append(closes, close)[-10:] WHEN rejects >= 3 THEN [close] ELSE closes END,
    CASE WHEN out AND rejects < 3 THEN rejects + 1 ELSE 0 END
  FROM (SELECT n.symbol, n.bar_idx, n.close, closes, rejects, {dev} > {limit} AS out
        FROM (SELECT *, list_median(closes) AS m FROM spk) p JOIN {src} n ON n.symbol = p.symbol AND n.bar_idx = p.bar_idx + 1))"""


@query(f"WITH RECURSIVE {idx_sql()}, {spike_sql('idx')} SELECT symbol, bar_idx, accepted FROM spk")
def t2_spike_filter_batch(spark, sf):
    return spikes.spike_filter(indexed(spark, sf), SPIKE_LIMIT, chunk=128, warmup=24).select("symbol", "bar_idx", "accepted")
