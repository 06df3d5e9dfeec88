"""Study reports: returns, rates, correlations, whole studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeforge.functions.binning import linear_edges
from tapeforge.operators import forward, sampling
from tapeforge.operators.gates import direction_split
from tapeforge.plans import detect, jobs, studies
from tapeforge.session import cut_lineage
from workload.base import (CHUNK, FIT, GAP_EDGES, HORIZONS, LOOKBACK, N, SEED, STRIDE, THRESHOLD, VOL_WINDOW,
                           clustered_sql, events, events_sql, filtered, filtered_sql, forward_sql, idx_sql, indexed, query, r, rs,
                           stored_windows, text_ts, ts, windows, windows_sql)
from workload.shapes import BASE, SIGMA, STRICT, excursion_sql, greedy_sql, summary_sql

RETURN_COLS = ["mean", "median", "mean_abs", "win_pct", "p5", "p95"]
RETURN_AGG = """count(ret) AS n, avg(ret) AS mean, quantile_cont(ret, 0.5) AS median, avg(abs(ret)) AS mean_abs,
avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) * 100 AS win_pct, quantile_cont(ret, 0.05) AS p5, quantile_cont(ret, 0.95) AS p95"""
Z_COLS = ["mean_abs_z", "median_abs_z", "mean_z", "beyond_1_pct"]
Z_AGG = """count(z) AS n, avg(abs(z)) AS mean_abs_z, quantile_cont(abs(z), 0.5) AS median_abs_z, avg(z) AS mean_z,
avg(CASE WHEN abs(z) > 1 THEN 1.0 ELSE 0.0 END) * 100 AS beyond_1_pct"""


def long_sql(src: str, keys: str, fields=("ret",), horizons=HORIZONS) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, {h} AS horizon, " + ", ".join(f"{f}_{h} AS {f}" for f in fields) + f" FROM {src}" for h in horizons)


def zfwd_sql() -> str:
    z = ", ".join(f"CASE WHEN sigma > 1e-9 THEN ret_{h} / (sigma * sqrt({h})) END AS z_{h}" for h in HORIZONS)
    return f"{SIGMA}, {forward_sql()}, zf AS (SELECT fwd.*, {z} FROM fwd JOIN sg USING (symbol, bar_idx))"


GROUPS = f"""{filtered_sql()}, {BASE}, {zfwd_sql()},
grp AS (SELECT symbol, end_idx, category AS grp FROM flt
  UNION ALL SELECT symbol, end_idx, CASE WHEN mid_travel < 0 THEN 'CLEAN down-sloping' ELSE 'CLEAN up-sloping' END FROM flt WHERE category = 'CLEAN' AND mid_travel <> 0
  UNION ALL SELECT symbol, end_idx, 'RANDOM' FROM base),
outc AS (SELECT grp, zf.* FROM grp JOIN zf ON zf.symbol = grp.symbol AND zf.bar_idx = grp.end_idx),
lng AS ({long_sql('outc', 'grp', ('ret', 'z'))})"""


def _outcomes(spark, sf):
    ev, ix = filtered(spark, sf), indexed(spark, sf)
    base = sampling.random_baseline(ix, N, max(HORIZONS), SEED, F.expr("n_bars div 4")).withColumn("group", F.lit("RANDOM"))
    split = _by_direction(ev)
    groups = ev.select("symbol", "end_idx", F.col("category").alias("group")).unionByName(split).unionByName(base)
    return cut_lineage(jobs.grouped_outcomes(groups, ix, HORIZONS, LOOKBACK))


def _by_direction(ev):
    return direction_split(ev).select("symbol", "end_idx", F.concat(F.lit("CLEAN "), "direction").alias("group"))


@query(f"WITH {GROUPS} SELECT grp, horizon, n, {rs(*RETURN_COLS)} FROM (SELECT grp, horizon, {RETURN_AGG} FROM lng WHERE ret IS NOT NULL GROUP BY ALL)")
def a3_return_summary(spark, sf):
    d = studies.return_summary(_outcomes(spark, sf), ["group", "horizon"])
    return d.select(F.col("group").alias("grp"), "horizon", "n", *r(*RETURN_COLS))


@query(f"WITH {GROUPS} SELECT grp, horizon, n, {rs(*Z_COLS)} FROM (SELECT grp, horizon, {Z_AGG} FROM lng WHERE z IS NOT NULL GROUP BY ALL)")
def a4_z_summary(spark, sf):
    d = studies.z_summary(_outcomes(spark, sf), ["group", "horizon"])
    return d.select(F.col("group").alias("grp"), "horizon", "n", *r(*Z_COLS))


@query(f"WITH {GROUPS} SELECT grp, horizon, n, n > 40 AS enough, {rs('mean')} FROM (SELECT grp, horizon, {RETURN_AGG} FROM lng WHERE ret IS NOT NULL GROUP BY ALL)")
def p22_minimum_samples(spark, sf):
    d = studies.at_least(studies.return_summary(_outcomes(spark, sf), ["group", "horizon"]), 40)
    return d.select(F.col("group").alias("grp"), "horizon", "n", "enough", *r("mean"))


@query(f"""WITH {filtered_sql()} SELECT coalesce(category, 'TOTAL') AS category, count(*) AS n,
round(count(*) * 100 / (SELECT CAST(count(*) AS DOUBLE) FROM flt) + 3e-8, 6) AS share_pct FROM flt GROUP BY ROLLUP (category)""")
def a6_category_shares(spark, sf):
    return studies.category_shares(filtered(spark, sf)).select("category", "n", *r("share_pct"))


EXC_QUANT = ["p10", "p25", "p50", "p75", "p90", "p95", "outside_median", "outside_p90"]


@query(f"WITH {windows_sql()} SELECT symbol, " + ", ".join(
    f"round(quantile_cont(max_excursion, 0.{p[1:]}) + 3e-8, 6) + 0.0 AS {p}" for p in EXC_QUANT[:6])
       + ", round(quantile_cont(frac_outside, 0.5) + 3e-8, 6) AS outside_median, round(quantile_cont(frac_outside, 0.9) + 3e-8, 6) AS outside_p90 FROM win GROUP BY symbol")
def a7_excursion_quantiles(spark, sf):
    return studies.excursion_quantiles(stored_windows(spark, sf), ["symbol"]).select("symbol", *r(*EXC_QUANT))


BUCKET_COLS = [*[f"mean_abs_{h}" for h in HORIZONS], "focus_win_pct", "focus_mean"]


@query(f"""WITH {windows_sql()}, {forward_sql()}, c AS (SELECT win.convergence, fwd.* FROM win JOIN fwd ON fwd.symbol = win.symbol AND fwd.bar_idx = win.end_idx
 WHERE score >= {THRESHOLD} AND convergence >= 0)
SELECT CAST(floor(convergence / CAST(0.1 AS DOUBLE)) AS INT) AS bucket, count(*) AS n, count(*) < 20 AS thin,
{', '.join(f'round(avg(abs(ret_{h})) + 3e-8, 6) + 0.0 AS mean_abs_{h}' for h in HORIZONS)},
round(avg(CASE WHEN ret_12 > 0 THEN 1.0 WHEN ret_12 <= 0 THEN 0.0 END) * 100 + 3e-8, 6) + 0.0 AS focus_win_pct, round(avg(ret_12) + 3e-8, 6) + 0.0 AS focus_mean FROM c GROUP BY ALL""")
def a8_convergence_buckets(spark, sf):
    hits = detect.detections(windows(spark, sf), THRESHOLD)
    fwd = forward.forward_returns(indexed(spark, sf), HORIZONS).select(
        "symbol", F.col("bar_idx").alias("end_idx"), *[f"ret_{h}" for h in HORIZONS])
    return studies.convergence_buckets(hits.join(fwd, ["symbol", "end_idx"]), HORIZONS, 12).select(
        "bucket", "n", "thin", *r(*BUCKET_COLS))


RATES = f"""rates AS (SELECT *, detections / windows AS rate, detections / windows / (sum(detections) OVER w / sum(windows) OVER w) AS vs_overall
FROM (SELECT symbol, CAST(floor(session_minute / 60) AS INT) AS bin, count(*) AS windows, count(*) FILTER (WHERE score >= {THRESHOLD}) AS detections FROM win GROUP BY ALL)
WINDOW w AS (PARTITION BY symbol))"""


@query(f"WITH {windows_sql()}, {RATES} SELECT symbol, bin, windows, detections, {rs('rate', 'vs_overall')} FROM rates")
def a9_rate_by_minute(spark, sf):
    return studies.rate_by_minute(windows(spark, sf), THRESHOLD, 60).select("symbol", "bin", "windows", "detections",
                                                                            *r("rate", "vs_overall"))


@query(f"""WITH {windows_sql()}, {RATES}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rate DESC, bin DESC) AS k FROM rates)
SELECT symbol, count(*) AS bins, count(*) FILTER (WHERE rate = 0) AS silent_bins, round(max(rate) / min(rate) FILTER (WHERE rate > 0) + 3e-8, 6) AS swing,
round(sum(detections) FILTER (WHERE k <= 2) / greatest(sum(detections), 1) + 3e-8, 6) AS top2_share FROM k GROUP BY symbol""")
def a10_rate_concentration(spark, sf):
    d = studies.rate_concentration(studies.rate_by_minute(windows(spark, sf), THRESHOLD, 60))
    return d.select("symbol", "bins", "silent_bins", *r("swing", "top2_share"))


POPULATION = "pop AS (SELECT * FROM win)"
YEARS = "yrs AS (SELECT symbol, floor((epoch(max(ts)) - epoch(min(ts))) / 86400) / 365.25 AS years FROM idx GROUP BY symbol)"
GEO_REPORT = f"""{YEARS}, {POPULATION}, g1 AS (SELECT symbol, count(*) AS n, avg(CASE WHEN convergence < 0 THEN 1.0 ELSE 0.0 END) AS diverging,
 quantile_cont(convergence, 0.5) AS convergence_median, quantile_cont(1 - convergence, 0.5) AS compression_median FROM ev GROUP BY symbol),
g2 AS (SELECT symbol, count(*) AS n_pop, avg(CASE WHEN convergence < 0 THEN 1.0 ELSE 0.0 END) AS diverging_pop,
 quantile_cont(convergence, 0.5) AS convergence_median_pop, quantile_cont(1 - convergence, 0.5) AS compression_median_pop FROM pop GROUP BY symbol),
geor AS (SELECT *, n / greatest(years, 1e-9) AS events_per_year FROM g1 JOIN g2 USING (symbol) JOIN yrs USING (symbol))"""
GEO_COLS = ["diverging", "diverging_pop", "convergence_median", "convergence_median_pop", "compression_median",
            "compression_median_pop", "events_per_year"]


def _study_inputs(spark, sf):
    w = stored_windows(spark, sf)
    return w, cut_lineage(detect.find_events(w, N, THRESHOLD, CHUNK)), w


@query(f"WITH {events_sql()}, {GEO_REPORT} SELECT symbol, n, n_pop, {rs(*GEO_COLS)} FROM geor")
def a11_geometry_report(spark, sf):
    _, ev, pop = _study_inputs(spark, sf)
    return studies.geometry_report(ev, pop, studies.series_years(indexed(spark, sf))).select("symbol", "n", "n_pop", *r(*GEO_COLS))


# Gap-spanning share needs windows shorter than a day to vary: 12-bar windows.
GAPS = f"""{idx_sql()}, gw AS (SELECT a.symbol, a.bar_idx AS start_idx, b.bar_idx AS end_idx, b.day_no - a.day_no AS n_gaps,
 CASE WHEN b.day_no > a.day_no THEN a.next_day_idx - a.bar_idx ELSE -1 END AS gap_pos, b.close > a.close AS rose
 FROM idx a JOIN idx b ON a.symbol = b.symbol AND b.bar_idx = a.bar_idx + 11)"""


def _gap_windows(spark, sf):
    """12-bar windows with their gaps; 'events' are those that closed higher than they began."""
    fits = detect.envelope_windows(indexed(spark, sf), 12, carry=["day_no", "close"],
                                   carry_start=["day_no", "next_day_idx", "close"], chunk=CHUNK)
    w = forward.gap_columns(fits).select("symbol", "start_idx", "n_gaps", "gap_pos",
                                         (F.col("close") > F.col("close_start")).alias("rose"))
    return w


@query(f"""WITH {GAPS}, s AS (SELECT symbol, avg(CASE WHEN n_gaps > 0 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN rose THEN CASE WHEN n_gaps > 0 THEN 1.0 ELSE 0.0 END END) AS e FROM gw GROUP BY symbol)
SELECT symbol, round(e + 3e-8, 6) AS gap_share, round(p + 3e-8, 6) AS gap_share_pop, round(e / greatest(p, 1e-9) + 3e-8, 6) AS rate_ratio, round(1 / greatest(p, 1e-9) + 3e-8, 6) AS max_ratio,
round(e / greatest(1 - e, 1e-9) / greatest(p / greatest(1 - p, 1e-9), 1e-9) + 3e-8, 6) AS odds_ratio FROM s""")
def a12_gap_enrichment(spark, sf):
    w = _gap_windows(spark, sf)
    return studies.gap_enrichment(w.where("rose"), w).select(
        "symbol", *r("gap_share", "gap_share_pop", "rate_ratio", "max_ratio", "odds_ratio"))


GAP_STATS = ["mean", "inside_fit", "p10", "p25", "median", "p75", "p90"]
SIDES = "sd AS (SELECT symbol, 'events' AS side, gap_pos FROM ev WHERE gap_pos >= 0 UNION ALL SELECT symbol, 'population', gap_pos FROM pop WHERE gap_pos >= 0)"


@query(f"""WITH {events_sql()}, {POPULATION}, {SIDES} SELECT symbol, side, count(*) AS n, round(avg(gap_pos) + 3e-8, 6) AS mean,
round(avg(CASE WHEN gap_pos >= {N - FIT} THEN 1.0 ELSE 0.0 END) + 3e-8, 6) AS inside_fit,
{', '.join(f'round(quantile_cont(CAST(gap_pos AS DOUBLE), {q}) + 3e-8, 6) AS {n}' for n, q in (('p10', .1), ('p25', .25), ('median', .5), ('p75', .75), ('p90', .9)))}
FROM sd GROUP BY ALL""")
def a13_gap_position(spark, sf):
    _, ev, pop = _study_inputs(spark, sf)
    return studies.gap_position_summary(ev, pop, N, FIT).select("symbol", "side", "n", *r(*GAP_STATS))


_BIN = "CASE " + " ".join(f"WHEN gap_pos < {hi} THEN {i}" for i, hi in enumerate(GAP_EDGES[1:])) + " END"


@query(f"""WITH {events_sql()}, {POPULATION}, {SIDES}, t AS (SELECT symbol, count(*) FILTER (WHERE side = 'events') AS te, count(*) FILTER (WHERE side = 'population') AS tp FROM sd GROUP BY symbol),
c AS (SELECT symbol, CAST({_BIN} AS INT) AS bin, count(*) FILTER (WHERE side = 'events') AS e, count(*) FILTER (WHERE side = 'population') AS p FROM sd GROUP BY ALL)
SELECT symbol, bin, round(e / te + 3e-8, 6) AS share, round(p / tp + 3e-8, 6) AS share_pop, round(CASE WHEN p > 0 THEN (e / te) / (p / tp) END + 3e-8, 6) AS enrichment FROM c JOIN t USING (symbol)""")
def a13_gap_histogram(spark, sf):
    _, ev, pop = _study_inputs(spark, sf)
    return studies.gap_position_histogram(ev, pop, GAP_EDGES).select("symbol", "bin", *r("share", "share_pop", "enrichment"))


BANDS = f"""bands AS (SELECT *, detections / windows AS rate, CASE WHEN sum(detections) OVER w > 0 THEN detections / windows / (sum(detections) OVER w / sum(windows) OVER w) END AS vs_overall FROM (
 SELECT symbol, CAST(CASE WHEN vol_trend < 0.5 THEN 0 WHEN vol_trend < 0.75 THEN 1 WHEN vol_trend < 1 THEN 2 WHEN vol_trend < 1.5 THEN 3 ELSE 4 END AS INT) AS band,
 count(*) AS windows, count(*) FILTER (WHERE score >= {THRESHOLD}) AS detections FROM win WHERE vol_trend IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY symbol))"""


@query(f"WITH {windows_sql()}, {BANDS} SELECT symbol, band, windows, detections, {rs('rate', 'vs_overall')} FROM bands")
def a14_volatility_bands(spark, sf):
    return studies.volatility_bands(windows(spark, sf), THRESHOLD).select("symbol", "band", "windows", "detections",
                                                                          *r("rate", "vs_overall"))


@query(f"""WITH {events_sql()}, {BANDS} SELECT symbol, round(swing + 3e-8, 6) AS swing, round(md + 3e-8, 6) AS median_detections, round(mp + 3e-8, 6) AS median_population,
CAST(n_events AS DOUBLE) AS n_events, n_events > 5 AS enough, round(rc + 3e-8, 6) + 0.0 AS r_convergence
FROM (SELECT symbol, max(rate) / min(rate) FILTER (WHERE rate > 0) AS swing FROM bands GROUP BY symbol) a
LEFT JOIN (SELECT symbol, quantile_cont(vol_trend, 0.5) AS mp, quantile_cont(vol_trend, 0.5) FILTER (WHERE score >= {THRESHOLD}) AS md FROM win GROUP BY symbol) b USING (symbol)
LEFT JOIN (SELECT symbol, count(*) AS n_events, corr(vol_trend, convergence) AS rc FROM ev WHERE vol_trend IS NOT NULL GROUP BY symbol) c USING (symbol)""")
def a14_volatility_summary(spark, sf):
    w = stored_windows(spark, sf)
    d = studies.volatility_summary(w, detect.find_events(w, N, THRESHOLD, CHUNK), THRESHOLD)
    return d.select("symbol", *r("swing", "median_detections", "median_population"),
                    F.col("n_events").cast("double").alias("n_events"), "enough", *r("r_convergence"))


CORR_FEATURES = ["travel_upper", "travel_lower", "convergence", "score"]


def corr_sql(src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {h} AS horizon, '{f}' AS feature, count(ret_{h}) AS n, round(corr({f}, ret_{h}) + 3e-8, 6) + 0.0 AS r_signed, "
        f"round(corr({f}, abs(ret_{h})) + 3e-8, 6) + 0.0 AS r_size FROM {src} WHERE ret_{h} IS NOT NULL"
        for h in HORIZONS for f in CORR_FEATURES)


@query(f"""WITH {events_sql()}, {forward_sql()}, o AS (SELECT ev.travel_upper, ev.travel_lower, ev.convergence, ev.score, fwd.* FROM ev JOIN fwd ON fwd.symbol = ev.symbol AND fwd.bar_idx = ev.end_idx)
{corr_sql('o')}""")
def a15_correlations(spark, sf):
    long = forward.forward_lookup(events(spark, sf), indexed(spark, sf), HORIZONS)
    return studies.correlations(long, CORR_FEATURES, ["horizon"]).select("horizon", "feature", "n", *r("r_signed", "r_size"))


SLOPES = ["travel_upper", "travel_lower", "mid_travel"]
H = 12
BASE_MEDIAN = f"""{forward_sql([H])}, bm AS (SELECT quantile_cont(abs(ret_{H}), 0.5) AS base_median FROM fwd
 WHERE bar_idx >= {VOL_WINDOW} AND (bar_idx - {VOL_WINDOW}) % {STRIDE} = 0 AND ret_{H} IS NOT NULL)"""
ROUNDED = ", ".join(f"round({f}, 9) AS {f}" for f in SLOPES)
NONDUD = f"""{BASE_MEDIAN}, nd AS (SELECT {ROUNDED}, abs(ret_{H}) AS y FROM win JOIN fwd ON fwd.symbol = win.symbol AND fwd.bar_idx = win.end_idx
 WHERE score >= {THRESHOLD} AND abs(ret_{H}) >= (SELECT base_median FROM bm))"""


def _nondud(spark, sf):
    # Neighbouring windows often share their kept points, so slopes tie exactly;
    # nine digits make such ties equal in every engine before they are ranked.
    hits = detect.detections(stored_windows(spark, sf), THRESHOLD).withColumns({f: F.round(f, 9) for f in SLOPES})
    return jobs.nondud_projection(hits, indexed(spark, sf), H, VOL_WINDOW, STRIDE)


FIT_OUT = ["slope", "intercept", "pearson_r", "r_squared", "stderr"]


@query(f"WITH {windows_sql()}, {NONDUD} " + " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, count(*) AS n, round(regr_slope(y, {f}) + 3e-8, 6) + 0.0 AS slope, round(regr_intercept(y, {f}) + 3e-8, 6) AS intercept, round(corr({f}, y) + 3e-8, 6) + 0.0 AS pearson_r,
round(regr_r2(y, {f}) + 3e-8, 6) AS r_squared, round(sqrt((1 - regr_r2(y, {f})) * regr_syy(y, {f}) / regr_sxx(y, {f}) / (count(*) - 2)) + 3e-8, 6) AS stderr FROM nd""" for f in SLOPES))
def a16_linear_fits(spark, sf):
    return _nondud(spark, sf)["fits"].select("feature", "n", *r(*FIT_OUT))


def avg_rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(f"WITH {windows_sql()}, {NONDUD} " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(corr(rx, ry) + 3e-8, 6) + 0.0 AS spearman_rho FROM (SELECT {avg_rank(f)} AS rx, {avg_rank('y')} AS ry FROM nd)" for f in SLOPES))
def a17_spearman(spark, sf):
    return _nondud(spark, sf)["ranks"].select("feature", *r("spearman_rho"))


@query(f"WITH {idx_sql()}, {BASE_MEDIAN} SELECT round(base_median + 3e-8, 6) AS base_median FROM bm")
def a18_baseline_median(spark, sf):
    d = forward.forward_returns(indexed(spark, sf), [H])
    return studies.baseline_median(d, f"ret_{H}", VOL_WINDOW, STRIDE).select(*r("base_median"))


ABS = f"""{forward_sql()}, {STRICT}, ab AS ({' UNION ALL '.join(
    f"SELECT fwd.symbol, fwd.bar_idx, {h} AS horizon, abs(ret_{h}) AS abs_ret, abs(ret_{h}) / (sigma_strict * sqrt({h}) * 100) AS abs_z FROM fwd JOIN st USING (symbol, bar_idx) WHERE ret_{h} IS NOT NULL" for h in HORIZONS)}),
evh AS (SELECT ab.*, win.mid_travel FROM ab JOIN win ON win.symbol = ab.symbol AND win.end_idx = ab.bar_idx WHERE score >= {THRESHOLD})"""


def _vol_control(spark, sf):
    hits = detect.detections(stored_windows(spark, sf), THRESHOLD)
    return jobs.volatility_control(hits, indexed(spark, sf), HORIZONS, VOL_WINDOW, STRIDE)


DUD = ["base_median_raw", "base_median_z", "event_median_raw", "event_median_z", "dud_raw", "dud_z"]


@query(f"""WITH {windows_sql()}, {ABS}, m AS (SELECT horizon, quantile_cont(abs_ret, 0.5) AS base_median_raw, quantile_cont(abs_z, 0.5) AS base_median_z FROM ab
 WHERE bar_idx >= {VOL_WINDOW} AND (bar_idx - {VOL_WINDOW}) % {STRIDE} = 0 GROUP BY horizon)
SELECT horizon, n, {rs(*DUD)} FROM (SELECT horizon, count(*) AS n, any_value(base_median_raw) AS base_median_raw, any_value(base_median_z) AS base_median_z,
 quantile_cont(abs_ret, 0.5) AS event_median_raw, quantile_cont(abs_z, 0.5) AS event_median_z,
 avg(CASE WHEN abs_ret < base_median_raw THEN 1.0 ELSE 0.0 END) * 100 AS dud_raw, avg(CASE WHEN coalesce(abs_z < base_median_z, FALSE) THEN 1.0 ELSE 0.0 END) * 100 AS dud_z
 FROM evh JOIN m USING (horizon) GROUP BY horizon)""")
def a19_dud_rates(spark, sf):
    return _vol_control(spark, sf)["duds"].select("horizon", "n", *r(*DUD))


@query(f"""WITH {windows_sql()}, {ABS}, q AS (SELECT {', '.join(f'quantile_cont(mid_travel, {i / 5}) AS q{i}' for i in range(1, 5))} FROM win WHERE score >= {THRESHOLD})
SELECT horizon, CASE WHEN mid_travel <= q1 THEN 1 WHEN mid_travel <= q2 THEN 2 WHEN mid_travel <= q3 THEN 3 WHEN mid_travel <= q4 THEN 4 ELSE 5 END AS quintile,
count(abs_z) AS n, round(avg(abs_z) + 3e-8, 6) AS mean_z FROM evh CROSS JOIN q GROUP BY ALL""")
def a20_quintile_means(spark, sf):
    return _vol_control(spark, sf)["quintiles"].select("horizon", "quintile", "n", *r("mean_z"))


def hist_sql(src: str, value: str, clip: str, bins: int, keys: str) -> str:
    v = f"greatest(least({value}, {clip}), -({clip}))"
    b = f"least(CAST(floor(({v} + {clip}) / (2 * {clip}) * {bins}) AS INT), {bins - 1})"
    return f"""SELECT {keys}, bin, n, round(n / (sum(n) OVER (PARTITION BY {keys}) * width) + 3e-8, 6) AS density FROM (
 SELECT {keys}, {b} AS bin, count(*) AS n, max(2 * {clip} / {bins}) AS width FROM {src} WHERE {value} IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {GROUPS} {hist_sql('lng', 'z', 'CAST(4.0 AS DOUBLE)', 60, 'grp, horizon')}")
def a29_z_histograms(spark, sf):
    d = studies.clipped_histograms(_outcomes(spark, sf), ["group", "horizon"], "z", 4.0, len(linear_edges(-4, 4, 61)) - 1)
    return d.select(F.col("group").alias("grp"), "horizon", "bin", "n", *r("density"))


SLOPE_GROUPS = f"""{filtered_sql()}, {BASE}, {forward_sql()}, grp AS (SELECT symbol, end_idx, CASE WHEN mid_travel >= 0.15 THEN 'rising' WHEN mid_travel <= -0.15 THEN 'falling' ELSE 'flat' END AS grp FROM flt
 UNION ALL SELECT symbol, end_idx, 'random' FROM base),
outc AS (SELECT grp, fwd.* FROM grp JOIN fwd ON fwd.symbol = grp.symbol AND fwd.bar_idx = grp.end_idx), lng AS ({long_sql('outc', 'grp')})"""


def _slope_returns(spark, sf):
    return jobs.slope_returns(filtered(spark, sf), indexed(spark, sf), HORIZONS, N, SEED, category=None,
                              baseline_size=F.expr("n_bars div 4"))


@query(f"WITH {SLOPE_GROUPS} SELECT grp, horizon, n, {rs(*RETURN_COLS)} FROM (SELECT grp, horizon, {RETURN_AGG} FROM lng WHERE ret IS NOT NULL GROUP BY ALL)")
def k6_slope_returns(spark, sf):
    return _slope_returns(spark, sf)["summary"].select(F.col("group").alias("grp"), "horizon", "n", *r(*RETURN_COLS))


@query(f"""WITH {SLOPE_GROUPS}, cl AS (SELECT horizon, quantile_cont(abs(ret), 0.99) AS clip FROM lng WHERE grp = 'random' AND ret IS NOT NULL GROUP BY horizon),
lc AS (SELECT * FROM lng JOIN cl USING (horizon)) {hist_sql('lc', 'ret', 'clip', 54, 'grp, horizon')}""")
def a29_return_histograms(spark, sf):
    return _slope_returns(spark, sf)["histograms"].select(F.col("group").alias("grp"), "horizon", "bin", "n", *r("density"))


SUMMARY = ["events_per_year", "diverging_frac", "compression_median", "compression_median_pop", "gap_share", "gap_share_pop",
           "gap_rate_ratio", "vol_trend_median", "vol_trend_median_pop"]


@query(f"""WITH {events_sql()}, {GEO_REPORT}, c AS (SELECT symbol, count(*) AS n_windows, count(*) FILTER (WHERE score >= {THRESHOLD}) AS n_positives,
 quantile_cont(vol_trend, 0.5) AS vol_trend_median_pop FROM win GROUP BY symbol),
e AS (SELECT symbol, avg(CASE WHEN n_gaps > 0 THEN 1.0 ELSE 0.0 END) AS gap_share, quantile_cont(vol_trend, 0.5) AS vol_trend_median FROM ev GROUP BY symbol),
p AS (SELECT symbol, avg(CASE WHEN n_gaps > 0 THEN 1.0 ELSE 0.0 END) AS gap_share_pop FROM pop GROUP BY symbol)
SELECT symbol, n_windows, n_positives, n AS n_events, round(events_per_year + 3e-8, 6) AS events_per_year, round(diverging + 3e-8, 6) AS diverging_frac,
 {rs(*[c for c in SUMMARY if c not in ('events_per_year', 'diverging_frac', 'gap_rate_ratio')])}, round(gap_share / greatest(gap_share_pop, 1e-9) + 3e-8, 6) AS gap_rate_ratio
FROM c JOIN geor USING (symbol) JOIN e USING (symbol) JOIN p USING (symbol)""")
def a34_k3_detection_study(spark, sf):
    w, ev, pop = _study_inputs(spark, sf)
    d = studies.run_summary(w, ev, pop, studies.series_years(indexed(spark, sf)), THRESHOLD)
    return d.select("symbol", "n_windows", "n_positives", "n_events", *r(*SUMMARY))


@query(f"""WITH {filtered_sql()}, {forward_sql()} SELECT flt.symbol, start_idx, round(ret_12 + 3e-8, 6) + 0.0 AS ret_12, category FROM flt JOIN fwd ON fwd.symbol = flt.symbol AND fwd.bar_idx = flt.end_idx
WHERE ret_12 IS NOT NULL ORDER BY ret_12, flt.symbol, start_idx LIMIT 12""")
def o3_worst_returns(spark, sf):
    fwd = forward.forward_returns(indexed(spark, sf), [12]).select("symbol", F.col("bar_idx").alias("end_idx"), "ret_12")
    d = filtered(spark, sf).join(fwd, ["symbol", "end_idx"])
    return studies.worst_returns(d, "ret_12", 12).select("symbol", "start_idx", *r("ret_12"), "category")


@query(f"WITH {filtered_sql()} SELECT symbol, {ts('date_start')}, {ts('date_end')}, touch_up, touch_lo, category, {rs('score', 'convergence', 'max_excursion', 'spike_share')} FROM flt")
def k4_filter_study_events(spark, sf):
    ev = events(spark, sf)
    return jobs.filtered_events(ev, indexed(spark, sf), N, FIT, CHUNK).select(
        "symbol", text_ts("date_start").alias("date_start"), text_ts("date_end").alias("date_end"), "touch_up", "touch_lo",
        "category", *r("score", "convergence", "max_excursion", "spike_share"))


def _filter_study(spark, sf):
    """The whole job on the detected events, with the baseline of the sampling operator."""
    return jobs.filter_study(events(spark, sf), indexed(spark, sf), N, FIT, HORIZONS, LOOKBACK, SEED, CHUNK,
                             baseline_size=F.expr("n_bars div 4"))


@query(f"WITH {GROUPS} SELECT grp, horizon, n, {rs(*RETURN_COLS)} FROM (SELECT grp, horizon, {RETURN_AGG} FROM lng WHERE ret IS NOT NULL GROUP BY ALL)")
def k4_filter_study_returns(spark, sf):
    return _filter_study(spark, sf)["returns"].select(F.col("group").alias("grp"), "horizon", "n", *r(*RETURN_COLS))


@query(f"""WITH {filtered_sql()}, {forward_sql()}, c AS (SELECT flt.convergence, fwd.* FROM flt JOIN fwd ON fwd.symbol = flt.symbol AND fwd.bar_idx = flt.end_idx WHERE category = 'CLEAN')
""" + " UNION ALL ".join(f"SELECT {h} AS horizon, count(*) AS n, round(corr(convergence, abs(ret_{h})) + 3e-8, 6) + 0.0 AS r_size FROM c WHERE ret_{h} IS NOT NULL HAVING count(*) > 0" for h in HORIZONS))
def k4_filter_study_correlations(spark, sf):
    return _filter_study(spark, sf)["correlations"].select("horizon", "n", *r("r_size"))


@query(f"WITH {windows_sql()}, {RATES} SELECT symbol, bin, windows, detections, {rs('rate', 'vs_overall')} FROM rates")
def k3_detection_study_rates(spark, sf):
    study = jobs.detection_study(indexed(spark, sf), N, THRESHOLD, FIT, bin_minutes=60, chunk=CHUNK)
    return study["rate_by_minute"].select("symbol", "bin", "windows", "detections", *r("rate", "vs_overall"))


@query(f"""WITH {windows_sql(N, N, 'a.bar_idx % 2 = 0')}, det AS (SELECT * FROM win WHERE score >= 0.7),{clustered_sql('det', 'ev')}, {forward_sql()},
o AS (SELECT ev.travel_upper, ev.travel_lower, ev.convergence, ev.score, fwd.* FROM ev JOIN fwd ON fwd.symbol = ev.symbol AND fwd.bar_idx = ev.end_idx) SELECT *, n >= 10 AS enough FROM ({corr_sql('o')})""")
def k5_slope_study(spark, sf):
    return jobs.slope_study(indexed(spark, sf), N, 0.7, HORIZONS, stride=2, chunk=CHUNK).select(
        "horizon", "feature", "n", "enough", *r("r_signed", "r_size"))


@query(f"""WITH {windows_sql()}, {ABS} SELECT horizon, round(corr(mid_travel, abs_z) + 3e-8, 6) + 0.0 AS r_travel_z FROM evh WHERE abs_z IS NOT NULL GROUP BY horizon""")
def k7_volatility_control(spark, sf):
    return _vol_control(spark, sf)["correlation"].select("horizon", *r("r_travel_z"))


@query(f"""WITH {windows_sql()}, {NONDUD} SELECT 'mid_travel' AS feature, count(*) AS n, round(regr_intercept(y, mid_travel) + 3e-8, 6) AS intercept,
round(regr_slope(y, mid_travel) + 3e-8, 6) + 0.0 AS slope FROM nd""")
def k8_nondud_projection(spark, sf):
    return _nondud(spark, sf)["fits"].where("feature = 'mid_travel'").select("feature", "n", *r("intercept", "slope"))


def _renamed(sql: str, size: int) -> str:
    return f"SELECT horizon, round(win_rate + 3e-8, 6) AS win_rate_{size}bar, round(avg_return + 3e-8, 6) + 0.0 AS avg_return_{size}bar, CAST(n AS DOUBLE) AS n_{size}bar FROM {sql}"


SIZES = [20, 30]


def _size_sql(size: int) -> str:
    chain = windows_sql(size, size, f"a.bar_idx % {max(1, size // 25)} = 0")
    return f"""(WITH RECURSIVE {chain}, det AS (SELECT * FROM win WHERE score >= {THRESHOLD}), {greedy_sql('det', size)}, {excursion_sql(None)},
bt AS (SELECT g.symbol AS s, exc.* EXCLUDE (symbol) FROM gre g JOIN exc ON exc.symbol = g.symbol AND exc.bar_idx = g.end_idx) {_renamed(summary_sql('bt'), size)})"""


@query(f"SELECT * FROM {_size_sql(SIZES[0])} a FULL JOIN {_size_sql(SIZES[1])} b USING (horizon)")
def j9_x3_compare_windows(spark, sf):
    parts = jobs.detect.compare_windows(indexed(spark, sf), SIZES, THRESHOLD, HORIZONS, CHUNK)
    cols = [c for s in SIZES for c in (f"win_rate_{s}bar", f"avg_return_{s}bar")]
    return parts.select("horizon", *r(*cols), *[F.col(f"n_{s}bar").cast("double").alias(f"n_{s}bar") for s in SIZES])
