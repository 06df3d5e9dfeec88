"""Sources, sinks, projections, joins and serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeforge.functions.scalars import lenient_number, parse_assignments, resolve_thresholds
from tapeforge.operators import indexing
from tapeforge.operators.forward import forward_lookup
from tapeforge.operators.gates import per_formation
from tapeforge.operators.windows import gather
from tapeforge.plans import corpus, jobs, serving
from tapeforge.schemas import CORPUS, FEATURE_COLS, KEY_BARS, KEY_SCORES, SCORES
from tapeforge.session import scratch_path
from tapeforge.sources import bars as bar_sources
from tapeforge.sources import corpus as corpus_sources
from tapeforge.sources import days
from tapeforge.sources import tables as stored
from workload.base import (FORMS, HORIZONS, N, SEED, THRESHOLD, _lit, bars, bars_sql, decided_sql, events,
                           events_sql, forward_sql, idx_sql, indexed, manifest, manifest_sql, query, r, rs,
                           scores_table, shuffled_sql, stats_rows, table, text_ts, ts, windows, windows_sql)

OHLCV = ", ".join(FEATURE_COLS)
BAR_ROWS = f"SELECT symbol, {ts('ts')}, {OHLCV} FROM bars"


def bar_rows(df):
    return df.select("symbol", text_ts().alias("ts"), *FEATURE_COLS)


# --- sources and sinks --------------------------------------------------------

@query(f"WITH {bars_sql()} {BAR_ROWS}")
def x0_bars_from_ticks(spark, sf):
    return bar_rows(bars(spark, sf))


@query(f"WITH {bars_sql()} {BAR_ROWS}")
def s1_csv_bars(spark, sf):
    path = scratch_path(spark, "bars") + ".csv"
    bars(spark, sf).withColumn("date", text_ts()).drop("ts").write.option("header", True).csv(path)
    return bar_rows(bar_sources.read_bars_csv(spark, path, "date"))


@query(f"WITH {bars_sql()} {BAR_ROWS}")
def s2_stored_bars_with_fallback(spark, sf):
    path = scratch_path(spark, "bars")
    bars(spark, sf).write.parquet(path)
    return bar_rows(bar_sources.read_bars(spark, path + "-absent", path))


def _negatives(spark, sf):
    return corpus.mine_negatives(indexed(spark, sf), N, 10, 0.1, SEED)


def negatives_sql(rule: str = "slope_high > slope_low") -> str:
    return windows_sql(where="a.bar_idx % 10 = 0") + f""",
ols AS (SELECT symbol, start_idx, regr_slope(high, pos) AS slope_high, regr_slope(low, pos) AS slope_low,
        first(high ORDER BY pos) AS h0, first(low ORDER BY pos) AS l0 FROM wpts GROUP BY symbol, start_idx),
rel AS (SELECT symbol, start_idx, slope_high, slope_low, min(v) AS rel_min, max(v) AS rel_max FROM (
        SELECT o.*, (close - (l0 + slope_low * pos)) / (h0 + slope_high * pos - (l0 + slope_low * pos) + 1e-10) AS v
        FROM wpts w JOIN ols o USING (symbol, start_idx)) GROUP BY symbol, start_idx, slope_high, slope_low),
neg AS (SELECT *, start_idx + {N - 1} AS end_idx, NOT (slope_high > 0 AND slope_low > 0 AND {rule} AND rel_min >= -0.3 AND rel_max <= 1.3)
        AS negative FROM rel),
kept AS (SELECT symbol, start_idx, end_idx FROM neg WHERE negative),
{shuffled_sql("kept", "shuf", SEED, "symbol", "start_idx")},
mined AS (SELECT *, CASE WHEN shuffled_idx < floor((SELECT count(*) FROM shuf) * CAST(0.1 AS DOUBLE)) THEN 'validation'
        ELSE 'training' END AS split FROM shuf)"""


def normal_sql() -> str:
    return f"""
rng AS (SELECT symbol, start_idx, min(least(open, high, low, close)) AS lo,
   CASE WHEN max(greatest(open, high, low, close)) - min(least(open, high, low, close)) < 1e-10 THEN 1.0
     ELSE max(greatest(open, high, low, close)) - min(least(open, high, low, close)) END AS span,
   CASE WHEN max(volume) < 1e-10 THEN 1.0 ELSE max(volume) END AS vmax FROM wpts GROUP BY symbol, start_idx),
nrm AS (SELECT symbol, start_idx, pos, (open - lo) / span AS open, (high - lo) / span AS high, (low - lo) / span AS low,
   (close - lo) / span AS close, volume / vmax AS volume FROM wpts JOIN rng USING (symbol, start_idx))"""


CORPUS_SQL = f"""WITH {negatives_sql()}, {normal_sql()}
SELECT shuffled_idx AS window_id, CAST(pos AS INT) AS bar, {', '.join(f'round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 5) + 0.0 AS {c}' for c in FEATURE_COLS)},
0 AS label FROM nrm JOIN mined USING (symbol, start_idx) WHERE split = 'validation'"""


@query(CORPUS_SQL)
def s3_s13_corpus_table(spark, sf):
    """Corpus sink partitioned by split and type, read back with pruning."""
    path = scratch_path(spark, "corpus")
    ix = indexed(spark, sf)
    rows = corpus.corpus_rows(ix, corpus.mine_negatives(ix, N, 10, 0.1, SEED), N)
    corpus_sources.write_corpus(stored.conform(rows, CORPUS), path)
    back = corpus_sources.read_corpus(spark, path, "validation")
    return back.select("window_id", "bar", *[(F.round(F.col(c).cast("double"), 5) + 0.0).alias(c) for c in FEATURE_COLS],
                       F.col("label").cast("int").alias("label"))


@query(f"WITH {manifest_sql()}, {shuffled_sql('man', 's', SEED, 'original_idx')} SELECT * FROM s")
def s4_manifest_json(spark, sf):
    path = scratch_path(spark, "manifest")
    shuffled = corpus.shuffled(manifest(spark, sf), SEED, ["original_idx"])
    corpus_sources.write_manifest(shuffled, path)
    return corpus_sources.read_manifest(spark, path).select("label", "type", "original_idx", "shuffled_idx")


EVENT_COLS = ["score", "vol_trend", "convergence", "travel_upper", "travel_lower", "width_start", "width_end"]


@query(f"""WITH {events_sql()} SELECT symbol, {ts('date_start')}, {ts('date_end')}, CAST(session_minute AS INT) AS session_minute,
CAST(n_gaps AS INT) AS n_gaps, CAST(gap_pos AS INT) AS gap_pos, {rs(*EVENT_COLS)} FROM ev""")
def s5_event_table(spark, sf):
    path = scratch_path(spark, "events")
    stored.write_table(events(spark, sf).select("symbol", "date_start", "date_end", "session_minute", "n_gaps", "gap_pos",
                                                *EVENT_COLS), path)
    return spark.read.parquet(path).select("symbol", text_ts("date_start").alias("date_start"),
                                           text_ts("date_end").alias("date_end"), "session_minute", "n_gaps", "gap_pos",
                                           *r(*EVENT_COLS))


@query(f"""WITH {windows_sql()} SELECT count(*) AS n_windows, count(*) FILTER (WHERE score >= {THRESHOLD}) AS n_positives,
round(avg(score) + 3e-8, 6) + 0.0 AS mean_score FROM win""")
def s6_summary_json(spark, sf):
    path = scratch_path(spark, "summary")
    stored.write_summary(windows(spark, sf).agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("score") >= THRESHOLD).alias("n_positives"),
        F.avg("score").alias("mean_score")), path)
    return spark.read.schema("n_windows long, n_positives long, mean_score double").json(path).select(
        "n_windows", "n_positives", *r("mean_score"))


# Updates: the same bars a minute granularity sees last, i.e. prices of the hour's
# last minute, delivered twice with a sequence number; the second copy wins.
@query(f"""WITH {bars_sql()}, upd AS (SELECT symbol, ts, open, high, low, close, volume * 2 AS volume FROM bars WHERE hour(ts) >= 12),
up2 AS (SELECT symbol, ts, open, high, low, close, volume + 1 AS volume FROM bars WHERE hour(ts) >= 18)
SELECT symbol, {ts('ts')}, open, high, low, close, coalesce(u2.volume, u1.volume, b.volume) AS volume
FROM bars b LEFT JOIN (SELECT symbol, ts, volume FROM upd) u1 USING (symbol, ts) LEFT JOIN (SELECT symbol, ts, volume FROM up2) u2 USING (symbol, ts)""")
def s7_upsert_last_wins(spark, sf):
    base = bars(spark, sf)
    late = base.where(F.hour("ts") >= 12).withColumn("volume", F.col("volume") * 2).withColumn("seq", F.lit(1))
    later = base.where(F.hour("ts") >= 18).withColumn("volume", F.col("volume") + 1).withColumn("seq", F.lit(2))
    return bar_rows(stored.upsert(base.withColumn("seq", F.lit(0)), later.unionByName(late), KEY_BARS, ["seq"]))


@query(f"""WITH {bars_sql()} SELECT symbol, {ts('ts')}, open, high, low, close, CASE WHEN hour(ts) >= 18 AND day(ts) = 9 THEN volume + 1 ELSE volume END AS volume FROM bars""")
def s7_upsert_stored_partitions(spark, sf):
    """Re-served bars of one day replace their rows in a table partitioned by day."""
    path = scratch_path(spark, "daily")
    base = bars(spark, sf).withColumn("day", F.to_date("ts"))
    stored.write_table(base, path, partition_by=["day"])
    again = base.where((F.dayofmonth("ts") == 9) & (F.hour("ts") >= 18)).withColumn("volume", F.col("volume") + 1)
    stored.upsert_partitions(again, path, KEY_BARS, [], "day")
    return bar_rows(spark.read.parquet(path))


@query(f"""WITH {decided_sql()} SELECT 'bars' AS table_name, CAST(count(DISTINCT (symbol, date_end)) AS BIGINT) AS n, CAST(0 AS BIGINT) AS signals FROM dec
UNION ALL SELECT 'scores', count(*), CAST(sum(signal) AS BIGINT) FROM dec
UNION ALL SELECT 'signals', count(*) FILTER (WHERE signal = 1), count(*) FILTER (WHERE signal = 1) FROM dec""")
def s8_split_outputs(spark, sf):
    w = stats_rows(spark, sf).drop("close").join(bars(spark, sf), ["symbol", "ts"])
    b, s, g = stored.split_outputs(w)
    count = F.count(F.lit(1)).alias("n")
    return (b.agg(count, F.lit(0).cast("long").alias("signals")).select(F.lit("bars").alias("table_name"), "*")
            .unionByName(s.agg(count, F.sum("signal").alias("signals")).select(F.lit("scores").alias("table_name"), "*"))
            .unionByName(g.agg(count, F.count(F.lit(1)).alias("signals")).select(F.lit("signals").alias("table_name"), "*")))


def _legacy(spark, sf):
    """A wide legacy table: blank scores while the hour has few ticks, and every row delivered twice."""
    b = bars(spark, sf)
    score = F.when(F.col("volume") >= 2, F.round(F.col("close") / (F.col("close") + 50), 4).cast("string")).otherwise(F.lit(""))
    wide = b.select("symbol", "ts", score.alias("score_50bar"),
                    F.when(F.col("volume") >= 2, (F.col("close") > 100).cast("int").cast("string")).alias("signal_50bar"),
                    F.col("volume").cast("int").alias("bars_50"), F.col("open").alias("mid_travel_50bar"))
    first = wide.withColumn("score_50bar", F.lit("0.5")).withColumn("seq", F.lit(1))
    return first.unionByName(wide.withColumn("seq", F.lit(2)))


LEGACY_SQL = f"""{bars_sql()}, wide AS (SELECT symbol, ts, CASE WHEN volume >= 2 THEN round(close / (close + 50), 4) END AS score,
CASE WHEN volume >= 2 THEN CAST(close > 100 AS INT) ELSE 0 END AS signal, CAST(volume AS INT) AS bars, open AS mid_travel FROM bars)"""


@query(f"WITH {LEGACY_SQL} SELECT symbol, {ts('ts')}, 'wedge' AS pattern, 50 AS window, score, signal, bars FROM wide")
def s9_r2_unpivot_scores(spark, sf):
    s, _ = stored.unpivot_scores(_legacy(spark, sf), [50, 250], ["seq"])
    return s.select("symbol", text_ts().alias("ts"), "pattern", "window", "score", "signal", "bars")


@query(f"""WITH {LEGACY_SQL} SELECT symbol, {ts('ts')}, 'wedge' AS pattern, 50 AS window, round(mid_travel + 3e-8, 6) + 0.0 AS mid_travel,
CAST(NULL AS DOUBLE) AS convergence FROM wide WHERE signal = 1""")
def s9_unpivot_signals(spark, sf):
    _, g = stored.unpivot_scores(_legacy(spark, sf), [50, 250], ["seq"])
    return g.select("symbol", text_ts().alias("ts"), "pattern", "window", *r("mid_travel"), "convergence")


@query(f"""WITH {bars_sql()} SELECT symbol, {ts('ts')}, 'wedge' AS pattern, CAST({N} AS INT) AS window, close AS score,
CAST(NULL AS DOUBLE) AS signal, CAST(volume AS INT) AS bars FROM bars""")
def s10_conform_schema(spark, sf):
    old = bars(spark, sf).select("symbol", "ts", F.lit(N).alias("window"), F.col("close").alias("score"),
                                 F.col("volume").alias("bars"))
    out = stored.conform(old, SCORES, {"pattern": "wedge"})
    return out.select("symbol", text_ts().alias("ts"), "pattern", "window", "score",
                      F.col("signal").cast("double").alias("signal"), "bars")


@query(f"""WITH {bars_sql()} SELECT 'bars' AS table_name, count(*) AS n FROM bars UNION ALL SELECT 'scores', 0 UNION ALL SELECT 'signals', 0""")
def s11_clear_outputs(spark, sf):
    root = scratch_path(spark, "store")
    b = bars(spark, sf)
    b.write.parquet(f"{root}/bars")
    for name in ("scores", "signals"):
        b.select("symbol", "ts", "close").write.parquet(f"{root}/{name}")
    stored.clear_outputs(spark, f"{root}/scores", f"{root}/signals")
    parts = [spark.read.parquet(f"{root}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
             for n in ("bars", "scores", "signals")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {bars_sql()}, done AS (SELECT * FROM bars WHERE ts <= TIMESTAMP '2024-01-20 12:30:00' - INTERVAL 3600 SECOND)
SELECT symbol, {ts("ts - INTERVAL 5 HOUR", "ts")}, {OHLCV} FROM done
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""")
def s12_newest_completed(spark, sf):
    return bar_rows(bar_sources.newest_completed(bars(spark, sf), "2024-01-20 12:30:00", 3600))


# --- projections and predicates ----------------------------------------------

@query("SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY event_type")
def p1_column_pruning(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@query(f"WITH {idx_sql()} SELECT symbol, {ts('ts')}, bar_idx, n_bars, day_no, next_day_idx FROM idx")
def p2_bar_index(spark, sf):
    return indexed(spark, sf).select("symbol", text_ts().alias("ts"), "bar_idx", "n_bars", "day_no", "next_day_idx")


GATE = "dayofweek(ts) BETWEEN 1 AND 5 AND strftime(ts, '%H:%M:%S') >= '09:30:00' AND strftime(ts, '%H:%M:%S') < '16:00:00'"


@query(f"WITH {bars_sql()} SELECT symbol, {ts('ts')}, close FROM bars WHERE {GATE}")
def p3_session_gate_fallback(spark, sf):
    return indexing.session_gate(bars(spark, sf)).select("symbol", text_ts().alias("ts"), "close")


@query(f"WITH {bars_sql('minute')} SELECT symbol, {ts('ts')}, close FROM bars WHERE {GATE}")
def p3_session_gate_minutes(spark, sf):
    return indexing.session_gate(bars(spark, sf, "minute")).select("symbol", text_ts().alias("ts"), "close")


def _calendar(spark, sf):
    """Trading days from the data's own dates: weekdays, closed on every 15th, Fridays close at 13:00."""
    d = table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct()
    early = F.when(F.dayofweek("date") == 6, "13:00:00").otherwise("16:00:00")
    return d.where((F.weekday("date") < 5) & (F.dayofmonth("date") != 15)).select(
        "date", F.lit("09:30:00").alias("open_time"), early.alias("close_time"))


@query(f"""WITH {bars_sql()} SELECT symbol, {ts('ts')}, close FROM bars WHERE dayofweek(ts) BETWEEN 1 AND 5 AND day(ts) <> 15
AND strftime(ts, '%H:%M:%S') >= '09:30:00' AND strftime(ts, '%H:%M:%S') < CASE WHEN dayofweek(ts) = 5 THEN '13:00:00' ELSE '16:00:00' END""")
def p3_j6_session_calendar(spark, sf):
    return indexing.session_gate(bars(spark, sf), _calendar(spark, sf)).select("symbol", text_ts().alias("ts"), "close")


@query(f"WITH {idx_sql('minute')} SELECT symbol, {ts('ts')}, CAST(session_minute AS INT) AS session_minute FROM idx")
def p4_session_minute(spark, sf):
    return indexed(spark, sf, "minute").select("symbol", text_ts().alias("ts"), "session_minute")


@query(f"WITH {idx_sql()} SELECT symbol, bar_idx AS start_idx, bar_idx + {N - 1} AS end_idx FROM idx WHERE bar_idx <= n_bars - {N} AND bar_idx % 7 = 0")
def p5_window_starts(spark, sf):
    return indexing.window_starts(indexed(spark, sf), N, 7)


@query(f"""WITH {idx_sql()} SELECT symbol, count(DISTINCT session_minute) AS minutes_all,
count(DISTINCT CASE WHEN bar_idx >= {N - 1} AND (bar_idx - {N - 1}) % 4 = 0 THEN session_minute END) AS minutes_reached,
195 AS reachable_of_session, TRUE AS warn FROM idx GROUP BY symbol""")
def p6_stride_coverage(spark, sf):
    return indexing.stride_coverage(indexed(spark, sf), N, 4)


@query(f"WITH {windows_sql()} SELECT symbol, start_idx, {rs('score')} FROM win WHERE score >= {THRESHOLD}")
def p7_score_threshold(spark, sf):
    return jobs.detect.detections(windows(spark, sf), THRESHOLD).select("symbol", "start_idx", *r("score"))


@query(f"""WITH {windows_sql()}, t AS (SELECT * FROM (VALUES ('wedge', 0.7), ('channel', 0.55), ('hs', 0.7), ('inverse_hs', 0.7)) t(pattern, threshold))
SELECT pattern, CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE score >= threshold) AS over FROM win CROSS JOIN t GROUP BY ALL""")
def p8_threshold_resolution(spark, sf):
    forms = resolve_thresholds(FORMS, 0.7, parse_assignments(["channel=0.55"]))
    d = per_formation(windows(spark, sf), forms)
    return d.groupBy("pattern", "threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("over"))


SCORED = f'{decided_sql()}, sc AS (SELECT symbol, date_end AS ts, pattern, {N} AS "window", score, signal, {N} AS bars FROM dec)'


@query(f"""WITH {SCORED} SELECT symbol, {ts('ts')}, pattern, {rs('score')}, signal FROM sc
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND "window" = {N} AND pattern = 'channel'""")
def p9_range_filter(spark, sf):
    d = serving.range_filter(scores_table(spark, sf), "2024-01-05", "2024-01-20", N, "channel")
    return d.select("symbol", text_ts().alias("ts"), "pattern", *r("score"), "signal")


@query(f"WITH {bars_sql()} {BAR_ROWS} WHERE CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM bars)")
def p10_select_day(spark, sf):
    return bar_rows(serving.select_day(bars(spark, sf)))


# --- joins --------------------------------------------------------------------

@query(f"WITH {events_sql()} SELECT symbol, start_idx, end_idx, {rs('score')} FROM ev")
def j1_locate_events(spark, sf):
    ev = events(spark, sf).select("symbol", "date_start", "date_end", "score")
    return jobs.locate_events(ev, indexed(spark, sf), N).select("symbol", "start_idx", "end_idx", *r("score"))


@query(f"""WITH {events_sql()}, {forward_sql()} SELECT symbol, end_idx, h AS horizon,
round(CASE h {' '.join(f'WHEN {h} THEN ret_{h}' for h in HORIZONS)} END + 3e-8, 6) + 0.0 AS ret
FROM ev JOIN fwd ON fwd.symbol = ev.symbol AND bar_idx = end_idx CROSS JOIN (SELECT unnest({HORIZONS}) AS h)""".replace(
    "SELECT symbol, end_idx, h", "SELECT ev.symbol, end_idx, h"))
def j2_forward_lookup(spark, sf):
    return forward_lookup(events(spark, sf).select("symbol", "end_idx"), indexed(spark, sf), HORIZONS).select(
        "symbol", "end_idx", "horizon", *r("ret"))


@query(f"WITH {windows_sql()} SELECT symbol, start_idx, CAST(pos AS INT) AS pos, high, low, close FROM wpts")
def j3_window_gather(spark, sf):
    ix = indexed(spark, sf)
    return gather(indexing.window_starts(ix, N), ix, ["high", "low", "close"]).select(
        "symbol", "start_idx", "pos", "high", "low", "close")


WIDE = f"(SELECT symbol, ts, max(score) AS score_{N}bar, CAST(max(signal) AS DOUBLE) AS signal_{N}bar FROM sc WHERE pattern = 'wedge' GROUP BY symbol, ts)"


@query(f"WITH {SCORED} SELECT symbol, {ts('ts')}, close, {rs(f'score_{N}bar')}, signal_{N}bar FROM bars LEFT JOIN {WIDE} w USING (symbol, ts)")
def j4_bars_with_scores(spark, sf):
    wide = stored.pivot_scores(scores_table(spark, sf), [N])
    return serving.bars_with_scores(bars(spark, sf), wide).select(
        "symbol", text_ts().alias("ts"), "close", *r(f"score_{N}bar"), F.col(f"signal_{N}bar").cast("double").alias(f"signal_{N}bar"))


@query(f"""WITH {SCORED} SELECT symbol, pattern, CAST("window" AS INT) AS "window", {ts('ts')}, {rs('score')}, signal FROM sc
QUALIFY row_number() OVER (PARTITION BY symbol, pattern, "window" ORDER BY ts DESC) = 1""")
def j5_latest_scores(spark, sf):
    return serving.latest_scores(scores_table(spark, sf)).select(
        "symbol", "pattern", "window", text_ts().alias("ts"), *r("score"), "signal")


@query(f"WITH {bars_sql()}, f AS (SELECT * FROM (VALUES {', '.join('(' + _lit(f['pattern']) + ', ' + _lit(f['threshold']) + ')' for f in FORMS)}) f(pattern, threshold)) "
       f"SELECT symbol, {ts('ts')}, pattern, CAST(threshold AS DOUBLE) AS threshold FROM bars CROSS JOIN f")
def j7_bars_per_formation(spark, sf):
    return per_formation(bars(spark, sf), FORMS).select("symbol", text_ts().alias("ts"), "pattern", "threshold")


# --- serving ------------------------------------------------------------------

@query(f"""WITH {SCORED} SELECT symbol, {ts('ts')}, pattern, {rs('score')} FROM (
SELECT * FROM sc WHERE ts >= TIMESTAMP '2024-01-03' AND pattern = 'wedge' ORDER BY ts DESC, symbol, pattern, "window" LIMIT 500)""")
def o1_newest_rows(spark, sf):
    return serving.range_query(scores_table(spark, sf), since="2024-01-03", pattern="wedge", limit=500).select(
        "symbol", text_ts().alias("ts"), "pattern", *r("score"))


def _by_day(spark, df, keys, name):
    """A table kept by day, as a stream leaves it."""
    path = scratch_path(spark, name)
    days.merge_days(df, path, keys, 0)
    return path


@query(f"""WITH {SCORED} SELECT symbol, {ts('ts')}, pattern, {rs('score')} FROM (
SELECT * FROM sc WHERE pattern = 'wedge' ORDER BY ts DESC, symbol LIMIT 200)""")
def o1_newest_rows_by_day(spark, sf):
    """The newest rows of one pattern from as few days as hold them."""
    s = scores_table(spark, sf)
    path = _by_day(spark, s, KEY_SCORES, "scores-by-day")
    return days.newest_rows(spark, path, s.schema, 200, F.col("pattern") == "wedge").select(
        "symbol", text_ts().alias("ts"), "pattern", *r("score"))


@query(f"""WITH {SCORED} SELECT symbol, pattern, CAST("window" AS INT) AS "window", {ts('ts')}, {rs('score')}, signal FROM sc
QUALIFY row_number() OVER (PARTITION BY symbol, pattern, "window" ORDER BY ts DESC) = 1""")
def j5_latest_scores_by_day(spark, sf):
    """The newest score of every known (symbol, pattern, window), days walked back only as far as one is missing."""
    s = scores_table(spark, sf)
    path = _by_day(spark, s, KEY_SCORES, "latest-by-day")
    last = days.latest_by(spark, path, s.schema, s.select("symbol", "pattern", "window"))
    return last.select("symbol", "pattern", "window", text_ts().alias("ts"), *r("score"), "signal")


@query(f"WITH {bars_sql()} {BAR_ROWS} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
def o2_latest_bar(spark, sf):
    return bar_rows(serving.latest_bar(bars(spark, sf)))


@query(f"""WITH {SCORED} SELECT 'bars' AS table_name, count(*) AS n, {ts('min(ts)', 'first_ts')}, {ts('max(ts)', 'last_ts')} FROM bars
UNION ALL SELECT 'scores', count(*), {ts('min(ts)', 'a')}, {ts('max(ts)', 'b')} FROM sc
UNION ALL SELECT 'signals', count(*), {ts('min(ts)', 'a')}, {ts('max(ts)', 'b')} FROM sc WHERE signal = 1""")
def a1_table_stats(spark, sf):
    s = scores_table(spark, sf)
    return serving.table_stats({"bars": bars(spark, sf), "scores": s, "signals": s.where("signal = 1")}).select(
        "table_name", "n", text_ts("first_ts").alias("first_ts"), text_ts("last_ts").alias("last_ts"))


@query(f"""WITH {SCORED} SELECT pattern, CAST("window" AS INT) AS "window", count(*) AS n, CAST(sum(signal) AS BIGINT) AS signals FROM sc GROUP BY ALL""")
def a2_signal_counts(spark, sf):
    return serving.signal_counts(scores_table(spark, sf))


@query(f"""WITH {SCORED} SELECT strftime(ts, '%Y-%m-%d') AS day, CAST("window" AS INT) AS "window", CAST(sum(signal) AS BIGINT) AS signals FROM sc GROUP BY ALL""")
def a35_daily_signals(spark, sf):
    return serving.daily_signals(scores_table(spark, sf)).select(F.col("day").cast("string").alias("day"), "window", "signals")


@query(f"WITH {SCORED} SELECT symbol, {ts('ts')}, {rs(f'score_{N}bar')}, signal_{N}bar FROM {WIDE}")
def r1_pivot_scores(spark, sf):
    return stored.pivot_scores(scores_table(spark, sf), [N]).select(
        "symbol", text_ts().alias("ts"), *r(f"score_{N}bar"), F.col(f"signal_{N}bar").cast("double").alias(f"signal_{N}bar"))


@query("""SELECT event_type AS symbol, count(TRY_CAST(trim(split_part(props, ':', 2)) AS DOUBLE)) AS numeric_props,
count(*) AS n FROM events GROUP BY event_type""")
def f1_lenient_number(spark, sf):
    c = lenient_number(F.split_part("props", F.lit(":"), F.lit(2)))
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("symbol")).agg(
        F.count(c).alias("numeric_props"), F.count(F.lit(1)).alias("n"))
