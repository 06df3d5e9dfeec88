"""The same logic on Structured Streaming, and replay as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeforge.operators import indexing, spikes
from tapeforge.plans import detect, jobs
from tapeforge.schemas import FEATURE_COLS, KEY_BARS, KEY_SCORES, SCORES, SIGNALS, STAT_COLS
from tapeforge.session import scratch_path
from tapeforge.sources import days
from tapeforge.streaming import live, monitor
from workload.base import (CHUNK, FIT, FORMS, N, bars, bars_sql, decided_sql, formations_sql, query, r, rs, text_ts, ts,
                           windows_sql)
from workload.shapes import SPIKE_LIMIT, spike_sql
from workload.tables import GATE

HALF = "2024-01-16"


def _flagged(spark, sf):
    return indexing.session_gate(bars(spark, sf), keep_flag=True)


def _source(spark, path, df):
    """A file stream over ``path`` with the schema of ``df``."""
    return monitor.bar_stream(spark, path, df.schema, files_per_batch=1000)


def _rows_of(spark, sf, order="live", history=None, parts=None, limit=SPIKE_LIMIT):
    """Run the stateful stream over the given parts, one catch-up run each, and read back its rows."""
    b = _flagged(spark, sf)
    src, out, mark = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-mark"))
    for cond in parts or [F.lit(True)]:
        b.where(cond).write.mode("append").parquet(src)
        rows = monitor.window_rows(_source(spark, src, b), N, limit, order, history)
        q = (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(monitor.WINDOW_ROWS).parquet(out)


def _described(rows):
    return rows.select("symbol", text_ts().alias("ts"), "in_session", "late", F.col("depth").cast("double").alias("depth"),
                       F.array_max("high_window").alias("top"), F.array_min("low_window").alias("bottom"))


# bars in order, each symbol 0.., and after the filter only the session bars again 0..
RAW = f"{bars_sql()}, raw AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx, ({GATE}) AS in_session FROM bars)"
SEEN = f"""{RAW},{spike_sql('raw')},
seen AS (SELECT raw.*, CASE WHEN in_session THEN row_number() OVER (PARTITION BY symbol, in_session ORDER BY bar_idx) - 1 END AS k
  FROM raw JOIN spk USING (symbol, bar_idx) WHERE accepted)"""
FRAME = f"OVER (PARTITION BY symbol, in_session ORDER BY k ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW)"
ROWS = f"""SELECT symbol, {ts('ts')}, in_session, FALSE AS late, CASE WHEN in_session THEN CAST(least(k + 1, {N}) AS DOUBLE) END AS depth,
CASE WHEN k >= {N - 1} THEN max(high) {FRAME} END AS top, CASE WHEN k >= {N - 1} THEN min(low) {FRAME} END AS bottom FROM seen"""


@query(f"WITH {bars_sql()} SELECT symbol, {ts('ts')}, {', '.join(FEATURE_COLS)} FROM bars")
def t1_duplicate_suppression(spark, sf):
    """Every bar delivered twice; the watermark operator keeps one."""
    b = bars(spark, sf)
    src, out, mark = (scratch_path(spark, n) for n in ("dup-in", "dup-out", "dup-mark"))
    b.unionByName(b).write.parquet(src)
    stream = monitor.deduplicated(_source(spark, src, b), "40 days")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(b.schema).parquet(out).select("symbol", text_ts().alias("ts"), *FEATURE_COLS)


@query(f"WITH RECURSIVE {SEEN} {ROWS}")
def t2_t3_t4_stream_windows(spark, sf):
    """Spike filter, extended-hours routing and rolling windows, in two catch-up runs from one checkpoint."""
    parts = [F.col("ts") < HALF, F.col("ts") >= HALF]
    return _described(_rows_of(spark, sf, parts=parts))


WARM = f"""{RAW}, old AS (SELECT * FROM raw WHERE ts < TIMESTAMP '{HALF}'),
new AS (SELECT * REPLACE (row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar_idx) FROM raw WHERE ts >= TIMESTAMP '{HALF}'),
seeds AS (SELECT symbol, list(close ORDER BY ts) AS closes FROM (SELECT * FROM old WHERE in_session QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 10) GROUP BY symbol),
spk(symbol, bar_idx, accepted, closes, rejects) AS (
  SELECT symbol, CAST(0 AS BIGINT), FALSE, closes, 0 FROM seeds
  UNION ALL
  SELECT symbol, bar_idx, NOT out OR rejects >= 3,
    CASE WHEN NOT out THEN list_append(closes, close)[-10:] WHEN rejects >= 3 THEN [close] ELSE closes END,
    CASE WHEN out AND rejects < 3 THEN rejects + 1 ELSE 0 END
  FROM (SELECT n.symbol, n.bar_idx, n.close, closes, rejects,
          greatest(abs(n.open / m - 1), abs(n.high / m - 1), abs(n.low / m - 1), abs(n.close / m - 1)) > {SPIKE_LIMIT} AS out
        FROM (SELECT *, list_median(closes) AS m FROM spk) p JOIN new n ON n.symbol = p.symbol AND n.bar_idx = p.bar_idx + 1)),
ring AS (SELECT symbol, ts, high, low, in_session FROM old WHERE in_session QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= {N}),
acc AS (SELECT new.symbol, new.ts, high, low, in_session FROM new JOIN spk USING (symbol, bar_idx) WHERE accepted),
al AS (SELECT *, FALSE AS fresh FROM ring UNION ALL SELECT *, TRUE FROM acc),
seen AS (SELECT *, CASE WHEN in_session THEN row_number() OVER (PARTITION BY symbol, in_session ORDER BY ts) - 1 END AS k FROM al)"""


@query(f"WITH RECURSIVE {WARM} SELECT * EXCLUDE (fresh) FROM ({ROWS.replace('FROM seen', ', fresh FROM seen')}) WHERE fresh")
def t5_warm_start(spark, sf):
    """State seeded from stored bars of the first half, stream over the second half."""
    history = _flagged(spark, sf).where(F.col("ts") < HALF)
    return _described(_rows_of(spark, sf, history=history, parts=[F.col("ts") >= HALF]))


LIVE_IDX = f"""{SEEN}, idx AS (SELECT symbol, ts, open, high, low, close, volume, k AS bar_idx, count(*) OVER (PARTITION BY symbol) AS n_bars,
  0 AS day_no, 0 AS next_day_idx, 0 AS session_minute FROM seen WHERE in_session)"""


@query(f"""WITH RECURSIVE {decided_sql(base=LIVE_IDX)}, cells AS (SELECT i.symbol, i.ts, i.bar_idx, f.pattern FROM idx i CROSS JOIN forms f)
SELECT c.symbol, {ts('c.ts', 'ts')}, c.pattern, {N} AS window, CAST(least(c.bar_idx + 1, {N}) AS INT) AS bars, round(d.score + 3e-8, 6) + 0.0 AS score, coalesce(d.signal, 0) AS signal
FROM cells c LEFT JOIN dec d ON d.symbol = c.symbol AND d.end_idx = c.bar_idx AND d.pattern = c.pattern""")
def t6_k10_monitor_scores(spark, sf):
    """Live monitor end to end: filter, gate, window, score, decide, and store in foreachBatch."""
    b = _flagged(spark, sf)
    src, out, mark = (scratch_path(spark, n) for n in ("mon-in", "mon-out", "mon-mark"))
    b.write.parquet(src)
    write = monitor.store_batch(f"{out}/bars", f"{out}/scores", f"{out}/signals", FORMS)
    monitor.run_available(monitor.window_rows(_source(spark, src, b), N, SPIKE_LIMIT), write, mark)
    return monitor.read_current(spark, f"{out}/scores", KEY_SCORES).select(
        "symbol", text_ts().alias("ts"), "pattern", "window", "bars", *r("score"), "signal")


REPLAY_IDX = f"""{bars_sql()}, raw AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM bars WHERE {GATE}),{spike_sql('raw')},
idx AS (SELECT symbol, ts, open, high, low, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx,
  count(*) OVER (PARTITION BY symbol) AS n_bars, 0 AS day_no, 0 AS next_day_idx, 0 AS session_minute FROM raw JOIN spk USING (symbol, bar_idx) WHERE accepted)"""


@query(f"""WITH RECURSIVE {windows_sql(base=REPLAY_IDX)} SELECT symbol, {ts('date_end')}, {rs('score', 'convergence')} FROM win""")
def t7_replay_batch(spark, sf):
    """Replay order: session gate first, then the spike filter, then the ordinary scan."""
    gated = indexing.with_bar_index(indexing.session_gate(bars(spark, sf)))
    kept = spikes.spike_filter(gated, SPIKE_LIMIT, chunk=64, warmup=16).where("accepted")
    ix = indexing.with_bar_index(kept.select("symbol", "ts", *FEATURE_COLS))
    return detect.scan(ix, N, FIT, chunk=CHUNK).select("symbol", text_ts("date_end").alias("date_end"), *r("score", "convergence"))


REPLAYED = f"""WITH RECURSIVE {decided_sql(base=REPLAY_IDX)}, cells AS (SELECT i.symbol, i.ts, i.bar_idx, f.pattern FROM idx i CROSS JOIN forms f),
rep AS (SELECT c.symbol, c.ts, c.pattern, {N} AS window, CAST(least(c.bar_idx + 1, {N}) AS INT) AS bars, d.score, coalesce(d.signal, 0) AS signal, d.convergence, d.b_upper
FROM cells c LEFT JOIN dec d ON d.symbol = c.symbol AND d.end_idx = c.bar_idx AND d.pattern = c.pattern)"""


def _replay(spark, sf):
    """Replayed tables, written over older ones and read back."""
    scores, signals = jobs.replay(bars(spark, sf), FORMS, SPIKE_LIMIT, chunk=CHUNK)
    paths = scratch_path(spark, "replay-scores"), scratch_path(spark, "replay-signals")
    jobs.store_replay(scores, signals, *paths)
    return spark.read.schema(scores.schema).parquet(paths[0]), spark.read.schema(signals.schema).parquet(paths[1])


@query(f"""{REPLAYED} SELECT symbol, {ts('ts')}, pattern, {N} AS window, bars, round(score + 3e-8, 6) + 0.0 AS score, signal FROM rep""")
def t7_replay_scores(spark, sf):
    return _replay(spark, sf)[0].select("symbol", text_ts().alias("ts"), "pattern", "window", "bars", *r("score"), "signal")


@query(f"""{REPLAYED} SELECT symbol, {ts('ts')}, pattern, {N} AS window, round(b_upper, 6) + 0.0 AS slope_upper, round(convergence, 4) + 0.0 AS convergence FROM rep WHERE signal = 1""")
def t7_replay_signals(spark, sf):
    return _replay(spark, sf)[1].select("symbol", text_ts().alias("ts"), "pattern", "window", "slope_upper", "convergence")


@query(f"WITH {bars_sql()} SELECT symbol, {ts('ts')}, ts < TIMESTAMP '{HALF}' AS late, close FROM bars")
def t8_late_bars(spark, sf):
    """The second half arrives first; the older half is stored as late and never scored."""
    parts = [F.col("ts") >= HALF, F.col("ts") < HALF]
    rows = _rows_of(spark, sf, parts=parts, limit=1e9)
    late = monitor.last_wins(rows.select("symbol", "ts", "late", "close"), KEY_BARS, ["late"])
    return late.select("symbol", text_ts().alias("ts"), "late", "close")


# --- several sizes in one stream -----------------------------------------------------------

SIZES = [N, 20]


def _stream_to_table(rows, mark, out):
    q = (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def _live_rows(spark, sf, sizes, parts, **options):
    """Rows of the ring state over the given parts of the bars, one catch-up run each."""
    b = _flagged(spark, sf)
    src, out, mark = (scratch_path(spark, n) for n in ("ring-in", "ring-out", "ring-mark"))
    for cond in parts:
        b.where(cond).write.mode("append").parquet(src)
        _stream_to_table(live.live_rows(_source(spark, src, b), sizes, SPIKE_LIMIT, **options), mark, out)
    return spark.read.schema(live.ROWS).parquet(out)


def _sized_sql(sizes, seen=SEEN):
    """Depth, highest high and lowest low of the windows of each size that end at each accepted session bar."""
    one = """SELECT symbol, {ts}, {n} AS size, CAST(least(k + 1, {n}) AS INT) AS depth,
CASE WHEN k >= {n} - 1 THEN max(high) OVER w END AS top, CASE WHEN k >= {n} - 1 THEN min(low) OVER w END AS bottom
FROM seen WHERE in_session WINDOW w AS (PARTITION BY symbol ORDER BY k ROWS BETWEEN {n} - 1 PRECEDING AND CURRENT ROW)"""
    return f"WITH RECURSIVE {seen} " + " UNION ALL ".join(f"({one.format(ts=ts('ts'), n=n)})" for n in sizes)


def _sized(rows, sizes):
    d = live.block_windows(rows, [(n, n) for n in sizes])
    return d.select("symbol", text_ts().alias("ts"), "size", "depth", "top", "bottom")


@query(_sized_sql(SIZES))
def t4_two_sizes(spark, sf):
    """Windows of two sizes from one ring a symbol, in two catch-up runs from one checkpoint."""
    return _sized(_live_rows(spark, sf, SIZES, [F.col("ts") < HALF, F.col("ts") >= HALF]), SIZES)


@query(_sized_sql([20, 12]))
def t5_restart_with_other_sizes(spark, sf):
    """A query with one size is stopped; another with a smaller one as well goes on from its checkpoint's rings."""
    b = _flagged(spark, sf)
    src, marks, outs = scratch_path(spark, "again-in"), [], []
    for sizes, cond in (([20], F.col("ts") < HALF), ([20, 12], F.col("ts") >= HALF)):
        b.where(cond).write.mode("append").parquet(src)
        start = live.checkpoint_start(spark, marks[-1]) if marks else None
        marks.append(scratch_path(spark, "again-mark"))
        outs.append(scratch_path(spark, "again-out"))
        _stream_to_table(live.live_rows(_source(spark, src, b), sizes, SPIKE_LIMIT, start), marks[-1], outs[-1])
    first, second = (spark.read.schema(live.ROWS).parquet(o) for o in outs)
    # The new size has no rows of the time before it was added; what it would have had is asked of the first run's blocks.
    return _sized(first, [20, 12]).unionByName(_sized(second, [20, 12]))


def _close_in_window():
    """A loader, as a model file would have one: where the last close stands in its window, squared."""
    return lambda batch: batch[:, -1, 3] ** 2


PRICES = "least(open, high, low, close)", "greatest(open, high, low, close)"


@query(f"""WITH RECURSIVE {SEEN}, m AS (SELECT symbol, ts, k, close, min({PRICES[0]}) OVER w AS lo, max({PRICES[1]}) OVER w AS hi
FROM seen WHERE in_session WINDOW w AS (PARTITION BY symbol ORDER BY k ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW))
SELECT symbol, {ts('ts')}, CAST(least(k + 1, {N}) AS INT) AS bars,
CASE WHEN k >= {N - 1} THEN round(power((close - lo) / CASE WHEN hi - lo < 1e-10 THEN 1.0 ELSE hi - lo END, 2) + 3e-8, 6) + 0.0 END AS score FROM m""")
def x1_stream_batch_model(spark, sf):
    """A batch model on windows of five columns, in the stream's foreachBatch path."""
    form = [{**FORMS[2], "pattern": "own"}]
    rows = _live_rows(spark, sf, [N], [F.col("ts") < HALF, F.col("ts") >= HALF])
    scored = live.score_live(rows, form, {("own", N): _close_in_window})
    return scored.select("symbol", text_ts().alias("ts"), F.col("depth").alias("bars"), *r("score"))


LOW = [{**f, "threshold": 0.5, "max_exc": None if f["max_exc"] is None else 4.0, "min_touches": None if f["min_touches"] is None else 3}
       for f in FORMS if not f["log_only"]]


def _low_sql():
    rows = ", ".join("(" + ", ".join("NULL" if f[c] is None else str(f[c]).upper() if isinstance(f[c], bool) else
                                     f"'{f[c]}'" if isinstance(f[c], str) else str(f[c]) for c in
                                     ("pattern", "threshold", "apex_gate", "quality_gate", "geometry", "log_only", "min_conv",
                                      "max_conv", "min_touches", "max_exc")) + ")" for f in LOW)
    names = "pattern, threshold, apex_gate, quality_gate, geometry, log_only, min_conv, max_conv, min_touches, max_exc"
    return decided_sql(base=LIVE_IDX).replace(formations_sql(), f"forms AS (SELECT * FROM (VALUES {rows}) f({names}))")


def _stored(spark, sf, forms):
    """The three live tables after two catch-up runs, the last batch of which is written once more as a retry would."""
    b = _flagged(spark, sf)
    src, out, mark = (scratch_path(spark, n) for n in ("days-in", "days-out", "days-mark"))
    write = live.store_live(f"{out}/bars", f"{out}/scores", f"{out}/signals", forms)
    last = {}

    def remembered(batch, batch_id):
        last.update(rows=scratch_path(spark, "retry"), id=batch_id)
        batch.write.parquet(last["rows"])
        write(batch, batch_id)

    for cond in (F.col("ts") < HALF, F.col("ts") >= HALF):
        b.where(cond).write.mode("append").parquet(src)
        monitor.run_available(live.live_rows(_source(spark, src, b), [N], SPIKE_LIMIT), remembered, mark)
    write(spark.read.schema(live.ROWS).parquet(last["rows"]), last["id"])
    return out


STATS = {"proj_move_usd": "CASE WHEN pattern = 'wedge' THEN round(close * greatest(1.034 - 0.146 * mid_travel, 0.0) / 100, 4) END",
         "slope_upper": "round(b_upper, 6) + 0.0", "slope_lower": "round(b_lower, 6) + 0.0",
         "apex_min": f"coalesce(round_even(x_cross - {FIT - 1}, 0), 0.0) + 0.0",
         "apex_price": "coalesce(round(a_upper + b_upper * x_cross, 4), 0.0) + 0.0",
         "mid_travel": "round(mid_travel, 4) + 0.0", "convergence": "round(convergence, 4) + 0.0",
         "touch_up": "CAST(touch_up AS DOUBLE)", "touch_lo": "CAST(touch_lo AS DOUBLE)", "max_excursion": "round(max_excursion, 4) + 0.0"}


@query(f"""WITH RECURSIVE {_low_sql()} SELECT symbol, {ts('date_end', 'ts')}, pattern, {N} AS window,
{', '.join(f'{e} AS {n}' for n, e in STATS.items())} FROM dec WHERE signal = 1""")
def s8_live_tables(spark, sf):
    """The signals that a live run has stored by day, with all ten statistics."""
    signals = days.read_days(spark, f"{_stored(spark, sf, LOW)}/signals", SIGNALS)
    return signals.select("symbol", text_ts().alias("ts"), "pattern", "window", *STAT_COLS)


@query(f"""WITH RECURSIVE {decided_sql(base=LIVE_IDX)}, cells AS (SELECT i.symbol, i.ts, i.bar_idx, f.pattern FROM idx i CROSS JOIN forms f)
SELECT c.symbol, {ts('c.ts', 'ts')}, c.pattern, {N} AS window, CAST(least(c.bar_idx + 1, {N}) AS INT) AS bars, round(d.score + 3e-8, 6) + 0.0 AS score, coalesce(d.signal, 0) AS signal
FROM cells c LEFT JOIN dec d ON d.symbol = c.symbol AND d.end_idx = c.bar_idx AND d.pattern = c.pattern""")
def k10_live_scores_by_day(spark, sf):
    """The scores table of a live run kept by day, a retried batch included."""
    scores = days.read_days(spark, f"{_stored(spark, sf, FORMS)}/scores", SCORES)
    return scores.select("symbol", text_ts().alias("ts"), "pattern", "window", "bars", *r("score"), "signal")


# --- bars out of order -----------------------------------------------------------------------

DELAY, SLOT, SPREAD = 6 * 3600, 72, 5  # seconds held back; hours a file; hours that a bar may come after its turn
KEY = "md5(concat(symbol, ':', strftime(ts, '%Y-%m-%d %H')))"
TOO_LATE = f"substr({KEY}, 1, 2) = '00' AND ts < TIMESTAMP '{HALF}'"
ORDERLY = SEEN.replace("FROM bars)", f"FROM bars WHERE NOT ({TOO_LATE}))", 1)


def _disordered(spark, sf):
    """Bars delivered up to SPREAD hours after their turn, some of them in the last file of all; rows of the stream."""
    b = _flagged(spark, sf)
    key = F.md5(F.concat("symbol", F.lit(":"), F.date_format("ts", "yyyy-MM-dd HH")))
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    late = (F.substring(key, 1, 2) == "00") & (F.col("ts") < HALF)
    turn = F.floor((hour + F.conv(F.substring(key, 3, 2), 16, 10).cast("long") % SPREAD) / SLOT)
    b = b.withColumn("_file", F.when(late, F.lit(1 << 40)).otherwise(turn))
    # A symbol of its own ends the event clock's day: what is still held back comes out.
    end = b.agg(F.max("ts").alias("ts")).selectExpr("'~' AS symbol", "ts + INTERVAL 2 DAYS AS ts", *[f"1D AS {c}" for c in FEATURE_COLS],
                                                    "false AS in_session", f"{(1 << 40) + 1}L AS _file")
    b = b.unionByName(end.select(*b.columns))
    src, out, mark = (scratch_path(spark, n) for n in ("late-in", "late-out", "late-mark"))
    for (k,) in sorted(b.select("_file").distinct().collect()):  # one file a turn, in order: the feed being played
        b.where(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(src)
    stream = monitor.bar_stream(spark, src, b.drop("_file").schema, files_per_batch=1)
    _stream_to_table(live.live_rows(stream, [N], SPIKE_LIMIT, delay=DELAY, forget=400 * 86400), mark, out)
    return spark.read.schema(live.ROWS).parquet(out)


@query(_sized_sql([N], ORDERLY))
def t8_reordered_bars(spark, sf):
    """Windows of bars that came out of order are those of the bars in order; what came too late is in none."""
    return _sized(_disordered(spark, sf), [N])


@query(f"WITH {bars_sql()} SELECT symbol, {ts('ts')}, close FROM bars WHERE {TOO_LATE}")
def t8_too_late_bars(spark, sf):
    """Bars that came after their release are given out for the bars table only."""
    return _disordered(spark, sf).where("kind = 'late'").select("symbol", text_ts().alias("ts"), "close")
