"""Shared inputs of the registered queries and the SQL that rebuilds them for the oracle.

Bars are hourly OHLCV per event type, made from the whole ``events`` table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeforge.functions.scalars import rounded
from tapeforge.operators.gates import categorise, decide, per_formation, signal_stats
from tapeforge.operators.indexing import with_bar_index
from tapeforge.plans import detect
from tapeforge.schemas import FORMATIONS
from tapeforge.session import cut_lineage
from tapeforge.sources.bars import bars_from_ticks

N, FIT, THRESHOLD, CHUNK = 30, 24, 0.6, 256
HORIZONS = [3, 6, 12, 24]
LOOKBACK, VOL_WINDOW, STRIDE = 30, 39, 5
GAP_EDGES = [0.0, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0]
SEED = 7
NUDGE = 3e-8
FORMS = [{**f, "window": N, "fit_bars": FIT} for f in FORMATIONS]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


# --- Spark side ---------------------------------------------------------------

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars(spark: SparkSession, sf: str, unit: str = "hour") -> DataFrame:
    return bars_from_ticks(table(spark, sf, "events"), unit)


def indexed(spark: SparkSession, sf: str, unit: str = "hour") -> DataFrame:
    return with_bar_index(bars(spark, sf, unit))


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return detect.scan(indexed(spark, sf), N, FIT, chunk=CHUNK)


def stored_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows written once, for queries that read them several times."""
    return cut_lineage(windows(spark, sf))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return detect.find_events(stored_windows(spark, sf), N, THRESHOLD, CHUNK)


def filtered(spark: SparkSession, sf: str) -> DataFrame:
    return categorise(events(spark, sf))


def decided(spark: SparkSession, sf: str, mode: str = "documented") -> DataFrame:
    w = windows(spark, sf).withColumn("ts", F.col("date_end")).withColumn("depth", F.lit(N))
    return decide(per_formation(w, FORMS), mode)


def scores_table(spark: SparkSession, sf: str) -> DataFrame:
    return decided(spark, sf).select("symbol", "ts", "pattern", "window", "score", "signal",
                                     F.col("depth").alias("bars"))


def stats_rows(spark: SparkSession, sf: str) -> DataFrame:
    return signal_stats(decided(spark, sf))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """(window_id, type, label, score) from labels and documents, with an md5-made score that leans to the label."""
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    noise = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("double") / 16777215.0
    return d.select(F.col("doc_id").alias("window_id"), F.col("source").alias("type"),
                    F.col("quality").alias("label"),
                    (F.floor((noise * 0.7 + F.col("quality") * 0.3) * 200) / 200).alias("score"))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus manifest rows out of the documents table; language is the family."""
    return table(spark, sf, "documents").select(
        (F.col("lang") == "en").cast("int").alias("label"), F.col("lang").alias("type"),
        F.col("doc_id").alias("original_idx"))


def text_ts(c: Column | str = "ts") -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def r(*names: str) -> list[Column]:
    """Columns rounded to six digits under their own names.

    Many values are short decimals that end in a 5 at the seventh digit, where
    engines may round either way; a nudge of 3e-8 on both sides settles those.
    """
    return [rounded(F.col(n) + NUDGE).alias(n) for n in names]


# --- SQL side -----------------------------------------------------------------

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def ts(c: str = "ts", name: str | None = None) -> str:
    return f"{TS.format(c)} AS {name or c}"


def rs(*names: str) -> str:
    return ", ".join(f"round({n} + {NUDGE}, 6) + 0.0 AS {n}" for n in names)


def bars_sql(unit: str = "hour") -> str:
    return f"""
tick AS (SELECT event_type AS symbol, date_trunc('{unit}', ts) AS bts, ts AS tts, event_id, value FROM events),
bars AS (SELECT symbol, bts AS ts, first(value ORDER BY tts, event_id) AS open, max(value) AS high,
         min(value) AS low, last(value ORDER BY tts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
         FROM tick GROUP BY symbol, bts)"""


def idx_sql(unit: str = "hour") -> str:
    return bars_sql(unit) + """,
days AS (SELECT symbol, CAST(ts AS DATE) AS day, min(hour(ts) * 60 + minute(ts)) AS first_minute
         FROM bars GROUP BY symbol, CAST(ts AS DATE)),
anchors AS (SELECT symbol, first_minute AS anchor FROM (
              SELECT symbol, first_minute, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, first_minute) AS k
              FROM days GROUP BY symbol, first_minute) WHERE k = 1),
idx0 AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx,
         count(*) OVER (PARTITION BY symbol) AS n_bars,
         dense_rank() OVER (PARTITION BY symbol ORDER BY CAST(ts AS DATE)) - 1 AS day_no FROM bars),
idx AS (SELECT i.*, max(bar_idx) OVER (PARTITION BY i.symbol, day) + 1 AS next_day_idx,
        hour(ts) * 60 + minute(ts) - anchor AS session_minute FROM idx0 i JOIN anchors USING (symbol))"""


def fit_sql(points: str, keys: str, prefix: str = "") -> str:
    """CTEs u3/l3 with the envelope lines of the point rows (keys, x, high, low)."""
    out = []
    for side, y, q, op in (("u", "high", "0.55", ">="), ("l", "low", "0.45", "<=")):
        s = f"{prefix}{side}"
        src = points
        for i in (1, 2, 3):
            out.append(f"{s}{i} AS MATERIALIZED (SELECT {keys}, regr_intercept({y}, x) AS a, regr_slope({y}, x) AS b "
                       f"FROM {src} GROUP BY {keys})")
            if i < 3:
                out.append(f"{s}{i}r AS MATERIALIZED (SELECT {keys}, x, {y}, {y} - (a + b * x) AS r "
                           f"FROM {points} JOIN {s}{i} USING ({keys}))")
                out.append(f"{s}{i}q AS MATERIALIZED (SELECT {keys}, quantile_cont(r, {q}) AS q FROM {s}{i}r GROUP BY {keys})")
                out.append(f"{s}{i}k AS MATERIALIZED (SELECT {s}{i}r.* FROM {s}{i}r JOIN {s}{i}q USING ({keys}) "
                           f"WHERE r {op} q)")
                src = f"{s}{i}k"
    return ",\n".join(out)


def windows_sql(n: int = N, fit: int = FIT, where: str = "TRUE", base: str | None = None) -> str:
    """CTE chain ending in ``win``: every window with all measures and the default score.

    ``base`` replaces the CTEs that define ``idx``.
    """
    k = "symbol, start_idx"
    third = max(fit // 3, 2)
    return (base or idx_sql()) + f""",
wpts AS MATERIALIZED (SELECT a.symbol, a.bar_idx AS start_idx, b.bar_idx - a.bar_idx AS pos, b.open, b.high, b.low, b.close, b.volume
         FROM idx a JOIN idx b ON a.symbol = b.symbol AND b.bar_idx BETWEEN a.bar_idx AND a.bar_idx + {n - 1}
         WHERE a.bar_idx <= a.n_bars - {n} AND ({where})),
fpts AS MATERIALIZED (SELECT symbol, start_idx, pos - {n - fit} AS x, high, low FROM wpts WHERE pos >= {n - fit}),
{fit_sql("fpts", k)},
fits AS MATERIALIZED (SELECT {k}, u3.a AS a_upper, u3.b AS b_upper, l3.a AS a_lower, l3.b AS b_lower, price_range
         FROM u3 JOIN l3 USING ({k}) JOIN (SELECT {k}, greatest(max(high) - min(low), 1e-12) AS price_range FROM fpts GROUP BY {k}) p USING ({k})),
rail AS (SELECT {k}, x, high, low, a_upper + b_upper * x AS up, a_lower + b_lower * x AS lo FROM fpts JOIN fits USING ({k})),
mw AS (SELECT {k}, greatest(avg(abs(up - lo)), 1e-12) AS mean_gap FROM rail GROUP BY {k}),
brk AS (SELECT {k}, x, greatest(high - up, lo - low, 0.0) / mean_gap AS exc,
         high >= up - 0.18 * abs(up - lo) AS nu, low <= lo + 0.18 * abs(up - lo) AS nl FROM rail JOIN mw USING ({k})),
vis AS (SELECT *, nu AND NOT coalesce(lag(nu) OVER w, FALSE) AS vu, nl AND NOT coalesce(lag(nl) OVER w, FALSE) AS vl
         FROM brk WINDOW w AS (PARTITION BY {k} ORDER BY x)),
contain AS (SELECT {k}, max(exc) AS max_excursion, avg(exc) AS mean_excursion,
         avg(CASE WHEN exc > 0.02 THEN 1.0 ELSE 0.0 END) AS frac_outside,
         CASE WHEN sum(exc) > 1e-12 THEN max(exc) / sum(exc) ELSE 0.0 END AS spike_share,
         CAST(count(*) FILTER (WHERE vu) AS INT) AS touch_up, CAST(count(*) FILTER (WHERE vl) AS INT) AS touch_lo
         FROM vis GROUP BY {k}),
geo AS (SELECT *, start_idx + {n - 1} AS end_idx, b_upper / price_range AS m_upper, b_lower / price_range AS m_lower,
         b_upper / price_range * {fit} AS travel_upper, b_lower / price_range * {fit} AS travel_lower,
         (a_upper - a_lower) / price_range AS width_start,
         ((a_upper + b_upper * {fit - 1}) - (a_lower + b_lower * {fit - 1})) / price_range AS width_end
         FROM fits JOIN contain USING ({k})),
vol AS (SELECT symbol, bar_idx, close, close - coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx), close) AS d FROM idx),
volt AS (SELECT symbol, bar_idx AS end_idx, CASE WHEN early > 1e-12 THEN late / early END AS vol_trend FROM (
         SELECT symbol, bar_idx,
           stddev_pop(d) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {third - 1} PRECEDING AND CURRENT ROW) AS late,
           stddev_pop(d) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {fit - 1} PRECEDING AND {fit - third} PRECEDING) AS early
         FROM vol)),
win0 AS (SELECT g.*, CASE WHEN width_start > 1e-9 THEN 1 - width_end / width_start ELSE 0.0 END AS convergence,
         (travel_upper + travel_lower) / 2 AS mid_travel,
         s.ts AS date_start, e.ts AS date_end, e.close, e.session_minute, vol_trend,
         e.day_no - s.day_no AS n_gaps,
         CASE WHEN e.day_no > s.day_no THEN s.next_day_idx - s.bar_idx ELSE -1 END AS gap_pos
         FROM geo g JOIN idx s ON s.symbol = g.symbol AND s.bar_idx = g.start_idx
         JOIN idx e ON e.symbol = g.symbol AND e.bar_idx = g.end_idx
         JOIN volt v ON v.symbol = g.symbol AND v.end_idx = g.end_idx),
win AS MATERIALIZED (SELECT *, 1.0 / (1.0 + exp(-(greatest(least(convergence, 2.0), -2.0) * 0.5
         + (least(touch_up, touch_lo) - 5) * 0.6))) AS score,
         CASE WHEN b_upper - b_lower < -1e-12 THEN (a_lower - a_upper) / (b_upper - b_lower) END AS x_cross FROM win0)"""


def clustered_sql(src: str, out: str) -> str:
    return f"""
{out}_f AS (SELECT *, coalesce(start_idx > max(end_idx) OVER (PARTITION BY symbol ORDER BY start_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS opens FROM {src}),
{out}_g AS (SELECT *, max(CASE WHEN opens THEN start_idx END) OVER (PARTITION BY symbol ORDER BY start_idx) AS event_start FROM {out}_f),
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY symbol, event_start ORDER BY score DESC, start_idx) AS k,
         count(*) OVER (PARTITION BY symbol, event_start) AS n_windows,
         max(end_idx) OVER (PARTITION BY symbol, event_start) AS event_end FROM {out}_g),
{out} AS MATERIALIZED (SELECT * FROM {out}_r WHERE k = 1)"""


def events_sql() -> str:
    return windows_sql() + f""",
det AS (SELECT * FROM win WHERE score >= {THRESHOLD}),{clustered_sql("det", "ev")}"""


CATEGORY = """CASE WHEN convergence < 0 THEN 'DIVERGING' WHEN convergence < 0.5 THEN 'NEAR-PARALLEL'
 WHEN touch_up < 5 OR touch_lo < 5 THEN 'UNTOUCHED' WHEN max_excursion > 1.98 OR frac_outside > 1.01 THEN 'ESCAPES' ELSE 'CLEAN' END"""


def filtered_sql() -> str:
    return events_sql() + f""",
flt AS (SELECT *, {CATEGORY} AS category FROM ev)"""


def forward_sql(horizons=HORIZONS) -> str:
    cols = ", ".join(f"(lead(close, {h}) OVER w - close) / close * 100 AS ret_{h}" for h in horizons)
    return f"""
fwd AS (SELECT symbol, bar_idx, {cols} FROM idx WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))"""


def _lit(v) -> str:
    return "NULL" if v is None else ("TRUE" if v is True else "FALSE" if v is False else
                                     f"'{v}'" if isinstance(v, str) else f"{v}")


def formations_sql() -> str:
    cols = ["pattern", "threshold", "apex_gate", "quality_gate", "geometry", "log_only", "min_conv", "max_conv",
            "min_touches", "max_exc"]
    rows = ", ".join("(" + ", ".join(_lit(f[c]) for c in cols) + ")" for f in FORMS)
    return f"forms AS (SELECT * FROM (VALUES {rows}) f({', '.join(cols)}))"


def decided_sql(mode: str = "documented", base: str | None = None) -> str:
    both = "(NOT apex_gate OR apex_ok) AND quality_ok"
    gate = both if mode == "documented" else f"CASE WHEN apex_gate THEN {both} ELSE TRUE END"
    return windows_sql(base=base) + f""",
{formations_sql()},
qual AS (SELECT win.*, forms.*, coalesce(x_cross - {FIT - 1} <= 360, FALSE) AS apex_ok,
  CASE WHEN quality_gate THEN (min_touches IS NULL OR (touch_up >= min_touches AND touch_lo >= min_touches))
    AND (min_conv IS NULL OR convergence >= min_conv) AND (max_conv IS NULL OR convergence <= max_conv)
    AND (max_exc IS NULL OR max_excursion <= max_exc) ELSE TRUE END AS quality_ok FROM win CROSS JOIN forms),
dec AS MATERIALIZED (SELECT *, CAST(score >= threshold AND (NOT geometry OR ({gate})) AS INT) AS detection,
  CASE WHEN log_only THEN 0 ELSE CAST(score >= threshold AND (NOT geometry OR ({gate})) AS INT) END AS signal FROM qual)"""


def labelled_sql() -> str:
    return """lab AS (SELECT doc_id AS window_id, source AS type, quality AS label,
 floor((CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) AS BIGINT) AS DOUBLE) / 16777215.0 * CAST(0.7 AS DOUBLE)
   + quality * CAST(0.3 AS DOUBLE)) * 200) / 200 AS score FROM labels JOIN documents USING (doc_id))"""


def manifest_sql() -> str:
    return """man AS (SELECT CAST(lang = 'en' AS INT) AS label, lang AS type, doc_id AS original_idx FROM documents)"""


def shuffled_sql(src: str, out: str, seed: int, *ids: str) -> str:
    key = ", ".join(f"CAST({c} AS VARCHAR)" for c in ids)
    return (f"{out} AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '{seed}', {key})), {', '.join(ids)}) - 1 "
            f"AS shuffled_idx FROM {src})")

