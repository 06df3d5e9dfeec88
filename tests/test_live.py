"""Live state and tables: retries, days, idle symbols."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeforge.schemas import FEATURE_COLS, KEY_BARS, SCORES
from tapeforge.sources import days
from tapeforge.streaming import live, monitor

T0 = dt.datetime(2024, 1, 1)
BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def bar(symbol, minute, close):
    return (symbol, T0 + dt.timedelta(minutes=minute), close, close + 1, close - 1, close, 1.0)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_days_are_merged_and_a_retry_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "bars")
    first = spark.createDataFrame([bar("A", m, 100.0) for m in (0, 1, 1440, 2880)], BARS)
    second = spark.createDataFrame([bar("A", 1, 200.0), bar("B", 1441, 5.0), bar("A", 1, 150.0)], BARS)
    days.merge_days(first, path, KEY_BARS, 0)
    days.merge_days(second, path, KEY_BARS, 1)
    want = rows_of(days.read_days(spark, path, first.schema))
    assert len(want) == 5 and [r[5] for r in want] == [100.0, 200.0, 100.0, 100.0, 5.0]
    days.merge_days(second, path, KEY_BARS, 1)
    assert rows_of(days.read_days(spark, path, first.schema)) == want
    assert days.folders(spark, path) == {"2024-01-01": [0, 1], "2024-01-02": [0, 1], "2024-01-03": [0]}
    days.merge_days(spark.createDataFrame([bar("A", 2, 1.0)], BARS), path, KEY_BARS, 2)
    assert days.folders(spark, path)["2024-01-01"] == [1, 2]  # one folder is in force, one is for readers under way
    assert len(list((tmp_path / "bars" / "day=2024-01-01" / "batch=2").glob("part-*"))) == 1
    assert days.read_days(spark, path, first.schema, since="2024-01-02", until="2024-01-02").count() == 2
    assert days.read_days(spark, str(tmp_path / "none"), first.schema).count() == 0


def test_a_batch_that_failed_half_way_is_written_whole_by_its_retry(spark, tmp_path):
    """Bars were stored, scores were not, and one day's folder of the next try is already there."""
    form = [dict(pattern="p", window=3, threshold=0.1, apex_gate=False, quality_gate=False, geometry=False, log_only=False,
                 fit_bars=None, min_conv=None, max_conv=None, min_touches=None, max_exc=None)]
    model = {("p", 3): lambda: (lambda batch: batch[:, -1, 3])}
    rnd = random.Random(1)
    feed = spark.createDataFrame([bar("A", 720 * k, 100 + rnd.random()) for k in range(12)], BARS).withColumn("in_session", F.lit(True))

    def run(name, fail_in):
        base = str(tmp_path / name)
        write = live.store_live(f"{base}/bars", f"{base}/scores", f"{base}/signals", form, model)
        tries = []

        def flaky(batch, batch_id):
            tries.append(batch_id)
            if tries.count(batch_id) <= fail_in.get(batch_id, 0):
                days.merge_days(batch.where("kind <> 'block'").select("symbol", "ts", *FEATURE_COLS), f"{base}/bars", KEY_BARS, batch_id)
                raise RuntimeError("executor lost")
            write(batch, batch_id)

        for k in range(3):
            feed.where(f"minute(ts) = 0 and hour(ts) % 12 = 0 and floor((dayofyear(ts) - 1) / 2) = {k}").coalesce(1).write.mode("append").parquet(f"{base}/in")
            stream = live.live_rows(monitor.bar_stream(spark, f"{base}/in", feed.schema), [3], 1e9)
            while True:
                try:
                    monitor.run_available(stream, flaky, f"{base}/mark")
                    break
                except Exception as e:
                    assert "executor lost" in str(e)
        return (rows_of(days.read_days(spark, f"{base}/bars", spark.createDataFrame([], BARS).schema)),
                rows_of(days.read_days(spark, f"{base}/scores", SCORES))), tries

    smooth, _ = run("smooth", {})
    rough, tries = run("rough", {0: 1, 1: 2})
    assert rough == smooth and len(smooth[0]) == len(smooth[1]) == 12 and tries.count(1) == 3
    assert sum(r[4] is not None for r in smooth[1]) == 10  # two bars while the window fills


def test_held_bars_come_in_order_and_idle_symbols_are_forgotten(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = spark.createDataFrame([], BARS + ", in_session boolean").schema
    files = [[bar("A", 3, 3.0), bar("A", 1, 1.0), bar("B", 0, 1.0)], [bar("A", 2, 2.0), bar("A", 9, 9.0)], [bar("A", 30, 30.0), bar("A", 1, 7.0)],
             [bar("A", 0, 0.5), bar("A", 600, 40.0)], [bar("Z", 5000, 1.0)]]
    for f in files:
        spark.createDataFrame([(*b, True) for b in f], schema).coalesce(1).write.mode("append").parquet(src)
    stream = live.live_rows(monitor.bar_stream(spark, src, schema, 1), [4], 1e9, delay=300, forget=86400 * 30, idle=3600)
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
     .trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.schema(live.ROWS).parquet(out)
    taken = [r.close for r in rows.where("kind = 'bar' and symbol = 'A'").orderBy("ts").collect()]
    assert taken == [7.0, 2.0, 3.0, 9.0, 30.0, 40.0]  # minute 1 came again while it was held
    late = [r.close for r in rows.where("kind = 'late'").collect()]
    assert late == [0.5]
    blocks = rows.where("kind = 'block' and symbol = 'A'").orderBy("seen").collect()
    assert [c for b in blocks for c in b.block_close[-b.fresh:]] == taken
    heads = spark.read.format("statestore").option("stateVarName", "head").load(mark)
    assert {r.symbol for r in heads.select("key.symbol").collect()} <= {"A", "Z"}


@pytest.mark.parametrize("sizes", [[1], [2, 5], [7, 3, 12]])
def test_blocks_give_every_window_of_every_size(spark, tmp_path, sizes):
    rnd = random.Random(len(sizes))
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    closes = {s: [round(100 + rnd.random(), 3) for _ in range(n)] for s, n in (("A", 40), ("B", 4))}
    bars = [(*bar(s, m, c), True) for s, cs in closes.items() for m, c in enumerate(cs)]
    schema = spark.createDataFrame([], BARS + ", in_session boolean").schema
    for cut in (range(0, 1), range(1, 18), range(18, 40)):
        spark.createDataFrame([b for b in bars if (b[1] - T0).seconds // 60 in cut], schema).coalesce(2).write.mode("append").parquet(src)
        q = live.live_rows(monitor.bar_stream(spark, src, schema), sizes, 1e9).writeStream.format("parquet")
        q.option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    got = live.block_windows(spark.read.schema(live.ROWS).parquet(out), [(n, n) for n in sizes]).collect()
    assert len(got) == 44 * len(sizes)
    for r in got:
        m = (r.ts - T0).seconds // 60
        w = closes[r.symbol][max(0, m - r.size + 1):m + 1]
        assert r.depth == len(w) and (r.top, r.bottom) == ((max(w) + 1, min(w) - 1) if len(w) == r.size else (None, None))
    ring = spark.read.format("statestore").option("stateVarName", "ring").load(mark)
    assert ring.groupBy("key").count().agg(F.max("count")).first()[0] == min(40, max(sizes))


def test_newest_rows_read_few_days(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    bars = spark.createDataFrame([bar(s, 1440 * d + m, float(d)) for d in range(40) for m in (0, 5) for s in ("A", "B") if s == "A" or d < 33], BARS)
    days.merge_days(bars, path, KEY_BARS, 3)
    read = []
    walk = days._walk

    def counted(*a):
        for names, rows in walk(*a):
            read.extend(names)
            yield names, rows

    monkeypatch.setattr(days, "_walk", counted)
    got = days.newest_rows(spark, path, bars.schema, 5).collect()
    assert [(r.symbol, r.close) for r in got] == [("A", 37.0), ("A", 38.0), ("A", 38.0), ("A", 39.0), ("A", 39.0)] and len(read) == 3
    read.clear()
    last = days.latest_by(spark, path, bars.schema, bars.select("symbol")).orderBy("symbol").collect()
    assert [(r.symbol, r.close) for r in last] == [("A", 39.0), ("B", 32.0)] and len(read) == 15
    read.clear()
    assert days.newest_rows(spark, path, bars.schema, 1000, F.col("symbol") == "B").count() == 66 and len(read) == 40
    assert days.newest_rows(spark, str(tmp_path / "no"), bars.schema, 5).count() == 0
