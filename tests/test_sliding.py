"""Flat-cost windows, sparse outcomes and prefix moments against plain definitions."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeforge.operators import forward, geometry, windows
from tapeforge.plans import corpus, detect
from test_plans import plan
from test_windows import frame, walk


@pytest.mark.parametrize("length, chunk", [(1, 16), (2, 16), (7, 16), (30, 64), (30, 31), (100, 128)])
def test_sliding_extremes_follow_the_definition(spark, length, chunk):
    close = walk(300, 3)
    ix = frame(spark, close)

    def steps(df, spec):
        return windows.sliding_extremes(df, {"top": (F.col("close"), F.max), "bottom": (F.col("close"), F.min)}, length)

    got = windows.over_chunks(ix, steps, back=length, chunk=chunk).orderBy("bar_idx").toPandas()
    s = pd.Series(close).rolling(length)
    np.testing.assert_allclose(got["top"].astype(float)[length - 1:], s.max()[length - 1:])
    np.testing.assert_allclose(got["bottom"].astype(float)[length - 1:], s.min()[length - 1:])
    assert len(got) == 300 and got["top"][:length - 1].isna().all()


def test_ranges_cost_the_same_for_any_length(spark):
    ix = spark.range(60_000).select(F.lit("A").alias("symbol"), F.col("id").alias("bar_idx"),
                                    *[(F.sin("id") + k).alias(c) for k, c in enumerate(("open", "high", "low", "close", "volume"))]).cache()
    ix.count()

    def took(length):
        best = 1e9
        for _ in range(3):
            t = time.perf_counter()
            windows.window_ranges(ix, length, chunk=16384).agg(F.sum("price_range")).collect()
            best = min(best, time.perf_counter() - t)
        return best

    took(30)
    assert took(1000) < 3 * took(30) + 0.5
    assert "rangeframe" not in plan(windows.window_ranges(ix, 1000)).lower()
    ix.unpersist()


def test_outcomes_of_sparse_events_are_those_of_all_bars(spark):
    ix = frame(spark, walk(900, 4)).unionByName(frame(spark, walk(40, 5), "B")).cache()
    hits = spark.createDataFrame([("A", e) for e in (0, 63, 64, 100, 511, 700, 890, 899)] + [("B", 3), ("B", 39), ("B", 400), ("C", 1), ("A", 100)],
                                 "symbol string, end_idx long")
    horizons = [1, 5, 64, 130, 600]
    cols = [f"{f}_{h}" for h in horizons for f in ("ret", "mae", "mfe", "win")]
    want = forward.excursions(ix, horizons, 4096).withColumnRenamed("bar_idx", "end_idx").join(hits.distinct(), ["symbol", "end_idx"])
    for chunk in (64, 4096):
        got = forward.outcomes_at(hits, ix, horizons, chunk=chunk)
        key = lambda df: sorted(map(tuple, df.select("symbol", "end_idx", *cols).collect()))
        assert key(got) == key(want) and got.count() == 10
    ix.unpersist()


def test_spans_are_made_of_few_blocks(spark):
    spans = spark.createDataFrame([(0, 0), (1, 240), (7, 8), (5, 100_000), (64, 127), (32767, 32768)], "first long, last long")
    for r in spans.select("first", "last", forward._blocks("first", "last").alias("b")).collect():
        covered = sorted(p for b in r.b for p in range(b.block << 3 * b.level, (b.block + 1) << 3 * b.level))
        assert covered == list(range(r.first, r.last + 1)) and len(r.b) <= 14 * 4 + 4


def test_no_frame_runs_over_the_bars_for_sparse_events(spark):
    ix = frame(spark, walk(200))
    text = plan(forward.outcomes_at(ix.where("bar_idx = 20").select("symbol", F.col("bar_idx").alias("end_idx")), ix, [10, 60]))
    assert "Window" not in text and "NestedLoop" not in text and "CartesianProduct" not in text
    assert detect.backtest(ix, ix.where("bar_idx = 5").select("symbol", F.col("bar_idx").alias("end_idx")), [3]).count() == 1


@pytest.mark.parametrize("length, stride, chunk", [(2, 1, 32), (30, 7, 64), (50, 10, 4096)])
def test_slopes_and_channels_follow_the_definition(spark, length, stride, chunk):
    close = walk(260, 6) + 1e6  # far from zero: the sums are of what is left after centring
    ix = frame(spark, close)
    fast = {r.start_idx: r for r in geometry.rolling_slopes(ix, length, stride, chunk=chunk).collect()}
    got = {r.start_idx: r for r in corpus.confirmed_negative(ix, length, stride, "corrected", chunk).collect()}
    starts = list(range(0, len(close) - length + 1, stride))
    assert sorted(got) == sorted(fast) == starts
    x = np.arange(length)
    for s in starts:
        y = close[s:s + length]
        slope = np.polyfit(x, y, 1)[0]
        rel = (y - (y[0] - 0.5 + slope * x)) / (1 + 1e-10)
        for r in (got[s], fast[s]):
            assert r.slope_high == pytest.approx(slope, abs=1e-6) and r.slope_low == pytest.approx(slope, abs=1e-6)
        assert got[s].rel_min == pytest.approx(rel.min(), abs=1e-4) and got[s].rel_max == pytest.approx(rel.max(), abs=1e-4)
    text = plan(corpus.confirmed_negative(ix, length, stride))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_window_bars_are_the_bars_of_the_windows(spark):
    close = walk(200, 7)
    ix = frame(spark, close).unionByName(frame(spark, walk(30, 8), "B"))
    starts = spark.createDataFrame([("A", 0, 19), ("A", 55, 74), ("A", 180, 199), ("A", 190, 209), ("B", 10, 29), ("A", 55, 74)],
                                   "symbol string, start_idx long, end_idx long")
    got = windows.window_bars(ix, starts, 20, chunk=32).where("symbol = 'A'").orderBy("start_idx", "pos").toPandas()
    assert got.groupby("start_idx").size().to_dict() == {0: 20, 55: 20, 180: 20}
    np.testing.assert_allclose(got["close"], np.concatenate([close[s:s + 20] for s in (0, 55, 180)]))
    scaled = windows.normalised_windows(ix, starts, 20, 32).groupBy("symbol", "start_idx").agg(
        F.min(F.least("open", "high", "low", "close")).alias("lo"), F.max(F.greatest("open", "high", "low", "close")).alias("hi"), F.max("volume").alias("v"))
    assert all((r.lo, r.hi, r.v) == (0.0, 1.0, 1.0) for r in scaled.collect()) and scaled.count() == 4
