"""Headline timings on one machine; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every entry runs
from the parquet files to its last row; nothing is shared between entries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeforge.operators.detection import shape_score
from tapeforge.operators.indexing import session_gate, with_bar_index
from tapeforge.operators.spikes import spike_filter
from tapeforge.plans import detect, evaluation, jobs
from tapeforge.session import local_session
from tapeforge.sources.bars import bars_from_ticks
from workload.base import labelled

N, FIT, THRESHOLD = 250, 100, 0.6
HORIZONS = [30, 60, 120, 240]
SCORER = (0.5, 0.25, 16)


def ix(spark: SparkSession, sf: str) -> DataFrame:
    return with_bar_index(bars_from_ticks(spark.read.parquet(f"{sf}/events.parquet"), "minute"))


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def scorer():
    return shape_score(*SCORER)


def bar_index(spark, sf):
    drain(ix(spark, sf))


def scan_250(spark, sf):
    drain(detect.scan(ix(spark, sf), N, FIT, scorer=scorer()))


def scan_2m(spark, sf):
    """The given bars 25 times over under other symbols: two million bars at sf0.1."""
    bars = bars_from_ticks(spark.read.parquet(f"{sf}/events.parquet"), "minute")
    copies = bars.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(25))))
    copies = copies.withColumn("symbol", F.concat_ws("-", "symbol", "_k")).drop("_k")
    drain(detect.scan(with_bar_index(copies), N, FIT, scorer=scorer()))


def detect_top(spark, sf):
    drain(detect.detect_top(ix(spark, sf), N, THRESHOLD, 5, 5, FIT, scorer()))


def backtest(spark, sf):
    for df in jobs.backtest_study(ix(spark, sf), N, THRESHOLD, HORIZONS, FIT, scorer=scorer()).values():
        drain(df)


def detection_study(spark, sf):
    for df in jobs.detection_study(ix(spark, sf), N, THRESHOLD, FIT, scorer=scorer()).values():
        drain(df)


def filter_study(spark, sf):
    b = ix(spark, sf)
    ev = detect.find_events(detect.scan(b, N, FIT, 7, scorer()), N, THRESHOLD)
    for df in jobs.filter_study(ev, b, N, FIT, HORIZONS, N).values():
        drain(df)


def volatility_control(spark, sf):
    b = ix(spark, sf)
    hits = detect.detections(detect.scan(b, N, FIT, 7, scorer()), THRESHOLD)
    for df in jobs.volatility_control(hits, b, HORIZONS).values():
        drain(df)


def spike_replay(spark, sf):
    gated = with_bar_index(session_gate(bars_from_ticks(spark.read.parquet(f"{sf}/events.parquet"), "minute")))
    drain(spike_filter(gated, 3.0))


def evaluation_curves(spark, sf):
    scored = labelled(spark, sf)
    drain(evaluation.roc_auc(scored))
    drain(evaluation.pr_auc(scored))
    drain(evaluation.family_stats(scored))


QUERIES = [bar_index, scan_250, scan_2m, detect_top, backtest, detection_study, filter_study, volatility_control, spike_replay,
           evaluation_curves]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:]
    bar_index(spark, sf)  # start the JVM and the Python workers outside the clock
    took = {}
    for fn in QUERIES:
        if names and fn.__name__ not in names:
            continue
        start = time.time()
        fn(spark, sf)
        took[fn.__name__] = round(time.time() - start, 3)
        print(fn.__name__, took[fn.__name__], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "bar_study_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
