"""What the physical plans look like: shuffles, push-down, absence of nested loops."""

import pytest
from pyspark.sql import functions as F

from tapeforge.operators import forward, geometry
from tapeforge.operators.gates import per_formation
from tapeforge.operators.indexing import with_bar_index
from tapeforge.plans import detect, serving
from tapeforge.schemas import FORMATIONS


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars") / "t")
    n = 3000
    bars = spark.range(n).select(
        F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"),
        *[(100 + F.sin(F.col("id") / 50) + d).alias(c) for c, d in (("open", 0.0), ("high", 1.0), ("low", -1.0), ("close", 0.2))],
        F.lit(1.0).alias("volume"))
    with_bar_index(bars).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_shuffles_the_bars_once(stored):
    text = plan(detect.scan(stored, 50, 40))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("FlatMapGroupsInPandas") == 1


def test_frame_operators_shuffle_once(stored):
    for df in (forward.excursions(stored, [5, 20]), forward.trailing_volatility(stored, 50),
               forward.volatility_trend(stored, 50, 40)):
        assert plan(df).count("Exchange hashpartitioning") == 1


def test_built_in_fit_shuffles_once(stored):
    points = stored.select("symbol", (F.col("bar_idx") % 100).alias("pos"), (F.expr("bar_idx div 100")).alias("start_idx"),
                           "high", "low")
    assert plan(geometry.envelope_fit_sql(points, ["symbol", "start_idx"])).count("Exchange hashpartitioning") == 1


def test_range_query_reaches_the_scan(stored):
    text = plan(serving.range_filter(stored.drop("day"), "2023-11-15", "2023-11-16").select("symbol", "ts", "close"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text and "LessThan(ts" in text
    assert "ReadSchema: struct<symbol:string,ts:timestamp,close:double>" in text


def test_newest_rows_use_top_k(stored):
    assert "TakeOrderedAndProject" in plan(stored.orderBy(F.desc("ts")).limit(10))
    assert "TakeOrderedAndProject" in plan(serving.newest(stored, 10))


def test_formations_are_attached_without_a_join(stored):
    text = plan(per_formation(stored, FORMATIONS))
    assert "Join" not in text and "Exchange" not in text


def test_index_shuffles_bars_by_symbol_and_day(stored):
    text = plan(with_bar_index(stored.select("symbol", "ts", "close")))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "SinglePartition" not in text


def test_sparse_fit_measures_only_the_wanted_windows(stored):
    hits = stored.where("bar_idx in (99, 700, 2500)").select("symbol", F.col("bar_idx").alias("end_idx"))
    got = detect.scan(stored, 50, 40, at=hits).orderBy("end_idx").select("end_idx", "convergence").collect()
    every = {r.end_idx: r.convergence for r in detect.scan(stored, 50, 40).collect()}
    assert [(r.end_idx, r.convergence) for r in got] == [(e, every[e]) for e in (99, 700, 2500)]


def test_range_query_prunes_day_partitions(spark, stored, tmp_path):
    path = str(tmp_path / "daily")
    stored.write.partitionBy("day").parquet(path)
    d = spark.read.parquet(path)
    text = plan(serving.range_filter(d, "2023-11-15 06:00:00", "2023-11-15 12:00:00"))
    assert "PartitionFilters: [isnotnull(day" in text and "2023-11-15" in text
    got = serving.range_filter(d, "2023-11-15 06:00:00", "2023-11-15 12:00:00").count()
    assert got == stored.where("ts >= '2023-11-15 06:00:00' and ts < '2023-11-15 12:00:00'").count() == 360


def test_hot_symbols_are_not_shuffled_by_symbol_alone(spark):
    """With broadcasts off, as for large inputs, bars meet per-symbol values under finer keys."""
    from tapeforge.operators import sampling, windows

    bars = spark.range(2000).select(F.lit("a").alias("symbol"), F.col("id").alias("bar_idx"), F.lit(2000).alias("n_bars"),
                                    F.col("id").cast("double").alias("close"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sample = plan(sampling.random_baseline(bars, 10, 5, 1, 100))
        lags = plan(windows.lag_sequences(bars, "close", 5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for text in (sample, lags):
        joins = [line for line in text.splitlines() if "Join" in line]
        assert joins and all("bucket" in j or "_salt" in j for j in joins if "Join [" in j or "Join(" in j), joins


def test_quantiles_of_crowded_scores(spark):
    """Scores that all lie in one bucket of the first level are parted evenly by the second."""
    from tapeforge.functions.ranking import quantiles

    df = spark.range(100_000).select((1 - (F.col("id") + 1) * 1e-10).alias("score"))
    got = quantiles(df, [], ("score", {"p5": 0.05, "p50": 0.5})).first()
    assert abs(got.p50 - (1 - 50000.5e-10)) < 1e-14 and abs(got.p5 - (1 - 95000.05e-10)) < 1e-14


def test_scratch_folder_is_shared_or_refused():
    from tapeforge import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
