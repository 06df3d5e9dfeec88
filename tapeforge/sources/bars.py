"""Where bars come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeforge.schemas import BARS, FEATURE_COLS


def bars_from_ticks(ticks: DataFrame, unit: str, symbol: str = "event_type", ts: str = "ts",
                    value: str = "value", tie: str = "event_id", volume: str | None = None) -> DataFrame:
    """OHLCV bars from ticks; ties in time are ordered by ``tie``.

    One aggregation with map-side combine: a hot symbol still spreads over all
    its bar times.
    """
    order = F.struct(F.col(ts), *[F.col(c) for c in tie.split(",")])
    v = F.col(value).cast("double")
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), F.date_trunc(unit, F.col(ts)).cast("timestamp").alias("ts"))
        .agg(F.min_by(v, order).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"),
             F.max_by(v, order).alias("close"),
             (F.sum(volume) if volume else F.count(F.lit(1))).cast("double").alias("volume"))
    )


def read_bars_csv(spark: SparkSession, path: str, ts_col: str = "ts", symbol: str | None = None) -> DataFrame:
    """CSV bars with header; only the bar columns are read, nothing is inferred. A cell that isn't a number or time is null."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    name = F.lit(symbol) if symbol is not None else F.col("symbol")
    return raw.select(name.alias("symbol"), F.col(ts_col).try_cast("timestamp").alias("ts"),
                      *[F.col(c).try_cast("double").alias(c) for c in FEATURE_COLS])


def read_bars(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of several stored bar tables (parquet, or CSV by suffix) that exists and holds rows."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            continue
        df = read_bars_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path).select(
            "symbol", "ts", *FEATURE_COLS)
        if not df.isEmpty():
            return df
    return spark.createDataFrame([], BARS)


def completed_bars(bars: DataFrame, now: str | None = None, bar_seconds: int = 60, zone: str = "America/New_York") -> DataFrame:
    """Bars that have closed by ``now`` (UTC), with their time shown in exchange time.

    Works on batch and streaming frames alike. Without ``now`` it is the clock, in a
    stream that of each micro-batch; replays and tests name an instant.
    """
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    closed = F.col("ts") <= at - F.make_interval(secs=F.lit(bar_seconds))
    return bars.where(closed).withColumn("ts", F.from_utc_timestamp("ts", zone))


def newest_completed(bars: DataFrame, now: str | None = None, bar_seconds: int = 60) -> DataFrame:
    """The newest closed bar of every symbol."""
    done = completed_bars(bars, now, bar_seconds)
    cols = [c for c in done.columns if c != "symbol"]
    return done.groupBy("symbol").agg(F.max_by(F.struct(*cols), "ts").alias("_b")).select("symbol", "_b.*")
