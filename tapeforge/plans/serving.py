"""Read queries over stored bars, scores and signals."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F


def range_filter(df: DataFrame, since: str | None = None, until: str | None = None,
                 window: int | None = None, pattern: str | None = None) -> DataFrame:
    """ts >= since and ts < until, optionally one window size and pattern; all reach the scan.

    Tables partitioned by ``day`` are pruned to the days of the range as well.
    """
    for name, value in (("window", window), ("pattern", pattern)):
        if value is not None and name not in df.columns:
            raise ValueError(f"this table has no {name} column")
    if since is not None:
        df = df.where(F.col("ts") >= F.lit(since).cast("timestamp"))
        df = df.where(F.col("day") >= F.lit(since).cast("timestamp").cast("date")) if "day" in df.columns else df
    if until is not None:
        df = df.where(F.col("ts") < F.lit(until).cast("timestamp"))
        df = df.where(F.col("day") <= F.lit(until).cast("timestamp").cast("date")) if "day" in df.columns else df
    if window is not None:
        df = df.where(F.col("window") == window)
    if pattern is not None:
        df = df.where(F.col("pattern") == pattern)
    return df


def newest(df: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest ``limit`` rows, or all of them, in ascending time."""
    ties = [c for c in ("symbol", "pattern", "window") if c in df.columns]
    if limit is not None:
        df = df.orderBy(F.col("ts").desc(), *ties).limit(limit)
    return df.orderBy("ts", *ties)


def range_query(df: DataFrame, since: str | None = None, until: str | None = None, window: int | None = None,
                pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """Every row of the range in ascending time, or the newest ``limit`` of them."""
    return newest(range_filter(df, since, until, window, pattern), limit)


def select_day(df: DataFrame, date: str | None = None) -> DataFrame:
    """Rows of one day, by default the latest. The day's bounds reach the scan and prune a ``day`` partition."""
    if date is None:
        last = df.agg(F.max("day" if "day" in df.columns else "ts")).first()[0]
        if last is None:
            return df.limit(0)
        date = last.strftime("%Y-%m-%d")
    end = (datetime.fromisoformat(date) + timedelta(days=1)).strftime("%Y-%m-%d")
    days = df.where(F.col("day") == F.lit(date).cast("date")) if "day" in df.columns else df
    return days.where((F.col("ts") >= F.lit(date).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))


def latest_bar(bars: DataFrame) -> DataFrame:
    """Newest bar of every symbol."""
    rest = [c for c in bars.columns if c != "symbol"]
    return bars.groupBy("symbol").agg(F.max_by(F.struct(*rest), "ts").alias("_b")).select("symbol", "_b.*")


def latest_scores(scores: DataFrame) -> DataFrame:
    """Newest score row per symbol, pattern and window size; one aggregation, no self join."""
    keys = ["symbol", "pattern", "window"]
    rest = [c for c in scores.columns if c not in keys]
    return scores.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ts").alias("_s")).select(*keys, "_s.*")


def bars_with_scores(bars: DataFrame, wide_scores: DataFrame) -> DataFrame:
    return bars.join(wide_scores, ["symbol", "ts"], "left")


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and first / last time of every table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
             .select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def signal_counts(scores: DataFrame) -> DataFrame:
    """Scored rows and signals per pattern and window size."""
    return scores.groupBy("pattern", "window").agg(F.count(F.lit(1)).alias("n"),
                                                   F.sum("signal").alias("signals"))


def daily_signals(scores: DataFrame) -> DataFrame:
    return scores.groupBy(F.to_date("ts").alias("day"), "window").agg(
        F.sum(F.coalesce("signal", F.lit(0))).alias("signals"))
