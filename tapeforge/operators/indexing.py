"""Position of a bar in its series, session clock and session gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tapeforge.schemas import SESSION_CLOSE, SESSION_MINUTES, SESSION_OPEN


def series_days(bars: DataFrame) -> DataFrame:
    """One row per (symbol, day): where the day starts in the series.

    The windows here run over days, not bars: their partitions are bounded by
    the calendar (about 250 rows a year) however many bars a symbol holds.
    """
    per_day = (
        bars.groupBy("symbol", F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("day_bars"),
             F.min(F.hour("ts") * 60 + F.minute("ts")).alias("first_minute"))
    )
    whole = Window.partitionBy("symbol")
    running = whole.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        per_day.withColumn("next_day_idx", F.sum("day_bars").over(running))
        .withColumn("day_no", F.count(F.lit(1)).over(running) - 1)
        .withColumn("n_bars", F.sum("day_bars").over(whole))
        .withColumn("anchor", F.mode("first_minute", True).over(whole))
        .withColumn("day_offset", F.col("next_day_idx") - F.col("day_bars"))
        .drop("first_minute")
    )


def with_bar_index(bars: DataFrame) -> DataFrame:
    """Dense 0-based ``bar_idx`` per symbol plus day and session-clock columns.

    Rows are numbered inside (symbol, day) and shifted by the day's offset, so
    no task ever sorts a whole series; the join reuses that partitioning.
    """
    days = series_days(bars)
    ties = [c for c in bars.columns if c not in ("symbol", "ts", "day")]  # equal times: the same order at every evaluation
    in_day = Window.partitionBy("symbol", "day").orderBy("ts", *ties)
    numbered = bars.withColumn("day", F.to_date("ts")).withColumn("_n", F.row_number().over(in_day))
    return (
        numbered.join(days, ["symbol", "day"])
        .withColumn("bar_idx", F.col("day_offset") + F.col("_n") - 1)
        .withColumn("session_minute",
                    (F.hour("ts") * 60 + F.minute("ts") - F.col("anchor")).cast("int"))
        .drop("_n", "day_bars", "day_offset", "anchor")
    )


def session_gate(bars: DataFrame, calendar: DataFrame | None = None, keep_flag: bool = False) -> DataFrame:
    """Keep bars inside the half-open regular session of their date.

    ``calendar`` (date, open_time, close_time) lists trading days; a missing
    date is closed. Without one, weekdays 09:30-16:00 are assumed. The calendar
    has one row per date, so AQE broadcasts it by its measured size.
    """
    tod = F.date_format("ts", "HH:mm:ss")
    if calendar is None:
        ok = (F.weekday("ts") < 5) & (tod >= SESSION_OPEN) & (tod < SESSION_CLOSE)
        flagged = bars.withColumn("in_session", ok)
    else:
        cal = calendar.select(F.col("date").alias("_date"), "open_time", "close_time")
        flagged = (
            bars.withColumn("_d", F.to_date("ts"))
            .join(cal, F.col("_d") == F.col("_date"), "left")
            .withColumn("in_session", F.coalesce((tod >= F.col("open_time")) & (tod < F.col("close_time")),
                                                 F.lit(False)))
            .drop("_d", "_date", "open_time", "close_time")
        )
    return flagged if keep_flag else flagged.where("in_session").drop("in_session")


def window_starts(indexed: DataFrame, length: int, stride: int = 1) -> DataFrame:
    """Start positions of full windows: multiples of ``stride`` that leave ``length`` bars."""
    return (
        indexed.where((F.col("bar_idx") <= F.col("n_bars") - length) & (F.col("bar_idx") % stride == 0))
        .select("symbol", F.col("bar_idx").alias("start_idx"),
                (F.col("bar_idx") + length - 1).alias("end_idx"))
    )


def _greatest_common_divisor(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def stride_coverage(indexed: DataFrame, length: int, stride: int) -> DataFrame:
    """Session minutes that window ends can reach at this stride, against all of them."""
    g = _greatest_common_divisor(stride, SESSION_MINUTES)
    is_end = (F.col("bar_idx") >= length - 1) & ((F.col("bar_idx") - (length - 1)) % stride == 0)
    return indexed.groupBy("symbol").agg(
        F.countDistinct("session_minute").alias("minutes_all"),
        F.countDistinct(F.when(is_end, F.col("session_minute"))).alias("minutes_reached"),
    ).select("symbol", "minutes_all", "minutes_reached",
             F.lit(SESSION_MINUTES // g).alias("reachable_of_session"),
             F.lit(stride != 1 and g != 1).alias("warn"))
