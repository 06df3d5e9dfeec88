"""Continuous scoring: the batch operators driven bar by bar.

Per symbol the stream keeps the spike filter's memory and the last N accepted
session bars. Everything after that (fit, score, gates, fan-out) is the same
code the batch jobs use, applied to the window rows a micro-batch emits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tapeforge.operators import geometry
from tapeforge.operators.detection import shape_score
from tapeforge.operators.gates import decide, per_formation, signal_stats
from tapeforge.operators.spikes import LIMIT, MEMORY, step
from tapeforge.schemas import FEATURE_COLS, PRICE_COLS
from tapeforge.sources.tables import last_wins, split_outputs

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RING_COLS = ["high", "low", "close"]

WINDOW_ROWS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()),
    *[T.StructField(c, T.DoubleType()) for c in FEATURE_COLS],
    T.StructField("in_session", T.BooleanType()), T.StructField("late", T.BooleanType()),
    T.StructField("depth", T.IntegerType()),
    *[T.StructField(f"{c}_window", T.ArrayType(T.DoubleType())) for c in RING_COLS],
])

_MEMORY = T.StructType([
    T.StructField("last_ts", T.TimestampType()), T.StructField("closes", T.ArrayType(T.DoubleType())),
    T.StructField("rejects", T.IntegerType()),
    *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in RING_COLS],
])


def bar_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """File stream of bars with bounded micro-batches.

    A symbol's rows of one micro-batch are sorted in one task, so the bound also
    limits that task. Files must arrive in time order, as a live feed writes
    them; unordered history is replayed with the batch operators, which chunk it.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of a (symbol, ts) that arrive within the watermark delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])


class BarMemory(StatefulProcessor):
    """Duplicate check, spike filter and rolling window of one symbol."""

    def __init__(self, length: int, limit: float = LIMIT, order: str = "live"):
        self.length, self.limit, self.order = length, limit, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", _MEMORY)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.memory.update((pd.Timestamp(row["last_ts"]).to_pydatetime(), list(row["closes"]), 0,
                            *[list(row[f"{c}_window"]) for c in RING_COLS]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.memory.exists():
            last, closes, rejects, *ring = self.memory.get()
            last, closes, ring = pd.Timestamp(last), list(closes), [list(r) for r in ring]
        else:
            last, closes, rejects, ring = None, [], 0, [[] for _ in RING_COLS]
        # A micro-batch gives no order; state does.
        pdf = pd.concat(list(rows)).sort_values("ts", kind="stable")
        out = []
        for bar in pdf.itertuples(index=False):
            base = (key[0], bar.ts, *[getattr(bar, c) for c in FEATURE_COLS], bar.in_session)
            if last is not None and bar.ts == last:
                continue
            if last is not None and bar.ts < last:
                out.append((*base, True, None, None, None, None))
                continue
            last = bar.ts
            if self.order == "replay" and not bar.in_session:
                out.append((*base, False, None, None, None, None))
                continue
            ok, (closes, rejects) = step((closes, rejects), tuple(getattr(bar, c) for c in PRICE_COLS), self.limit)
            if not ok:
                continue
            if not bar.in_session:
                out.append((*base, False, None, None, None, None))
                continue
            ring = [(r + [getattr(bar, c)])[-self.length:] for r, c in zip(ring, RING_COLS)]
            depth = len(ring[0])
            full = ring if depth == self.length else [None] * len(RING_COLS)
            out.append((*base, False, depth, *full))
        self.memory.update((last.to_pydatetime(), closes, rejects, *ring))
        yield pd.DataFrame(out, columns=WINDOW_ROWS.fieldNames())

    def close(self) -> None:
        pass


def warm_start(history: DataFrame, length: int) -> DataFrame:
    """State rows from stored bars (with ``in_session``): the time of the last bar of any kind, and the closes and
    windows of session bars, which is what the spike filter compares with.

    Only the newest rows of a symbol matter, so a row_number limit trims each
    task's share before anything is shuffled.
    """
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc())

    def tail(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n)

    def in_order(c: str, name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct("ts", F.col(c).alias("v"))))
        return F.transform(rows, lambda x: x["v"]).alias(name)

    last = history.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    rings = tail(history.where("in_session"), max(length, MEMORY)).groupBy("symbol").agg(
        *[in_order(c, f"{c}_window") for c in RING_COLS])
    empty = F.array().cast("array<double>")

    def newest_of(c: str, n: int) -> Column:
        held = F.coalesce(f"{c}_window", empty)
        return F.slice(held, F.greatest(F.size(held) - n + 1, F.lit(1)), F.lit(n))

    return last.join(rings, "symbol", "left").select(
        "symbol", "last_ts", newest_of("close", MEMORY).alias("closes"),
        *[newest_of(c, length).alias(f"{c}_window") for c in RING_COLS])


def window_rows(stream: DataFrame, length: int, limit: float = LIMIT, order: str = "live",
                history: DataFrame | None = None) -> DataFrame:
    """Accepted bars with their rolling windows. ``stream`` carries ``in_session``."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    initial = None if history is None else warm_start(history, length).groupBy("symbol")
    return stream.select("symbol", "ts", *FEATURE_COLS, "in_session").groupBy("symbol").transformWithStateInPandas(
        BarMemory(length, limit, order), outputStructType=WINDOW_ROWS, outputMode="append", timeMode="none",
        initialState=initial)


_MEASURES = [*geometry.FIT_COLS, *geometry.CONTAIN_COLS, *geometry.TOUCH_COLS]


def _measure_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fit the envelope of full windows, grouped by fit length so the fit stays vectorised."""
    for pdf in batches:
        out = pd.DataFrame(np.nan, index=pdf.index, columns=_MEASURES)
        full = pdf["high_window"].notna()
        for fit, part in pdf[full].groupby("fit"):
            high = np.stack(part["high_window"].to_numpy())[:, -int(fit):].astype(np.float64)
            low = np.stack(part["low_window"].to_numpy())[:, -int(fit):].astype(np.float64)
            out.loc[part.index] = pd.DataFrame(geometry.measure_windows(high, low), index=part.index)[_MEASURES]
        both = pd.concat([pdf.drop(columns=["high_window", "low_window", "close_window"]), out], axis=1)
        yield both


def score_rows(rows: DataFrame, formations: list[dict], scorer: Column | None = None,
               gate_mode: str = "documented") -> DataFrame:
    """Score, measure and decide every window row for every formation of that window size.

    Scores are null while a window fills. Works on a stream and on a batch.
    """
    d = per_formation(rows.where("not late and depth is not null"), formations)
    d = d.withColumn("fit", F.least(F.coalesce("fit_bars", "window"), F.col("window")))
    schema = T.StructType([f for f in d.schema.fields if not f.name.endswith("_window")]
                          + [T.StructField(c, T.DoubleType()) for c in _MEASURES])
    d = d.mapInPandas(_measure_rows, schema)
    d = d.select(*[c for c in d.columns if c not in _MEASURES],
                 *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in _MEASURES])
    d = geometry.with_apex(geometry.with_geometry(d, F.col("fit")), F.col("fit"))
    d = d.withColumn("score", F.when(F.col("depth") >= F.col("window"), shape_score() if scorer is None else scorer))
    return signal_stats(decide(d, gate_mode))


def store_batch(bars_path: str, scores_path: str, signals_path: str, formations: list[dict],
                scorer: Column | None = None, gate_mode: str = "documented") -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of one micro-batch into three tables.

    Each batch owns the partition ``batch=<id>`` and overwrites it, so a retried
    batch leaves the same rows. Late and extended-hours bars reach only the bars table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            bars = batch.select("symbol", "ts", *FEATURE_COLS)
            _, scores, signals = split_outputs(score_rows(batch, formations, scorer, gate_mode))
            for df, path in ((bars, bars_path), (scores, scores_path), (signals, signals_path)):
                df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything that is there, then stop (replay, catch-up)."""
    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Table written by ``store_batch`` with the last write of each key winning."""
    return last_wins(spark.read.option("basePath", path).parquet(f"{path}/batch=*"), keys, ["batch"]).drop("batch")
