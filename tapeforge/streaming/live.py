"""Live scoring of several window sizes from one state per symbol.

A symbol's state is a ring: a map whose slot ``count % longest`` holds the bar of that number, shared by every window size.
An accepted bar costs one put, whatever the sizes. What a micro-batch adds leaves the state as one block per symbol:
the bars that its windows reach back to and the new ones, as arrays. Windows of all sizes are views on the
block, so they are measured and scored a batch at a time, and no window is ever written or sent by itself.

Bars may arrive out of order: with a ``delay`` they are held back until the event clock has passed them by that much
and are then released in order. What comes later still reaches the bars table and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeforge.operators import geometry
from tapeforge.operators.detection import shape_score
from tapeforge.operators.gates import decide, per_formation, signal_stats
from tapeforge.operators.spikes import LIMIT, MEMORY, step
from tapeforge.operators.windows import scaled_windows
from tapeforge.schemas import FEATURE_COLS, KEY_BARS, KEY_SCORES, PRICE_COLS
from tapeforge.sources.days import merge_days
from tapeforge.sources.tables import split_outputs
from tapeforge.streaming.monitor import STATE_PROVIDER

Scorer = Callable[[np.ndarray], np.ndarray]
Loader = Callable[[], Scorer]

_BAR = [T.StructField("ts", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in FEATURE_COLS]]
_RING_BAR = T.StructType(_BAR)
_HELD_BAR = T.StructType([*_BAR, T.StructField("in_session", T.BooleanType())])
_SLOT = T.StructType([T.StructField("slot", T.LongType())])
_HEAD = T.StructType([
    T.StructField("last_ts", T.TimestampType()), T.StructField("closes", T.ArrayType(T.DoubleType())),
    T.StructField("rejects", T.IntegerType()), T.StructField("count", T.LongType()),
])

# kind: 'bar' (accepted), 'late' (store only), 'block' (the arrays; `seen` session bars came before the fresh ones).
ROWS = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("symbol", T.StringType()), *_BAR,
    T.StructField("in_session", T.BooleanType()), T.StructField("seen", T.LongType()), T.StructField("fresh", T.IntegerType()),
    T.StructField("block_ts", T.ArrayType(T.TimestampType())),
    *[T.StructField(f"block_{c}", T.ArrayType(T.DoubleType())) for c in FEATURE_COLS],
])


def _stored(kind: str, symbol: str, bar, in_session: bool) -> tuple:
    return (kind, symbol, pd.Timestamp(bar.ts), *[float(getattr(bar, c)) for c in FEATURE_COLS], bool(in_session),
            *[None] * (len(ROWS) - len(_HELD_BAR) - 2))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=ROWS.fieldNames(), dtype=object).astype({"ts": "datetime64[ns]"})


def _ms(ts: pd.Timestamp) -> int:
    return int(ts.value // 1_000_000)


class BarRings(StatefulProcessor):
    """Order, duplicates, spike filter and ring of one symbol.

    ``delay`` and ``watermark`` (seconds): bars wait until the newest bar of any symbol is ``delay`` ahead of them. The
    stream's watermark may trail further, which only sets how late a bar may be and still be stored. Of bars of one time that
    are held the last to come counts; one that comes after its time was released is a repeat and is dropped.
    ``idle`` (seconds) forgets a symbol that had no bar for so long.
    """

    def __init__(self, longest: int, limit: float = LIMIT, delay: int | None = None, watermark: int = 0,
                 idle: int | None = None):
        self.longest, self.limit, self.idle = longest, limit, idle
        self.delay, self.watermark = delay, watermark

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.ring = handle.getMapState("ring", _SLOT, _RING_BAR)
        if self.delay is not None:
            self.held = handle.getMapState("held", _SLOT, _HELD_BAR)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        bars = list(zip(row["ring_ts"], *[row[f"ring_{c}"] for c in FEATURE_COLS]))[-self.longest:]
        count = int(row["count"])
        for k, bar in enumerate(bars, count - len(bars)):
            self.ring.updateValue((k % self.longest,), (pd.Timestamp(bar[0]).to_pydatetime(), *map(float, bar[1:])))
        self.head.update((pd.Timestamp(row["last_ts"]).to_pydatetime(), list(map(float, row["closes"])), int(row["rejects"]), count))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("ts", kind="stable")
        if self.delay is None:
            yield from self._take(key, pdf)
            return
        last = pd.Timestamp(self.head.get()[0]) if self.head.exists() else None
        late = pdf[pdf["ts"] < last] if last is not None else pdf.iloc[:0]
        waiting = pdf[pdf["ts"] > last] if last is not None else pdf
        for bar in waiting.itertuples(index=False):
            self.held.updateValue((bar.ts.value,), (bar.ts.to_pydatetime(), *[getattr(bar, c) for c in FEATURE_COLS], bar.in_session))
        if len(waiting):
            self._wake(waiting["ts"].min())
        yield self._late(key, late)
        yield from self._release(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues)
        now = timerValues.getCurrentWatermarkInMs() + 1000 * self.watermark
        if self.idle is not None and self.head.exists() and not self.held.exists() and (
                now >= _ms(pd.Timestamp(self.head.get()[0])) + 1000 * self.idle):
            self.head.clear()
            self.ring.clear()

    def _wake(self, ts: pd.Timestamp, after: int | None = None) -> None:
        """A timer for the moment at which the newest bar is so far ahead of ``ts``."""
        self.handle.registerTimer(max(1, _ms(ts) + 1000 * ((self.delay if after is None else after) - self.watermark)))

    def _release(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """The held bars that the event clock has passed, in order."""
        horizon = timerValues.getCurrentWatermarkInMs() + 1000 * (self.watermark - self.delay)
        held = sorted((k[0], bar) for k, bar in self.held.iterator())
        due = [(k, bar) for k, bar in held if k // 1_000_000 <= horizon]
        if not due:
            return
        for k, _ in due:
            self.held.removeKey((k,))
        if len(due) < len(held):
            self._wake(pd.Timestamp(held[len(due)][0]))
        yield from self._take(key, pd.DataFrame([bar for _, bar in due], columns=_HELD_BAR.fieldNames()))
        if self.idle is not None and self.head.exists():
            self._wake(pd.Timestamp(self.head.get()[0]), self.idle)

    def _late(self, key, pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame([_stored("late", key[0], bar, bar.in_session) for bar in pdf.itertuples(index=False)])

    def _take(self, key, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Judge bars in order and put the accepted session bars into the ring."""
        last, closes, rejects, count = None, [], 0, 0
        if self.head.exists():
            last, closes, rejects, count = self.head.get()
            last, closes = pd.Timestamp(last), list(closes)
        fresh, out = [], []
        for bar in pdf.itertuples(index=False):
            ts = pd.Timestamp(bar.ts)
            if last is not None and ts <= last:
                if ts < last:
                    out.append(_stored("late", key[0], bar, bar.in_session))
                continue
            last = ts
            ok, (closes, rejects) = step((closes, rejects), tuple(float(getattr(bar, c)) for c in PRICE_COLS), self.limit)
            if ok:
                out.append(_stored("bar", key[0], bar, bar.in_session))
                if bar.in_session:
                    fresh.append((ts.to_pydatetime(), *[float(getattr(bar, c)) for c in FEATURE_COLS]))
        if fresh:
            reach = min(count, self.longest - 1)  # one pass over the ring a micro-batch, not a bar
            slots = {k[0]: v for k, v in self.ring.iterator()} if reach else {}
            block = [*[tuple(slots[k % self.longest]) for k in range(count - reach, count)], *fresh]
            kept = fresh[-self.longest:]
            for k, bar in enumerate(kept, count + len(fresh) - len(kept)):
                self.ring.updateValue((k % self.longest,), bar)
            out.append(("block", key[0], *[None] * len(_HELD_BAR), count, len(fresh), *map(list, zip(*block))))
        if last is not None:
            self.head.update((last.to_pydatetime(), closes, rejects, count + len(fresh)))
        yield _frame(out)

    def close(self) -> None:
        pass


def ring_start(history: DataFrame, longest: int) -> DataFrame:
    """State rows from stored bars (with ``in_session``): the newest ``longest`` session bars of each symbol.

    A row_number limit trims each task's share before anything is gathered.
    """
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    last = history.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    tail = history.where("in_session").withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= max(longest, MEMORY))
    rings = tail.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", *FEATURE_COLS))).alias("bars"))
    bars = F.coalesce("bars", F.array().cast(T.ArrayType(_RING_BAR)))
    ring = F.slice(bars, F.greatest(F.size(bars) - longest + 1, F.lit(1)), F.lit(longest))
    closes = F.slice(bars, F.greatest(F.size(bars) - MEMORY + 1, F.lit(1)), F.lit(MEMORY))
    d = last.join(rings, "symbol", "left").select("symbol", "last_ts", ring.alias("ring"), closes.alias("near"))
    return _state_rows(d.withColumn("closes", F.col("near.close")).withColumn("rejects", F.lit(0))
                       .withColumn("count", F.size("ring").cast("long")))


def _state_rows(d: DataFrame) -> DataFrame:
    return d.select("symbol", "last_ts", "closes", "rejects", "count", F.col("ring.ts").alias("ring_ts"),
                    *[F.col(f"ring.{c}").alias(f"ring_{c}") for c in FEATURE_COLS])


def checkpoint_start(spark: SparkSession, checkpoint: str) -> DataFrame:
    """State rows out of the checkpoint of a stopped query, for a query with other sizes or formations.

    Sizes up to the old ring's length go on as if they had always been there; a longer one fills up from the ring's length.
    """
    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    head = state("head").select(F.col("key.symbol").alias("symbol"), "value.*")
    ring = state("ring").select(F.col("key.symbol").alias("symbol"), F.col("user_map_value").alias("bar"))
    rings = ring.groupBy("symbol").agg(F.array_sort(F.collect_list("bar")).alias("ring"))  # a symbol's ring is bounded
    empty = F.array().cast(T.ArrayType(_RING_BAR))
    return _state_rows(head.join(rings, "symbol", "left").withColumn("ring", F.coalesce("ring", empty)))


def live_rows(stream: DataFrame, sizes: list[int], limit: float = LIMIT, start: DataFrame | None = None,
              delay: int | None = None, forget: int = 7 * 86400, idle: int | None = None) -> DataFrame:
    """Bars and blocks (ROWS) of a bar stream that carries ``in_session``; ``sizes`` are the window sizes in use.

    ``start`` are state rows (``ring_start``, ``checkpoint_start``). Without ``delay`` a micro-batch's bars are sorted and taken
    as they come. With it (seconds) bars are held back and released by event-time timers; bars up to ``forget`` seconds late
    still come out as 'late' and older ones are dropped by the watermark; ``idle`` seconds without a bar end a symbol's state.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    initial = None if start is None else start.groupBy("symbol")
    rows = stream.select("symbol", "ts", *FEATURE_COLS, "in_session")
    if delay is not None:
        forget = max(forget, delay)
        rows = rows.withWatermark("ts", f"{forget} seconds")
    return rows.groupBy("symbol").transformWithStateInPandas(
        BarRings(max(sizes), limit, delay, forget, idle), outputStructType=ROWS, outputMode="append",
        timeMode="none" if delay is None else "eventTime", initialState=initial)


# --- scoring ----------------------------------------------------------------------------

_MEASURES = [*geometry.FIT_COLS, *geometry.CONTAIN_COLS, *geometry.TOUCH_COLS]
WINDOWS = T.StructType([
    T.StructField("symbol", T.StringType()), *_BAR, T.StructField("size", T.IntegerType()), T.StructField("fit", T.IntegerType()),
    T.StructField("depth", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in _MEASURES],
    *[T.StructField(c, T.DoubleType()) for c in ("top", "bottom")],
    T.StructField("model_scores", T.MapType(T.StringType(), T.DoubleType())),
])


def block_windows(rows: DataFrame, spans: list[tuple[int, int]], models: dict[tuple[str, int], Loader] | None = None,
                  batch: int = 4096) -> DataFrame:
    """One row per fresh bar and (size, fit): depth, measures of the last ``fit`` bars, and the scores of batch models.

    A model is a function (b, size, 5) -> (b,) on windows scaled to [0, 1] per window. ``models`` names by (pattern, size) a
    loader that a task calls once. Blocks arrive as Arrow lists; windows are views on their contiguous values, at most
    ``batch`` of them copied at a time. Until a window is full its measures and scores are null.
    """
    models = models or {}
    schema = to_arrow_schema(WINDOWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[tuple[str, int], Scorer] = {}

        def own_models(size: int) -> list[tuple[str, Scorer]]:
            for key in models:
                if key[1] == size and key not in loaded:
                    loaded[key] = models[key]()
            return [(p, loaded[p, w]) for p, w in models if w == size]

        for b in batches:
            lists = {c: b.column(b.schema.get_field_index(f"block_{c}")) for c in ("ts", *FEATURE_COLS)}
            ends = lists["ts"].offsets.to_numpy()
            values = {c: lists[c].values.to_numpy(zero_copy_only=False) for c in FEATURE_COLS}
            stamps = lists["ts"].values
            heads = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("symbol", "seen", "fresh"))
            for i, (symbol, seen, fresh) in enumerate(zip(*heads)):
                lo, hi = int(ends[i]), int(ends[i + 1])
                bars = np.stack([values[c][lo:hi] for c in FEATURE_COLS], axis=1).astype(np.float64)
                first = hi - lo - fresh
                for size, fit in spans:
                    for at in range(first, hi - lo, batch):
                        to = min(at + batch, hi - lo)
                        yield _block_rows(symbol, stamps.slice(lo + at, to - at), bars, at, to, seen - first, size, fit,
                                          own_models(size), schema)

    blocks = rows.where("kind = 'block'").select("symbol", "seen", "fresh", "block_ts", *[f"block_{c}" for c in FEATURE_COLS])
    return blocks.mapInArrow(run, WINDOWS)


def _block_rows(symbol: str, stamps: pa.Array, bars: np.ndarray, at: int, to: int, offset: int, size: int, fit: int,
                models: list[tuple[str, Scorer]], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of the bars [at, to) of a block; bar k of the block is the symbol's session bar ``offset + k``."""
    n = to - at
    depth = np.minimum(offset + np.arange(at, to) + 1, size)
    measures = {c: np.full(n, np.nan) for c in [*_MEASURES, "top", "bottom"]}
    scores: list[dict | None] = [None] * n
    full = np.flatnonzero(depth == size)
    full = full[at + full >= size - 1]
    if len(full):
        begin = at + full - size + 1
        whole = sliding_window_view(bars, size, axis=0)[begin]  # (b, 5, size)
        high, low = whole[:, 1, size - fit:], whole[:, 2, size - fit:]
        for c, v in geometry.measure_windows(np.ascontiguousarray(high), np.ascontiguousarray(low)).items():
            measures[c][full] = v
        measures["top"][full], measures["bottom"][full] = whole[:, 1].max(axis=1), whole[:, 2].min(axis=1)
        if models:
            scaled = scaled_windows(whole.transpose(0, 2, 1))
            found = {p: np.asarray(score(scaled), np.float64).reshape(-1) for p, score in models}
            for j, k in enumerate(full.tolist()):
                scores[k] = {p: float(s[j]) for p, s in found.items()}
    columns = [pa.array([symbol] * n, pa.string()), stamps, *[pa.array(bars[at:to, i]) for i in range(5)],
               pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, fit, np.int32)), pa.array(depth.astype(np.int32)),
               *[pa.array(v, from_pandas=True) for v in measures.values()],
               pa.array([None if s is None else list(s.items()) for s in scores], schema.field("model_scores").type)]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def spans_of(formations: list[dict]) -> list[tuple[int, int]]:
    """Distinct (size, fit) of the formations; each is measured once for all formations that share it."""
    return sorted({(f["window"], min(f.get("fit_bars") or f["window"], f["window"])) for f in formations})


def score_live(rows: DataFrame, formations: list[dict], models: dict[tuple[str, int], Loader] | None = None,
               scorer: Column | None = None, gate_mode: str = "documented") -> DataFrame:
    """Every fresh bar scored, measured and decided for every formation on windows of its own size.

    The score of a formation is its batch model's, else that of the column ``scorer``. Works on a stream's batch and on stored rows.
    """
    d = per_formation(block_windows(rows, spans_of(formations), models), formations)
    d = d.where((F.col("window") == F.col("size")) & (F.least(F.coalesce("fit_bars", "window"), F.col("window")) == F.col("fit")))
    d = geometry.with_apex(geometry.with_geometry(d, F.col("fit")), F.col("fit"))
    by_column = F.when(F.col("depth") >= F.col("size"), shape_score() if scorer is None else scorer)
    model = F.element_at("model_scores", F.col("pattern"))
    named = F.array(*[F.lit(f"{p}:{w}") for p, w in (models or {})]) if models else F.array().cast("array<string>")
    has_model = F.array_contains(named, F.concat_ws(":", "pattern", F.col("size").cast("string")))
    d = d.withColumn("score", F.when(has_model, model).otherwise(by_column))
    return signal_stats(decide(d, gate_mode))


def store_live(bars_path: str, scores_path: str, signals_path: str, formations: list[dict],
               models: dict[tuple[str, int], Loader] | None = None, scorer: Column | None = None,
               gate_mode: str = "documented") -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of a micro-batch of ``live_rows`` into three tables kept by day (``sources.days``).

    A batch is merged into the days that it touches under its own number, so a batch that is tried again leaves the same tables.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            bars = batch.where("kind <> 'block'").select("symbol", "ts", *FEATURE_COLS)
            merge_days(bars, bars_path, KEY_BARS, batch_id)
            decided = score_live(batch, formations, models, scorer, gate_mode).persist()
            _, scores, signals = split_outputs(decided)
            merge_days(scores, scores_path, KEY_SCORES, batch_id)
            merge_days(signals, signals_path, KEY_SCORES, batch_id)
            decided.unpersist()
        finally:
            batch.unpersist()

    return write
