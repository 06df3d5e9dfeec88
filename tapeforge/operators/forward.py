"""What price did after (and before) a bar.

A zero price has no percent change: such values are null and drop out of every
statistic, as non-finite values do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from tapeforge.operators.windows import chunk_for, moving_std, over_chunks, sliding_extremes, touched_chunks

NO_VOLATILITY = 1e-9


def _pct(later: Column, now: Column) -> Column:
    return F.try_divide(later - now, now) * 100


def forward_returns(indexed: DataFrame, horizons: list[int], chunk: int | None = None) -> DataFrame:
    """Percent return ``ret_<h>`` at each horizon for every bar; null past the end of the series."""

    def steps(df: DataFrame, spec: WindowSpec) -> DataFrame:
        return df.select("*", *[_pct(F.lead("close", h).over(spec), F.col("close")).alias(f"ret_{h}")
                                for h in horizons])

    return over_chunks(indexed, steps, ahead=max(horizons), chunk=chunk)


def forward_lookup(events: DataFrame, indexed: DataFrame, horizons: list[int]) -> DataFrame:
    """Long (event, horizon, ret) for sparse events by equi-join on the target position.

    Both join keys are unique per bar, so no key is hotter than another.
    """
    prices = indexed.select("symbol", "bar_idx", "close")
    entry = prices.select("symbol", F.col("bar_idx").alias("end_idx"), F.col("close").alias("entry_price"))
    probe = (
        events.join(entry, ["symbol", "end_idx"])
        .withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
        .withColumn("_target", F.col("end_idx") + F.col("horizon"))
    )
    later = prices.select("symbol", F.col("bar_idx").alias("_target"), F.col("close").alias("_later"))
    return (
        probe.join(later, ["symbol", "_target"], "left")
        .withColumn("ret", _pct(F.col("_later"), F.col("entry_price")))
        .drop("_target", "_later")
    )


def _outcomes(at: Column, worst: Column, best: Column, now: Column, h: int, digits: int | None) -> list[Column]:
    """Return, adverse (up) and favourable (down) excursion and bearish win; null where the horizon runs past the series."""
    shape = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return [shape(_pct(at, now)).alias(f"ret_{h}"),
            F.when(at.isNotNull(), shape(_pct(worst, now))).alias(f"mae_{h}"),
            F.when(at.isNotNull(), shape(F.try_divide(now - best, now) * 100)).alias(f"mfe_{h}"),
            (at < now).alias(f"win_{h}")]


def excursions(indexed: DataFrame, horizons: list[int], chunk: int | None = None,
               digits: int | None = 3) -> DataFrame:
    """Return, adverse (up) and favourable (down) excursion and bearish win per horizon, for every bar.

    Columns are null when the horizon runs past the series. Running extremes give those of the shortest horizon at a flat cost;
    a longer one is covered by windows of the shortest, each a look ahead.
    """
    least = min(horizons)
    ends = {h: sorted({*range(h, least, -least), least}) for h in horizons}

    def steps(df: DataFrame, spec: WindowSpec) -> DataFrame:
        d = sliding_extremes(df, {"_top": (F.col("high"), F.max), "_bottom": (F.col("low"), F.min)}, least)
        looks = {f"_{n}_{k}": F.lead(f"_{n}", k).over(spec) for k in sorted({k for e in ends.values() for k in e}) for n in ("top", "bottom")}
        looks |= {f"_at_{h}": F.lead("close", h).over(spec) for h in horizons}
        d = d.select("*", *[c.alias(n) for n, c in looks.items()])
        cols = []
        for h in horizons:
            top, bottom = ([F.col(f"_{n}_{k}") for k in ends[h]] for n in ("top", "bottom"))
            cols += _outcomes(F.col(f"_at_{h}"), F.greatest(*top) if len(top) > 1 else top[0],
                              F.least(*bottom) if len(bottom) > 1 else bottom[0], F.col("close"), h, digits)
        return d.select(*df.columns, *cols)

    return over_chunks(indexed, steps, back=least, ahead=max(horizons), chunk=chunk)


PYRAMID, LEVELS = 8, 5  # each level's block holds eight of the level below; the top one 32768 bars


def pyramid(indexed: DataFrame, chunk: int = PYRAMID ** 4) -> DataFrame:
    """(symbol, level, block, top, bottom): highest high and lowest low of blocks of 1, 8, 64 .. bars, a seventh more rows than bars.

    The bars are shuffled once, by (symbol, chunk); blocks of a chunk or less are complete there.
    """
    levels = F.explode(F.expr(f"transform(sequence(0, {LEVELS - 1}), l -> struct(l AS level, shiftright(bar_idx, 3 * l) AS block))"))
    bars = indexed.select("symbol", "bar_idx", "high", "low", F.expr(f"bar_idx div {chunk}").alias("chunk")).repartition("symbol", "chunk")
    return (bars.select("symbol", "chunk", "high", "low", levels.alias("l")).groupBy("symbol", "chunk", "l.level", "l.block")
            .agg(F.max("high").alias("top"), F.min("low").alias("bottom")).drop("chunk"))


def _blocks(first: str, last: str) -> Column:
    """The blocks (level, block) that make up the positions [first, last]: at most fourteen of a level below the top."""
    empty = "CAST(array() AS array<struct<level:int,block:bigint>>)"

    def pieces(level: str, a: str, b: str) -> str:
        return f"if({a} > {b}, {empty}, transform(sequence({a}, greatest({a}, {b})), x -> struct({level} AS level, x AS block)))"

    up, down = f"(s.a + {PYRAMID - 1}) div {PYRAMID} * {PYRAMID}", f"(s.b + 1) div {PYRAMID} * {PYRAMID}"
    left = pieces("l", "s.a", f"least(s.b, {up} - 1)")
    right = f"if({up} > s.b, {empty}, {pieces('l', down, 's.b')})"
    inner = f"{up} <= {down} - 1"
    step = (f"(s, l) -> named_struct('a', if({inner}, {up} div {PYRAMID}, 1L), 'b', if({inner}, {down} div {PYRAMID} - 1, 0L), "
            f"'out', concat(s.out, {left}, {right}))")
    start = f"named_struct('a', CAST({first} AS BIGINT), 'b', CAST({last} AS BIGINT), 'out', {empty})"
    top = pieces(str(LEVELS - 1), "s.a", "s.b")
    return F.expr(f"aggregate(sequence(0, {LEVELS - 2}), {start}, {step}, s -> concat(s.out, {top}))")


def range_extremes(spans: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``top`` and ``bottom`` over the bars [first, last] of each span (keys, symbol, first, last), from a ``pyramid``.

    A span asks for a number of blocks that grows with the logarithm of its length, by equi-join.
    """
    asked = spans.select(*keys, "symbol", F.explode(_blocks("first", "last")).alias("_b")).select(*keys, "symbol", "_b.*")
    return asked.join(blocks, ["symbol", "level", "block"]).groupBy(*keys).agg(F.max("top").alias("top"), F.min("bottom").alias("bottom"))


def outcomes_at(events: DataFrame, indexed: DataFrame, horizons: list[int], digits: int | None = 3,
                chunk: int = PYRAMID ** 4) -> DataFrame:
    """(symbol, end_idx, entry_price, ret_h, mae_h, mfe_h, win_h) as ``excursions`` has them, for the bars of sparse events alone.

    Only the chunks of bars in which some event's horizon lies are read on: their pyramid is built, and every event asks
    it for its blocks. No frame runs over the bars.
    """
    ends = events.select("symbol", "end_idx").distinct()
    reach = ends.withColumn("_to", F.col("end_idx") + max(horizons))
    near = indexed.select("symbol", "bar_idx", "high", "low", "close").withColumn("chunk", F.expr(f"bar_idx div {chunk}"))
    near = near.join(touched_chunks(reach, chunk, "end_idx", "_to"), ["symbol", "chunk"], "left_semi")
    price = near.select("symbol", "bar_idx", "close")
    asked = ends.withColumn("horizon", F.explode(F.array(F.lit(0), *[F.lit(h) for h in horizons])))
    closes = asked.withColumn("bar_idx", F.col("end_idx") + F.col("horizon")).join(price, ["symbol", "bar_idx"])
    spans = asked.where("horizon > 0").select("symbol", "end_idx", "horizon", (F.col("end_idx") + 1).alias("first"),
                                              (F.col("end_idx") + F.col("horizon")).alias("last"))
    reached = range_extremes(spans.withColumnRenamed("symbol", "of").withColumn("symbol", F.col("of")), pyramid(near, chunk),
                             ["of", "end_idx", "horizon"])
    both = closes.join(reached.withColumnRenamed("of", "symbol"), ["symbol", "end_idx", "horizon"], "left")

    def pick(c: str, h: int) -> Column:
        return F.max(F.when(F.col("horizon") == h, F.col(c)))

    wide = both.groupBy("symbol", "end_idx").agg(
        pick("close", 0).alias("entry_price"),
        *[pick(c, h).alias(f"_{c}_{h}") for h in horizons for c in ("close", "top", "bottom")])
    return wide.select("symbol", "end_idx", "entry_price", *[c for h in horizons for c in _outcomes(
        F.col(f"_close_{h}"), F.col(f"_top_{h}"), F.col(f"_bottom_{h}"), F.col("entry_price"), h, digits)])


def long_outcomes(wide: DataFrame, keys: list[str], horizons: list[int], fields: list[str]) -> DataFrame:
    """Unpivot ``<field>_<h>`` columns to rows (keys, horizon, fields)."""
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), *[F.col(f"{f}_{h}").alias(f) for f in fields])
                     for h in horizons])
    return wide.select(*keys, F.explode(rows).alias("_o")).select(*keys, "_o.*")


def trailing_volatility(indexed: DataFrame, lookback: int, chunk: int | None = None) -> DataFrame:
    """``sigma``: population deviation of 1-bar percent returns over up to ``lookback`` bars (first return 0)."""

    def steps(df: DataFrame, spec: WindowSpec) -> DataFrame:
        step = _pct(F.col("close"), F.lag("close").over(spec))
        df = df.withColumn("_r", F.when(F.col("bar_idx") == 0, F.lit(0.0)).otherwise(step))
        return moving_std(df, "_r", "sigma", lookback, spec).drop("_r")

    return over_chunks(indexed, steps, back=lookback, chunk=chunk)


def volatility_at(events: DataFrame, indexed: DataFrame, lookback: int, chunk: int | None = None) -> DataFrame:
    """(symbol, end_idx, sigma): ``trailing_volatility`` at the bars of sparse events; only chunks that a look-back touches are read."""
    chunk = chunk or chunk_for(lookback)
    ends = events.select("symbol", "end_idx").distinct()
    reach = ends.withColumn("_from", F.greatest(F.col("end_idx") - lookback - 1, F.lit(0).cast("long")))
    near = indexed.select("symbol", "bar_idx", "close", F.expr(f"bar_idx div {chunk}").alias("chunk"))
    near = near.join(touched_chunks(reach, chunk, "_from", "end_idx"), ["symbol", "chunk"], "left_semi").drop("chunk")
    sigma = trailing_volatility(near, lookback, chunk).select("symbol", F.col("bar_idx").alias("end_idx"), "sigma")
    return ends.join(sigma, ["symbol", "end_idx"])


def strict_volatility(indexed: DataFrame, lookback: int, chunk: int | None = None) -> DataFrame:
    """``sigma_strict``: sample deviation of fractional returns, null until ``lookback`` returns exist."""

    def steps(df: DataFrame, spec: WindowSpec) -> DataFrame:
        df = df.withColumn("_r", F.try_divide(F.col("close"), F.lag("close").over(spec)) - 1)
        return moving_std(df, "_r", "sigma_strict", lookback, spec, sample=True, need_full=True).drop("_r")

    return over_chunks(indexed, steps, back=lookback + 1, chunk=chunk)


def volatility_trend_steps(length: int, fit_bars: int | None):
    """Frame step adding ``vol_trend`` at window ends: late over early deviation of the fitted span."""
    fit = length if not fit_bars else min(fit_bars, length)
    third = max(fit // 3, 2)

    def steps(df: DataFrame, spec: WindowSpec) -> DataFrame:
        move = F.col("close") - F.lag("close").over(spec)
        df = df.withColumn("_d", F.when(F.col("bar_idx") == 0, F.lit(0.0)).otherwise(move))
        df = moving_std(df, "_d", "_late", third, spec)
        df = moving_std(df, "_d", "_early", third, spec, end=fit - third)
        trend = F.when(F.col("_early") > 1e-12, F.col("_late") / F.col("_early"))
        return df.withColumn("vol_trend", F.when(F.col("bar_idx") >= length - 1, trend)).drop("_d", "_late", "_early")

    return steps


def volatility_trend(indexed: DataFrame, length: int, fit_bars: int | None, chunk: int | None = None) -> DataFrame:
    return over_chunks(indexed, volatility_trend_steps(length, fit_bars), back=length + 1, chunk=chunk)


def normalised_returns(indexed: DataFrame, horizons: list[int], lookback: int,
                       chunk: int | None = None) -> DataFrame:
    """``z_<h>``: return over sigma times sqrt(h); null without volatility or data."""
    both = forward_returns(trailing_volatility(indexed, lookback, chunk), horizons, chunk)
    return both.select("*", *[
        F.when(F.col("sigma") > NO_VOLATILITY, F.col(f"ret_{h}") / (F.col("sigma") * (h ** 0.5))).alias(f"z_{h}")
        for h in horizons])


def gap_columns(windows: DataFrame) -> DataFrame:
    """Day boundaries inside a window from the day numbers at its two ends.

    ``n_gaps`` counts them; ``gap_pos`` is the offset of the first one, -1 for none.
    """
    n = F.col("day_no") - F.col("day_no_start")
    pos = F.when(n > 0, F.col("next_day_idx_start") - F.col("start_idx")).otherwise(F.lit(-1))
    return windows.withColumn("n_gaps", n.cast("int")).withColumn("gap_pos", pos.cast("int"))
