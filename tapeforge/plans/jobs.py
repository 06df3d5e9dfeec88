"""The whole studies a user runs, put together from the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeforge.operators.forward import (NO_VOLATILITY, forward_lookup, forward_returns, strict_volatility,
                                         trailing_volatility, volatility_at)
from tapeforge.operators.gates import categorise, decide, direction_split, per_formation, signal_stats
from tapeforge.operators.geometry import envelope_windows, with_geometry
from tapeforge.operators.indexing import session_gate, with_bar_index
from tapeforge.operators.sampling import random_baseline, random_per_category, random_windows, strided_baseline
from tapeforge.operators.spikes import LIMIT, spike_filter
from tapeforge.functions.scalars import slope_class
from tapeforge.plans import detect, evaluation, studies
from tapeforge.schemas import FEATURE_COLS
from tapeforge.session import cut_lineage
from tapeforge.sources.tables import split_outputs


def backtest_study(indexed: DataFrame, length: int, threshold: float, horizons: list[int],
                   fit_bars: int | None = None, stride: int = 5, scorer: Column | None = None,
                   chunk: int | None = None) -> dict[str, DataFrame]:
    """Outcome of every detection and its summary per horizon."""
    hits = detect.detections(detect.scan(indexed, length, fit_bars, stride, scorer, chunk=chunk), threshold)
    slim = hits.select("symbol", "start_idx", "end_idx", "score", "date_start", "date_end")
    results = cut_lineage(detect.backtest(indexed, slim, horizons, chunk=chunk))
    return {"results": results, "summary": detect.backtest_summary(results, horizons)}


def detection_study(indexed: DataFrame, length: int, threshold: float, fit_bars: int | None, stride: int = 1,
                    seed: int = 0, bin_minutes: int = 30, gap_edges: list[float] | None = None,
                    scorer: Column | None = None, chunk: int | None = None,
                    population_size: int | None = None) -> dict[str, DataFrame]:
    """Where and when a detector fires and whether that follows clock, gaps or volatility.

    The scan is the expensive part and feeds every report, so its rows are
    written once. All windows are the background, or ``population_size`` random ones per symbol.
    """
    windows = cut_lineage(detect.scan(indexed, length, fit_bars, stride, scorer, chunk=chunk))
    events = cut_lineage(detect.find_events(windows, length, threshold, chunk))
    population = windows if population_size is None else cut_lineage(random_windows(windows, population_size, seed))
    years = studies.series_years(indexed)
    rates = studies.rate_by_minute(windows, threshold, bin_minutes)
    return {
        "events": events,
        "rate_by_minute": rates,
        "rate_concentration": studies.rate_concentration(rates),
        "geometry": studies.geometry_report(events, population, years),
        "gap_enrichment": studies.gap_enrichment(events, population),
        "gap_position": studies.gap_position_summary(events, population, length, fit_bars),
        "gap_histogram": studies.gap_position_histogram(events, population, gap_edges or studies.GAP_EDGES),
        "volatility_bands": studies.volatility_bands(windows, threshold),
        "volatility": studies.volatility_summary(windows, events, threshold),
        "summary": studies.run_summary(windows, events, population, years, threshold),
    }


def locate_events(events: DataFrame, indexed: DataFrame, length: int) -> DataFrame:
    """Positions of stored events from their start times; events off the bars are dropped."""
    at = indexed.select("symbol", F.col("ts").alias("date_start"), F.col("bar_idx").alias("start_idx"))
    return (events.drop("start_idx", "end_idx").join(at, ["symbol", "date_start"])
            .withColumn("end_idx", F.col("start_idx") + length - 1))


def filtered_events(events: DataFrame, indexed: DataFrame, length: int, fit_bars: int | None,
                    chunk: int | None = None, **limits: float) -> DataFrame:
    """Stored events measured against the bars again and put into quality categories."""
    placed = locate_events(events.select("symbol", "date_start", "date_end", "score"), indexed, length)
    fit = length if not fit_bars else min(fit_bars, length)
    measured = with_geometry(envelope_windows(indexed, length, fit_bars, at=placed, chunk=chunk), fit)
    return categorise(placed.join(measured, ["symbol", "start_idx", "end_idx"]), **limits)


def _with_z(long: DataFrame) -> DataFrame:
    z = F.try_divide("ret", F.col("sigma") * F.sqrt(F.col("horizon").cast("double")))
    return long.withColumn("z", F.when(F.col("sigma") > NO_VOLATILITY, z))


def grouped_outcomes(groups: DataFrame, indexed: DataFrame, horizons: list[int], lookback: int) -> DataFrame:
    """Long (group, horizon, ret, z) of sparse (symbol, end_idx, group) rows; volatility is computed near them only."""
    long = forward_lookup(groups, indexed, horizons)
    return _with_z(long.join(volatility_at(groups, indexed, lookback), ["symbol", "end_idx"]))


def every_outcome(indexed: DataFrame, length: int, horizons: list[int], lookback: int, group: str) -> DataFrame:
    """``grouped_outcomes`` of every eligible bar, dense: looks ahead and volatility inside chunks, no join by position."""
    d = forward_returns(trailing_volatility(indexed, lookback), horizons)
    d = d.where((F.col("bar_idx") >= length) & (F.col("bar_idx") < F.col("n_bars") - max(horizons) - 1))
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{h}").alias("ret")) for h in horizons])
    return _with_z(d.select("symbol", F.col("bar_idx").alias("end_idx"), F.lit(group).alias("group"), F.col("close").alias("entry_price"),
                            "sigma", F.explode(rows).alias("_o")).select("*", "_o.*").drop("_o"))


def filter_study(events: DataFrame, indexed: DataFrame, length: int, fit_bars: int | None, horizons: list[int],
                 lookback: int, seed: int = 0, chunk: int | None = None, worst: int = 12, review: int = 8,
                 baseline_size: Column | int | None = None) -> dict[str, DataFrame]:
    """Which events survive the quality filter and what followed, against every eligible bar or random ones."""
    indexed = cut_lineage(indexed)  # every part below reads a few of its columns
    ev = cut_lineage(filtered_events(events, indexed, length, fit_bars, chunk))
    tagged = ev.select("symbol", "end_idx", F.col("category").alias("group"))
    split = direction_split(ev).select("symbol", "end_idx", F.concat(F.lit("CLEAN "), "direction").alias("group"))
    if baseline_size is None:
        base = every_outcome(indexed, length, horizons, lookback, "RANDOM")
    else:
        sample = cut_lineage(random_baseline(indexed, length, max(horizons), seed, baseline_size))
        base = grouped_outcomes(sample.withColumn("group", F.lit("RANDOM")), indexed, horizons, lookback)
    found = grouped_outcomes(cut_lineage(tagged.unionByName(split)), indexed, horizons, lookback)
    out = cut_lineage(found.unionByName(base.select(*found.columns)))
    focus = horizons[len(horizons) // 2]
    # The returns of the events are in the long table already.
    moved = out.where("group = 'CLEAN'").groupBy("symbol", "end_idx").agg(
        *[F.max(F.when(F.col("horizon") == h, F.col("ret"))).alias(f"ret_{h}") for h in horizons])
    clean = ev.where("category = 'CLEAN'").join(moved, ["symbol", "end_idx"])
    survived = out.where("group = 'CLEAN'").join(clean.select("symbol", "end_idx", "convergence"), ["symbol", "end_idx"])
    both = out.where("group in ('CLEAN', 'RANDOM')")
    return {
        "events": ev,
        "categories": studies.category_shares(ev),
        "excursions": studies.excursion_quantiles(ev),
        "returns": studies.return_summary(out, ["group", "horizon"]),
        "z": studies.z_summary(out, ["group", "horizon"]),
        "buckets": studies.convergence_buckets(clean, horizons, focus),
        "correlations": studies.correlations(survived, ["convergence"], ["horizon"]),
        "review": random_per_category(ev, review, seed),
        "worst": studies.worst_returns(clean, f"ret_{focus}", worst),
        "hist_z": studies.clipped_histograms(both, ["group", "horizon"], "z", 4.0, 60),
        "hist_ret": studies.clipped_histograms(both, ["group", "horizon"], "ret", 3.0, 60),
    }


def slope_study(indexed: DataFrame, length: int, threshold: float, horizons: list[int], stride: int = 10,
                min_events: int = 10, chunk: int | None = None) -> DataFrame:
    """Correlation of whole-window geometry with what followed; ``enough`` tells whether ``min_events`` outcomes back it."""
    windows = cut_lineage(detect.scan(indexed, length, None, stride, chunk=chunk))
    events = detect.find_events(windows, length, threshold, chunk)
    long = forward_lookup(events, indexed, horizons)
    found = studies.correlations(long, ["travel_upper", "travel_lower", "convergence", "score"], ["horizon"])
    return found.withColumn("enough", F.col("n") >= min_events)


def slope_returns(events: DataFrame, indexed: DataFrame, horizons: list[int], length: int, seed: int = 0,
                  flat: float = 0.15, category: str | None = "CLEAN",
                  baseline_size: Column | int | None = None) -> dict[str, DataFrame]:
    """Forward returns of rising, falling and flat events against every eligible bar or random ones."""
    if category is not None:
        events = events.where(F.col("category") == category)
    classed = events.select("symbol", "end_idx", slope_class(F.col("mid_travel"), flat).alias("group"))
    base = random_baseline(indexed, length, max(horizons), seed, baseline_size).withColumn("group", F.lit("random"))
    long = cut_lineage(forward_lookup(classed.unionByName(base), indexed, horizons))
    return {"returns": long, "summary": studies.return_summary(long, ["group", "horizon"]),
            "histograms": studies.self_scaled_histograms(long, "random", 54)}


def abs_outcomes(wide: DataFrame, horizons: list[int], keep: list[str] | None = None) -> DataFrame:
    """Long (symbol, bar_idx, keep, horizon, abs_ret, abs_z) of bars with returns and ``sigma_strict``, where there is a forward price."""
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.abs(f"ret_{h}").alias("abs_ret"),
                              F.try_divide(F.abs(f"ret_{h}"), F.col("sigma_strict") * (h ** 0.5) * 100).alias("abs_z"))
                     for h in horizons])
    keys = ["symbol", "bar_idx", *(keep or [])]
    return wide.select(*keys, F.explode(rows).alias("_o")).select(*keys, "_o.*").where("abs_ret is not null")


def volatility_control(events: DataFrame, indexed: DataFrame, horizons: list[int], vol_window: int = 390,
                       stride: int = 10) -> dict[str, DataFrame]:
    """Dud rates and slope quintiles after dividing moves by what volatility implies.

    The frames run over the bars once; what is wanted of them is picked before it is unpivoted.
    """
    events = cut_lineage(events.select("symbol", "end_idx", "mid_travel"))
    wide = forward_returns(strict_volatility(indexed, vol_window), horizons)
    wide = cut_lineage(wide.select("symbol", "bar_idx", "sigma_strict", *[f"ret_{h}" for h in horizons]))
    base = cut_lineage(abs_outcomes(strided_baseline(wide, vol_window, stride), horizons))
    at = wide.join(events.select("symbol", F.col("end_idx").alias("bar_idx"), "mid_travel"), ["symbol", "bar_idx"])
    hits = cut_lineage(abs_outcomes(at, horizons, ["mid_travel"]))
    return {"duds": studies.dud_rates(hits, base), "quintiles": studies.quintile_means(hits, events),
            "correlation": hits.where("abs_z is not null").groupBy("horizon").agg(
                F.corr("mid_travel", "abs_z").alias("r_travel_z"))}


def nondud_projection(events: DataFrame, indexed: DataFrame, horizon: int, warmup: int = 390,
                      stride: int = 10) -> dict[str, DataFrame]:
    """Lines through the moves of events that did move, against their slopes."""
    ret = f"ret_{horizon}"
    indexed = cut_lineage(indexed)
    d = forward_returns(indexed, [horizon])
    base = studies.baseline_median(d, ret, warmup, stride)
    joined = events.join(d.select("symbol", F.col("bar_idx").alias("end_idx"), ret), ["symbol", "end_idx"])
    moved = joined.where(F.col(ret).isNotNull()).withColumn("abs_move", F.abs(ret))
    nondud = cut_lineage(moved.where(F.col("abs_move") >= base.scalar()))
    features = ["travel_upper", "travel_lower", "mid_travel"]
    fits = studies.linear_fits(nondud, features, "abs_move")
    return {"baseline": base, "fits": fits,
            "ranks": studies.rank_correlations(nondud, features, "abs_move")}


def replay(bars: DataFrame, formations: list[dict], limit: float = LIMIT, gate_mode: str = "documented",
           scorer: Column | None = None, chunk: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, signals) of stored bars as the monitor would have written them.

    Session gate, then spike filter, then every formation on windows of its own size. Bars on which a
    window is not full yet have a score row without a score. Each (size, fit) is scanned once for all
    formations that share it.
    """
    gated = with_bar_index(session_gate(bars))
    kept = spike_filter(gated, limit, chunk=chunk).where("accepted") if chunk else spike_filter(gated, limit).where("accepted")
    ix = cut_lineage(with_bar_index(kept.select("symbol", "ts", *FEATURE_COLS)))
    spans: dict[tuple[int, int | None], list[dict]] = {}
    for f in formations:
        spans.setdefault((f["window"], f.get("fit_bars")), []).append(f)
    scores = signals = None
    for (length, fit), own in spans.items():
        full = detect.scan(ix, length, fit, scorer=scorer, chunk=chunk)
        full = full.withColumn("ts", F.col("date_end")).withColumn("depth", F.lit(length))
        decided = signal_stats(decide(per_formation(full, own), gate_mode))
        _, some, fired = split_outputs(decided.join(ix.select("symbol", "ts", *[c for c in FEATURE_COLS if c not in decided.columns]),
                                                    ["symbol", "ts"]))
        filling = per_formation(ix.where(F.col("bar_idx") < length - 1), own).select(
            "symbol", "ts", "pattern", "window", F.lit(None).cast("double").alias("score"), F.lit(0).alias("signal"),
            (F.col("bar_idx") + 1).cast("int").alias("bars"))
        some = some.unionByName(filling)
        scores = some if scores is None else scores.unionByName(some)
        signals = fired if signals is None else signals.unionByName(fired)
    return scores, signals


def store_replay(scores: DataFrame, signals: DataFrame, scores_path: str, signals_path: str) -> None:
    """Clear both tables and write the replay's rows by day; the bars table is untouched."""
    for df, path in ((scores, scores_path), (signals, signals_path)):
        df.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(path)


def evaluate(scored: DataFrame, threshold: float, manifest: DataFrame | None = None,
             eval_start: int | None = None) -> dict[str, DataFrame]:
    """Every quality measure of a labelled, scored window set (window_id, type, label, score).

    ``manifest`` (window_id, label, shuffled_idx) adds the label check, and with ``eval_start`` the leakage check.
    """
    scored = cut_lineage(scored)
    stats = evaluation.family_stats(scored)
    counts = evaluation.curve_counts(scored)  # one table behind both curves and both areas
    checks = {}
    if manifest is not None:
        checks["labels"] = evaluation.check_labels(manifest, scored)
        if eval_start is not None:
            checks["leakage"] = evaluation.leakage(manifest, eval_start)
    return checks | {
        "report": evaluation.classification_report(scored, threshold),
        "confusion": evaluation.confusion(scored, threshold),
        "roc_curve": evaluation.roc_curve(scored, counts), "pr_curve": evaluation.pr_curve(scored, counts),
        "roc_auc": evaluation.roc_auc(scored, counts), "pr_auc": evaluation.pr_auc(scored, counts),
        "histogram": evaluation.score_histogram(scored),
        "families": evaluation.ordered_families(stats),
        "rates": evaluation.family_rates(scored), "thresholds": evaluation.threshold_report(scored),
    }
