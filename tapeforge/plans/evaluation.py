"""Quality of scores on a labelled window set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tapeforge.functions.binning import histogram
from tapeforge.functions.ranking import quantiles, running_totals
from tapeforge.schemas import FAMILY_THRESHOLDS, TRAIN_FRACTION, VAL_FRACTION


def leakage(manifest: DataFrame, eval_start: int) -> DataFrame:
    """How many rows of an evaluation slice lie before the train+val boundary."""
    n = manifest.agg(F.count(F.lit(1))).scalar()
    boundary = F.floor(n * F.lit(TRAIN_FRACTION + VAL_FRACTION))
    part = manifest.where(F.col("shuffled_idx") >= eval_start)
    return part.agg(F.count(F.lit(1)).alias("n_eval"),
                    F.count_if(F.col("shuffled_idx") < boundary).alias("leaked"),
                    F.avg((F.col("shuffled_idx") < boundary).cast("int")).alias("leaked_share"))


def check_labels(manifest: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows missing on either side and label disagreements between manifest and scored set."""
    m = manifest.select("window_id", F.col("label").alias("_m"))
    s = scores.select("window_id", F.col("label").alias("_s"))
    return m.join(s, "window_id", "full").agg(
        F.count_if(F.col("_s").isNull()).alias("missing_scores"),
        F.count_if(F.col("_m").isNull()).alias("missing_manifest"),
        F.count_if(F.col("_m") != F.col("_s")).alias("label_mismatches"),
        F.count(F.lit(1)).alias("n"))


def join_families(manifest: DataFrame, scores: DataFrame) -> DataFrame:
    """Scored windows with family and label from the manifest."""
    return scores.select("window_id", "score").join(manifest.select("window_id", "type", "label"), "window_id")


def family_stats(scored: DataFrame) -> DataFrame:
    plain = scored.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"),
                                       F.max("label").alias("positive"))
    return plain.join(quantiles(scored, ["type"], ("score", {"median": .5, "p95": .95})), "type")


def ordered_families(stats: DataFrame) -> DataFrame:
    """Positive families by name, then negatives by falling mean score, with their position."""
    order = Window.partitionBy(F.lit(0)).orderBy(  # one row per family
        F.col("positive").desc(), F.when(F.col("positive") == 1, F.lit(0.0)).otherwise(-F.col("mean")), "type")
    return stats.withColumn("position", F.row_number().over(order)).orderBy("position")


def _thresholds(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    return scored.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def family_rates(scored: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Share of each family called positive per threshold, tagged recall or FP-rate."""
    d = _thresholds(scored, thresholds or FAMILY_THRESHOLDS)
    return d.groupBy("type", "threshold").agg(
        F.avg((F.col("score") >= F.col("threshold")).cast("int")).alias("rate"),
        F.when(F.max("label") == 1, "recall").otherwise("FP-rate").alias("tag"))


def threshold_report(scored: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Precision, recall and number called per threshold."""
    d = _thresholds(scored, thresholds or FAMILY_THRESHOLDS)
    called = F.col("score") >= F.col("threshold")
    hit = called & (F.col("label") == 1)
    return d.groupBy("threshold").agg(
        F.count_if(called).alias("n_called"),
        F.when(F.count_if(called) > 0, F.count_if(hit) / F.count_if(called)).alias("precision"),
        F.try_divide(F.count_if(hit), F.count_if(F.col("label") == 1)).alias("recall"))


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    p, y = F.col("score") >= threshold, F.col("label") == 1
    return scored.agg(F.count_if(~p & ~y).alias("tn"), F.count_if(p & ~y).alias("fp"),
                      F.count_if(~p & y).alias("fn"), F.count_if(p & y).alias("tp"))


def classification_report(scored: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted means."""
    m = confusion(scored, threshold)

    def div(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def line(name, tp, called, actual):
        return F.struct(F.lit(name).alias("class"), div(tp, called).alias("precision"),
                        div(tp, actual).alias("recall"), div(2 * tp, called + actual).alias("f1"),
                        actual.alias("support"))

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    m = m.withColumn("_a", line("0", tn, tn + fn, tn + fp)).withColumn("_b", line("1", tp, tp + fp, tp + fn))

    def blend(name, wa, wb):
        return F.struct(F.lit(name).alias("class"),
                        *[(F.col(f"_a.{k}") * wa + F.col(f"_b.{k}") * wb).alias(k)
                          for k in ("precision", "recall", "f1")], n.alias("support"))

    acc = (tn + tp) / n
    rows = [F.col("_a"), F.col("_b"),
            F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"),
                     acc.alias("f1"), n.alias("support")),
            blend("macro avg", F.lit(0.5), F.lit(0.5)),
            blend("weighted avg", (tn + fp) / n, (tp + fn) / n)]
    return m.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def curve_counts(scored: DataFrame) -> DataFrame:
    """Cumulative positives and negatives at every distinct score, highest first."""
    per_score = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("tp"),
                                            F.count_if(F.col("label") != 1).alias("fp"))
    return running_totals(per_score, [], "score", ["tp", "fp"], descending=True)


def roc_curve(scored: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, and the start (null, 0, 0).

    Every curve and area takes ``counts``, the table of ``curve_counts``, where several of them are wanted.
    """
    tot = scored.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))
    pos, neg = tot.select("p").scalar(), tot.select("n").scalar()
    points = (counts or curve_counts(scored)).select(
        F.col("score").alias("threshold"), F.try_divide(F.col("cum_fp"), neg).alias("fpr"),
        F.try_divide(F.col("cum_tp"), pos).alias("tpr"))
    start = tot.select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def roc_auc(scored: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Exact area under the ROC curve.

    The trapezoid of a step at one score needs only that row: its own counts
    and the positives ranked above it, so no lag over the whole curve is taken.
    """
    c = counts or curve_counts(scored)
    step = F.col("fp") * ((F.col("cum_tp") - F.col("tp")) + F.col("tp") / 2)
    return c.agg(F.try_divide(F.sum(step), F.sum("tp") * F.sum("fp").cast("double")).alias("roc_auc"))


def pr_curve(scored: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(threshold, precision, recall) at every distinct score; the end point (0, 1) is implied."""
    pos = scored.agg(F.count_if(F.col("label") == 1)).scalar()
    return (counts or curve_counts(scored)).select(
        F.col("score").alias("threshold"),
        (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"),
        F.try_divide(F.col("cum_tp"), pos).alias("recall"))


def pr_auc(scored: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Trapezoid area under the precision-recall curve, starting at recall 0 / precision 1.

    A row's predecessor is its own cumulative count less its own counts.
    """
    c = counts or curve_counts(scored)
    tp, fp = F.col("cum_tp"), F.col("cum_fp")
    ptp, pfp = tp - F.col("tp"), fp - F.col("fp")
    here = tp / (tp + fp)
    before = F.when(ptp + pfp > 0, ptp / (ptp + pfp)).otherwise(F.lit(1.0))
    return c.agg(F.try_divide(F.sum(F.col("tp") * (here + before) / 2), F.sum("tp")).alias("pr_auc"))


def score_histogram(scored: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(scored, ["label"], "score", F.lit(0.0), F.lit(1.0), bins)
