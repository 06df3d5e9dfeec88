"""Manifests, corpora and score evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeforge.plans import corpus, evaluation, jobs
from tapeforge.operators import sampling
from tapeforge.schemas import FAMILY_THRESHOLDS
from workload.base import (N, SEED, indexed, labelled, labelled_sql, manifest, manifest_sql, query, r, rs,
                           shuffled_sql, stored_windows, table, text_ts, ts, windows_sql)
from workload.tables import negatives_sql

SHUFFLED = f"{manifest_sql()}, {shuffled_sql('man', 'shf', SEED, 'original_idx')}"


def _shuffled(spark, sf):
    return corpus.shuffled(manifest(spark, sf), SEED, ["original_idx"])


@query("""WITH fam AS (SELECT source AS type, count(*) AS n FROM documents GROUP BY source)
SELECT type, unnest(range(0, n)) AS original_idx, CAST(type = 'src7' AS INT) AS label FROM fam""")
def u7_corpus_plan(spark, sf):
    families = table(spark, sf, "documents").groupBy(F.col("source").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return corpus.corpus_plan(families, "src7")


@query(f"WITH {SHUFFLED} SELECT *, CASE WHEN shuffled_idx < floor((SELECT count(*) FROM shf) * CAST(0.1 AS DOUBLE)) THEN 'validation' ELSE 'training' END AS split FROM shf")
def u4_shuffle_and_split(spark, sf):
    return sampling.with_validation_split(_shuffled(spark, sf), 0.1)


SLICE = """CASE WHEN shuffled_idx < floor((SELECT count(*) FROM shf) * CAST(0.72 AS DOUBLE)) THEN 'train'
WHEN shuffled_idx < floor((SELECT count(*) FROM shf) * (CAST(0.72 AS DOUBLE) + CAST(0.08 AS DOUBLE))) THEN 'val' ELSE 'eval' END"""


@query(f"WITH {SHUFFLED} SELECT original_idx, shuffled_idx, {SLICE} AS slice FROM shf")
def o5_corpus_slices(spark, sf):
    return sampling.with_corpus_slice(_shuffled(spark, sf)).select("original_idx", "shuffled_idx", "slice")


@query(f"WITH {manifest_sql()}, ex AS (SELECT CAST(0 AS INT) AS label, 'page' AS type, page_id + 1000000 AS original_idx FROM pages), "
       f"al AS (SELECT * FROM man UNION ALL SELECT * FROM ex), {shuffled_sql('al', 's', SEED + 1, 'type', 'original_idx')} SELECT * FROM s")
def u1_merge_manifests(spark, sf):
    extra = table(spark, sf, "pages").select(F.lit(0).alias("label"), F.lit("page").alias("type"),
                                             (F.col("page_id") + 1000000).alias("original_idx"))
    return corpus.merge_manifests(manifest(spark, sf), extra, SEED + 1, ["type", "original_idx"])


@query(f"""WITH {SHUFFLED}, e AS (SELECT *, shuffled_idx < floor((SELECT count(*) FROM shf) * (CAST(0.72 AS DOUBLE) + CAST(0.08 AS DOUBLE))) AS leak FROM shf WHERE shuffled_idx >= 300)
SELECT count(*) AS n_eval, count(*) FILTER (WHERE leak) AS leaked, round(avg(CASE WHEN leak THEN 1.0 ELSE 0.0 END) + 3e-8, 6) AS leaked_share FROM e""")
def p19_leakage(spark, sf):
    return evaluation.leakage(_shuffled(spark, sf), 300).select("n_eval", "leaked", *r("leaked_share"))


@query(f"""WITH {labelled_sql()}, m AS (SELECT doc_id AS window_id, CAST(lang = 'en' AS INT) AS ml FROM documents)
SELECT count(*) FILTER (WHERE lab.label IS NULL) AS missing_scores, count(*) FILTER (WHERE ml IS NULL) AS missing_manifest,
count(*) FILTER (WHERE ml <> lab.label) AS label_mismatches, count(*) AS n FROM m FULL JOIN lab USING (window_id)""")
def p20_check_labels(spark, sf):
    m = manifest(spark, sf).withColumnRenamed("original_idx", "window_id")
    return evaluation.check_labels(m, labelled(spark, sf))


@query(f"WITH {manifest_sql()} SELECT original_idx, type, CAST(type = 'de' AS INT) AS label FROM man")
def p21_relabel(spark, sf):
    return corpus.relabel(manifest(spark, sf), "de").select("original_idx", "type", "label")


@query(f"WITH {labelled_sql()} SELECT window_id, score, lang AS type, CAST(lang = 'en' AS INT) AS label FROM lab JOIN (SELECT doc_id AS window_id, lang FROM documents) USING (window_id)")
def j8_join_families(spark, sf):
    m = manifest(spark, sf).withColumnRenamed("original_idx", "window_id")
    return evaluation.join_families(m, labelled(spark, sf))


FAMILY = "fam AS (SELECT type, count(*) AS n, avg(score) AS mean, max(label) AS positive, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.95) AS p95 FROM lab GROUP BY type)"


@query(f"WITH {labelled_sql()}, {FAMILY} SELECT type, n, positive, {rs('mean', 'median', 'p95')} FROM fam")
def a21_family_stats(spark, sf):
    return evaluation.family_stats(labelled(spark, sf)).select("type", "n", "positive", *r("mean", "median", "p95"))


# Language families with one positive language, so both halves of the order occur.
LANGS = f"""{labelled_sql()}, lg AS (SELECT window_id, score, lang AS type, CAST(lang = 'en' AS INT) AS label FROM lab JOIN (SELECT doc_id AS window_id, lang FROM documents) USING (window_id)),
fam AS (SELECT type, count(*) AS n, avg(score) AS mean, max(label) AS positive FROM lg GROUP BY type)"""


@query(f"WITH {LANGS} SELECT type, n, CAST(row_number() OVER (ORDER BY positive DESC, CASE WHEN positive = 1 THEN 0 ELSE -mean END, type) AS INT) AS position FROM fam")
def o6_family_order(spark, sf):
    m = manifest(spark, sf).withColumnRenamed("original_idx", "window_id")
    stats = evaluation.family_stats(evaluation.join_families(m, labelled(spark, sf)))
    return evaluation.ordered_families(stats).select("type", "n", "position")


THR = f"thr AS (SELECT CAST(unnest({FAMILY_THRESHOLDS}) AS DOUBLE) AS threshold)"


@query(f"""WITH {labelled_sql()}, {THR} SELECT type, threshold, round(avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) + 3e-8, 6) AS rate,
CASE WHEN max(label) = 1 THEN 'recall' ELSE 'FP-rate' END AS tag FROM lab CROSS JOIN thr GROUP BY ALL""")
def a22_family_rates(spark, sf):
    return evaluation.family_rates(labelled(spark, sf)).select("type", "threshold", *r("rate"), "tag")


@query(f"""WITH {labelled_sql()}, {THR} SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS n_called,
round(avg(label) FILTER (WHERE score >= threshold) + 3e-8, 6) AS precision, round(avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 1) + 3e-8, 6) AS recall
FROM lab CROSS JOIN thr GROUP BY threshold""")
def a23_threshold_report(spark, sf):
    return evaluation.threshold_report(labelled(spark, sf)).select("threshold", "n_called", *r("precision", "recall"))


CONFUSION = """cm AS (SELECT count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp,
count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp FROM lab)"""


@query(f"WITH {labelled_sql()}, {CONFUSION} SELECT * FROM cm")
def a24_confusion(spark, sf):
    return evaluation.confusion(labelled(spark, sf), 0.5)


@query(f"""WITH {labelled_sql()}, {CONFUSION}, c AS (
SELECT '0' AS class, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, 2 * tn / (2 * tn + fn + fp) AS f1, tn + fp AS support FROM cm
UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fn + fp), tp + fn FROM cm), n AS (SELECT tn + fp + fn + tp AS n, (tn + tp) / (tn + fp + fn + tp) AS acc FROM cm)
SELECT class, {rs('precision', 'recall', 'f1')}, support FROM (SELECT * FROM c
UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM n
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), any_value(n) FROM c CROSS JOIN n
UNION ALL SELECT 'weighted avg', sum(precision * support / n), sum(recall * support / n), sum(f1 * support / n), any_value(n) FROM c CROSS JOIN n)""")
def a25_classification_report(spark, sf):
    return evaluation.classification_report(labelled(spark, sf), 0.5).select("class", *r("precision", "recall", "f1"), "support")


CURVE = """pc AS (SELECT score, count(*) FILTER (WHERE label = 1) AS tp, count(*) FILTER (WHERE label <> 1) AS fp FROM lab GROUP BY score),
cv AS (SELECT score, tp, fp, sum(tp) OVER (ORDER BY score DESC) AS ctp, sum(fp) OVER (ORDER BY score DESC) AS cfp FROM pc),
tt AS (SELECT sum(tp) AS p, sum(fp) AS n FROM pc)"""


@query(f"WITH {labelled_sql()}, {CURVE} SELECT score AS threshold, round(CAST(cfp AS DOUBLE) / n + 3e-8, 6) AS fpr, round(CAST(ctp AS DOUBLE) / p + 3e-8, 6) AS tpr FROM cv CROSS JOIN tt UNION ALL SELECT NULL, 0.0, 0.0")
def a26_roc_curve(spark, sf):
    return evaluation.roc_curve(labelled(spark, sf)).select("threshold", *r("fpr", "tpr"))


@query(f"""WITH {labelled_sql()}, {CURVE}, o AS (SELECT CAST(cfp AS DOUBLE) / n AS x, CAST(ctp AS DOUBLE) / p AS y, score FROM cv CROSS JOIN tt),
l AS (SELECT x, y, coalesce(lag(x) OVER (ORDER BY score DESC), 0) AS px, coalesce(lag(y) OVER (ORDER BY score DESC), 0) AS py FROM o)
SELECT round(sum((x - px) * (y + py) / 2) + 3e-8, 6) AS roc_auc FROM l""")
def a26_roc_auc(spark, sf):
    return evaluation.roc_auc(labelled(spark, sf)).select(*r("roc_auc"))


@query(f"""WITH {labelled_sql()}, {CURVE}, o AS (SELECT CAST(cfp AS DOUBLE) / n AS x, CAST(ctp AS DOUBLE) / p AS y, score FROM cv CROSS JOIN tt),
l AS (SELECT x, y, coalesce(lag(x) OVER (ORDER BY score DESC), 0) AS px, coalesce(lag(y) OVER (ORDER BY score DESC), 0) AS py FROM o),
m AS (SELECT doc_id AS window_id, CAST(lang = 'en' AS INT) AS ml FROM documents)
SELECT 'roc_auc' AS measure, round(sum((x - px) * (y + py) / 2) + 3e-8, 6) AS value FROM l UNION ALL SELECT 'points', count(*) + 1.0 FROM cv
UNION ALL SELECT 'label_mismatches', CAST(count(*) AS DOUBLE) FROM m JOIN lab USING (window_id) WHERE ml <> lab.label""")
def k9_evaluation_job(spark, sf):
    """Area, curve and label check out of one evaluation."""
    m = manifest(spark, sf).withColumnRenamed("original_idx", "window_id")
    done = jobs.evaluate(labelled(spark, sf), 0.5, m)
    parts = [done["roc_auc"].select(F.lit("roc_auc").alias("measure"), *r("roc_auc")),
             done["roc_curve"].agg(F.lit("points").alias("measure"), F.count(F.lit(1)).cast("double")),
             done["labels"].select(F.lit("label_mismatches"), F.col("label_mismatches").cast("double"))]
    return parts[0].union(parts[1]).union(parts[2]).toDF("measure", "value")


@query(f"WITH {labelled_sql()}, {CURVE} SELECT score AS threshold, round(CAST(ctp AS DOUBLE) / (ctp + cfp) + 3e-8, 6) AS precision, round(CAST(ctp AS DOUBLE) / p + 3e-8, 6) AS recall FROM cv CROSS JOIN tt")
def a27_pr_curve(spark, sf):
    return evaluation.pr_curve(labelled(spark, sf)).select("threshold", *r("precision", "recall"))


@query(f"""WITH {labelled_sql()}, {CURVE}, o AS (SELECT CAST(ctp AS DOUBLE) / p AS x, CAST(ctp AS DOUBLE) / (ctp + cfp) AS y, score FROM cv CROSS JOIN tt),
l AS (SELECT x, y, coalesce(lag(x) OVER (ORDER BY score DESC), 0) AS px, coalesce(lag(y) OVER (ORDER BY score DESC), 1) AS py FROM o)
SELECT round(sum((x - px) * (y + py) / 2) + 3e-8, 6) AS pr_auc FROM l""")
def a27_pr_auc(spark, sf):
    return evaluation.pr_auc(labelled(spark, sf)).select(*r("pr_auc"))


@query(f"""WITH {labelled_sql()} SELECT label, bin, n, round(n / (sum(n) OVER (PARTITION BY label) * 0.02) + 3e-8, 6) AS density FROM (
SELECT label, CAST(least(floor(score * 50), 49) AS INT) AS bin, count(*) AS n FROM lab GROUP BY ALL)""")
def a28_score_histogram(spark, sf):
    return evaluation.score_histogram(labelled(spark, sf)).select("label", "bin", "n", *r("density"))


@query(f"""WITH {SHUFFLED}, s AS (SELECT {SLICE} AS split, label FROM shf)
SELECT coalesce(split, 'all') AS split, coalesce(CAST(label AS VARCHAR), 'all') AS label, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM s) + 3e-8, 6) AS fraction
FROM s GROUP BY CUBE (split, label)""")
def a30_composition(spark, sf):
    sliced = sampling.with_corpus_slice(_shuffled(spark, sf)).withColumnRenamed("slice", "split")
    return corpus.composition(sliced).select("split", "label", "n", *r("fraction"))


@query(f"WITH {manifest_sql()} SELECT label, count(*) AS n, round((SELECT count(*) FROM man) / (CAST(2.0 AS DOUBLE) * count(*)) + 3e-8, 6) AS weight FROM man GROUP BY label")
def a31_class_weights(spark, sf):
    return corpus.class_weights(manifest(spark, sf)).select("label", "n", *r("weight"))


@query(f"""WITH {windows_sql()}, l AS (SELECT symbol, 'width_ratio' AS param, width_end / width_start AS v FROM win UNION ALL SELECT symbol, 'm_mid', (m_upper + m_lower) / 2 FROM win)
SELECT symbol, param, round(quantile_cont(v, 0.05) + 3e-8, 6) + 0.0 AS p5, round(quantile_cont(v, 0.5) + 3e-8, 6) + 0.0 AS p50, round(quantile_cont(v, 0.95) + 3e-8, 6) + 0.0 AS p95 FROM l GROUP BY ALL""")
def a32_parameter_spread(spark, sf):
    w = stored_windows(spark, sf).select("symbol", (F.col("width_end") / F.col("width_start")).alias("width_ratio"),
                                         ((F.col("m_upper") + F.col("m_lower")) / 2).alias("m_mid"))
    return corpus.parameter_spread(w, ["symbol"], ["width_ratio", "m_mid"]).select("symbol", "param", *r("p5", "p50", "p95"))


@query("""WITH log AS (SELECT event_type, day(ts) AS epoch, round(avg(value), 4) AS val_auc, max(value) AS val_accuracy FROM events GROUP BY ALL)
SELECT event_type, epoch, val_auc, val_accuracy FROM log QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY val_auc DESC, epoch) = 1""")
def a33_best_epoch(spark, sf):
    """A training log stand-in: one 'epoch' per day and event type out of the events table."""
    log = table(spark, sf, "events").groupBy("event_type", F.dayofmonth("ts").cast("long").alias("epoch")).agg(
        F.round(F.avg("value"), 4).alias("val_auc"), F.max("value").alias("val_accuracy"))
    return corpus.best_epoch(log, "val_auc", ["event_type"]).select("event_type", "epoch", "val_auc", "val_accuracy")


@query(f"""WITH {negatives_sql()} SELECT m.symbol, start_idx, end_idx, shuffled_idx, split, {ts('s.ts', 'date_start')}, {ts('e.ts', 'date_end')}
FROM mined m JOIN idx s ON s.symbol = m.symbol AND s.bar_idx = start_idx JOIN idx e ON e.symbol = m.symbol AND e.bar_idx = end_idx""")
def x4_mine_negatives(spark, sf):
    return corpus.mine_negatives(indexed(spark, sf), N, 10, 0.1, SEED).select(
        "symbol", "start_idx", "end_idx", "shuffled_idx", "split", text_ts("date_start").alias("date_start"),
        text_ts("date_end").alias("date_end"))


@query(f"""WITH {LANGS}, {THR} SELECT type, threshold, n, round(mean + 3e-8, 6) AS mean, round(rate + 3e-8, 6) AS rate FROM fam JOIN (
SELECT type, threshold, avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) AS rate FROM lg CROSS JOIN thr GROUP BY ALL) USING (type)""")
def k9_family_analysis(spark, sf):
    m = manifest(spark, sf).withColumnRenamed("original_idx", "window_id")
    scored = evaluation.join_families(m, labelled(spark, sf))
    return evaluation.family_stats(scored).join(evaluation.family_rates(scored), "type").select(
        "type", "threshold", "n", *r("mean", "rate"))
