import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeforge.functions import binning, ranking, scalars
from tapeforge.operators import gates, sampling
from tapeforge.plans import corpus, evaluation, serving, studies
from tapeforge.schemas import FORMATIONS, SCORES
from tapeforge.sources import tables


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=500), np.zeros(300), -rng.exponential(size=200) * 1e6, [1e-300, -1e-300, 7.0]])
    g = np.where(np.arange(len(v)) % 3 == 0, "a", "b")
    probs = {"lo": 0.0, "p5": .05, "q1": .25, "mid": .5, "p95": .95, "hi": 1.0}
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v})).withColumn("w", -F.col("v"))
    got = ranking.quantiles(df, ["g"], ("v", probs), ("w", {"wmid": .5})).toPandas().set_index("g")
    for k in ("a", "b"):
        np.testing.assert_allclose(got.loc[k, list(probs)].astype(float), np.quantile(v[g == k], list(probs.values())), rtol=1e-12)
        assert got.loc[k, "wmid"] == pytest.approx(np.median(-v[g == k]))


def test_quantiles_of_one_and_two_rows(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("b", 2.0), ("b", None)], "g string, v double")
    assert {r.g: r.m for r in ranking.quantiles(df, ["g"], ("v", {"m": .5})).collect()} == {"a": 3.0, "b": 1.5}
    assert ranking.quantiles(df, [], ("v", {"m": .5})).first().m == 2.0


def test_running_totals_in_both_directions(spark):
    v = np.array([-5.0, -0.5, 0.0, 0.5, 3.0, 3.1])
    df = spark.createDataFrame(pd.DataFrame({"v": v, "n": range(1, 7)}))
    up = [r.cum_n for r in ranking.running_totals(df, [], "v", ["n"]).orderBy("v").collect()]
    down = [r.cum_n for r in ranking.running_totals(df, [], "v", ["n"], True).orderBy(F.desc("v")).collect()]
    assert up == list(np.cumsum(range(1, 7))) and down == list(np.cumsum(range(6, 0, -1)))


def test_mean_ranks_share_ties(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 5.0)], "v double")
    assert {r.v: r.k for r in ranking.mean_ranks(df, [], "v", "k").collect()} == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


def test_hash_rank_is_dense_and_repeatable(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, "hot").otherwise("cold"))
    a = ranking.hash_rank(df, 3, ["id"], ["g"]).toPandas()
    b = ranking.hash_rank(df.repartition(7), 3, ["id"], ["g"]).toPandas()
    for g, n in (("hot", 700), ("cold", 300)):
        assert sorted(a[a.g == g].hash_rank) == list(range(n))
    assert dict(zip(a.id, a.hash_rank)) == dict(zip(b.id, b.hash_rank))


def test_histogram_equals_numpy(spark):
    v = np.array([-2.0, -1.0, 0.0, 0.999, 1.0, 2.0, 1.5])
    d = binning.histogram(spark.createDataFrame(pd.DataFrame({"v": v})), [], "v", F.lit(-2.0), F.lit(2.0), 4).toPandas()
    n, _ = np.histogram(v, bins=np.linspace(-2, 2, 5))
    dens, _ = np.histogram(v, bins=np.linspace(-2, 2, 5), density=True)
    got = d.set_index("bin")
    assert [got.n.get(i, 0) for i in range(4)] == list(n)
    np.testing.assert_allclose([got.density.get(i, 0.0) for i in range(4)], dens)


def test_edges_close_on_the_last_bin(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 25.0, 249.0, 250.0, 251.0)], "v double")
    got = [r.b for r in df.select(binning.bin_by_edges(F.col("v"), studies.GAP_EDGES).alias("b")).collect()]
    assert got == [0, 1, 5, 5, None]


def test_t_tail_against_tables(spark):
    # Two-sided 5% and 1% points of Student's t.
    rows = [(2.228138852, 10.0, 0.05), (12.70620474, 1.0, 0.05), (2.626405456, 99.0, 0.01), (0.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "t double, free double, p double")
    for r in df.withColumn("got", studies.t_tail("t", "free")).collect():
        assert r.got == pytest.approx(r.p, abs=1e-6)


def test_threshold_precedence():
    got = {f["pattern"]: f["threshold"] for f in scalars.resolve_thresholds(FORMATIONS, 0.7, {"channel": 0.55})}
    assert got == {"wedge": 0.7, "channel": 0.55, "hs": 0.7, "inverse_hs": 0.7}
    assert {f["threshold"] for f in scalars.resolve_thresholds(FORMATIONS)} == {0.8, 0.9}
    with pytest.raises(ValueError, match="unknown"):
        scalars.resolve_thresholds(FORMATIONS, None, {"flag": 0.5})
    with pytest.raises(ValueError):
        scalars.parse_assignments(["channel"])


def test_gate_modes_differ_for_a_channel_that_fails_its_band(spark):
    row = dict(score=0.95, convergence=0.8, touch_up=9, touch_lo=9, max_excursion=0.5, apex_ok=True)
    df = gates.per_formation(spark.createDataFrame([row]), FORMATIONS)
    doc = {r.pattern: (r.detection, r.signal) for r in gates.decide(df).collect()}
    run = {r.pattern: (r.detection, r.signal) for r in gates.decide(df, "executed").collect()}
    assert doc["channel"] == (0, 0) and run["channel"] == (1, 1)
    assert doc["wedge"] == run["wedge"] == (1, 1)
    assert doc["hs"] == (1, 0)
    with pytest.raises(ValueError):
        gates.decide(df, "other")


def test_categories_are_checked_in_order(spark):
    rows = [(-0.1, 0, 0, 9.0), (0.3, 0, 0, 9.0), (0.6, 5, 4, 9.0), (0.6, 5, 5, 1.99), (0.6, 5, 5, 1.98)]
    df = spark.createDataFrame([(*r, 0.4) for r in rows], "convergence double, touch_up int, touch_lo int, max_excursion double, frac_outside double")
    assert [r.category for r in gates.categorise(df).collect()] == ["DIVERGING", "NEAR-PARALLEL", "UNTOUCHED", "ESCAPES", "CLEAN"]


def test_split_boundary_follows_floating_sums(spark):
    m = spark.range(10).select(F.col("id").alias("shuffled_idx"))
    got = [r.slice for r in sampling.with_corpus_slice(m).orderBy("shuffled_idx").collect()]
    assert got == ["train"] * 7 + ["eval"] * 3


def test_upsert_prefers_the_latest_update(spark):
    cols = "k string, v int, seq int"
    base = spark.createDataFrame([("a", 1, 9), ("b", 1, 9)], cols)
    upd = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], cols)
    once = tables.upsert(base, upd, ["k"], ["seq"])
    assert {r.k: r.v for r in once.collect()} == {"a": 1, "b": 3, "c": 4}
    assert {r.k: r.v for r in tables.upsert(once, upd, ["k"], ["seq"]).collect()} == {"a": 1, "b": 3, "c": 4}


def test_conform_fills_missing_columns(spark):
    df = spark.createDataFrame([("A", 5, None)], "symbol string, bars int, pattern string")
    r = tables.conform(df, SCORES, {"pattern": "wedge"}).first()
    assert (r.pattern, r.bars, r.score) == ("wedge", 5, None)


def test_bars_have_no_window_filter(spark):
    df = spark.createDataFrame([("A",)], "symbol string")
    with pytest.raises(ValueError, match="window"):
        serving.range_filter(df, window=50)


def test_relabel_and_plan_need_their_family(spark):
    m = spark.createDataFrame([("x", 0)], "type string, label int")
    with pytest.raises(ValueError):
        corpus.relabel(m, "y")
    with pytest.raises(ValueError):
        corpus.corpus_plan(m.withColumn("n", F.lit(2)), "y")
    assert corpus.corpus_plan(m.withColumn("n", F.lit(2)), "x").count() == 2


def test_auc_of_a_small_set(spark):
    df = spark.createDataFrame([(1, .9), (0, .8), (1, .8), (0, .1), (1, .4)], "label int, score double")
    # Pairs won: .9 beats both, .8 ties one and beats one, .4 beats one.
    assert evaluation.roc_auc(df).first().roc_auc == pytest.approx((2 + 1.5 + 1) / 6)
    pts = [(0, 1), (1 / 3, 1), (2 / 3, 2 / 3), (1, 3 / 4), (1, 3 / 5)]
    want = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    assert evaluation.pr_auc(df).first().pr_auc == pytest.approx(want)


def test_no_calls_gives_null_precision(spark):
    df = spark.createDataFrame([(1, .1), (0, .2)], "label int, score double")
    r = evaluation.threshold_report(df, [0.9]).first()
    assert (r.n_called, r.precision, r.recall) == (0, None, 0.0)


def test_dud_rate_counts_missing_z_as_not_dud(spark):
    base = spark.createDataFrame([(5, x, x) for x in (1.0, 2.0, 3.0)], "horizon int, abs_ret double, abs_z double")
    ev = spark.createDataFrame([(5, 1.0, None), (5, 1.5, 1.0), (5, 9.0, 9.0)], "horizon int, abs_ret double, abs_z double")
    r = studies.dud_rates(ev, base).first()
    assert r.dud_raw == pytest.approx(200 / 3) and r.dud_z == pytest.approx(100 / 3)


def test_bucket_edges_are_left_closed(spark):
    rows = [(x, 1.0) for x in (0.0, 0.1, 0.3, 0.6, 0.7, 0.29999999, -0.5)]
    df = spark.createDataFrame(rows, "convergence double, ret_1 double")
    got = {r.bucket: r.n for r in studies.convergence_buckets(df, [1], 1).collect()}
    edges = np.arange(0, 1.0, 0.1)
    want = np.histogram([r[0] for r in rows if r[0] >= 0], bins=edges)[0]
    assert got == {i: n for i, n in enumerate(want) if n}


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 4 + [(1,)], "label int")
    assert {r.label: r.weight for r in corpus.class_weights(df).collect()} == {0: 0.625, 1: 2.5}


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("",), (" 0.5 ",), ("n/a",), (None,)], "s string")
    assert [r.v for r in df.select(scalars.lenient_number(F.col("s")).alias("v")).collect()] == [None, 0.5, None, None]
