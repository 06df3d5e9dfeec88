"""Fitting a window classifier with Spark ML, in place of a convolutional network."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tapeforge.plans.corpus import class_weights

FEATURES = ["convergence", "mid_travel", "width_start", "max_excursion", "mean_excursion", "frac_outside",
            "spike_share", "touch_up", "touch_lo", "vol_trend"]


RIDGE = 1e-3


def _training_rows(labelled: DataFrame, cols: list[str]) -> DataFrame:
    """Labels, class weights and features; the two weights are looked up in a map, so nothing is joined."""
    table = class_weights(labelled).agg(F.map_from_entries(F.collect_list(F.struct("label", "weight")))).scalar()
    return labelled.select(
        F.col("label").cast("double").alias("label"), F.try_element_at(table, F.col("label")).alias("weight"), *[F.col(c).cast("double").alias(c) for c in cols])


def fit_window_classifier(labelled: DataFrame, features: list[str] | None = None, max_iter: int = 100) -> PipelineModel:
    """Class-weighted logistic regression on window measures; rows with a missing feature are skipped."""
    cols = features or FEATURES
    stages = [VectorAssembler(inputCols=cols, outputCol="_raw", handleInvalid="skip"),
              StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
              LogisticRegression(featuresCol="_scaled", labelCol="label", weightCol="weight", maxIter=max_iter,
                                 regParam=RIDGE, tol=1e-9)]
    return Pipeline(stages=stages).fit(_training_rows(labelled, cols))


def score_with_model(windows: DataFrame, model: PipelineModel) -> DataFrame:
    """Replace ``score`` by the model's probability; a window with a missing feature keeps its row with a null score."""
    cols = model.stages[0].getInputCols()
    missing = reduce(or_, (F.col(c).isNull() | F.isnan(c) for c in cols))
    ready = windows.select("symbol", "start_idx", "end_idx", *[F.col(c).cast("double").alias(c) for c in cols])
    ready = ready.withColumn("_missing", missing)
    ready = ready.select("symbol", "start_idx", "end_idx", "_missing",
                         *[F.when(F.col("_missing"), 0.0).otherwise(F.col(c)).alias(c) for c in cols])
    return model.transform(ready).select(
        "symbol", "start_idx", "end_idx", F.when(~F.col("_missing"), vector_to_array("probability")[1]).alias("score"))


def fit_gradient(labelled: DataFrame, model: PipelineModel) -> DataFrame:
    """(feature, gradient) of the penalised weighted log-likelihood at the fitted coefficients; zero at the optimum.

    The last row, without a feature name, is the intercept's.
    """
    cols = model.stages[0].getInputCols()
    out = model.transform(_training_rows(labelled, cols))
    error = (vector_to_array("probability")[1] - F.col("label")) * F.col("weight")
    x = vector_to_array("_scaled")
    sums = [F.sum(error * x[i]) for i in range(len(cols))] + [F.sum(error)]
    mean = out.agg(*[F.try_divide(s, F.sum("weight")).alias(f"g{i}") for i, s in enumerate(sums)])
    beta = [float(b) for b in model.stages[-1].coefficients] + [0.0]
    rows = [F.struct(F.lit(n).alias("feature"), (F.col(f"g{i}") + RIDGE * beta[i]).alias("gradient"))
            for i, n in enumerate([*cols, None])]
    return mean.select(F.explode(F.array(*rows)).alias("_g")).select("_g.*")
