"""Turning scores and geometry into categories, gates and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tapeforge.functions.scalars import projected_move

_FORMATION_TYPE = T.StructType([
    T.StructField("pattern", T.StringType()), T.StructField("window", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()), T.StructField("apex_gate", T.BooleanType()),
    T.StructField("quality_gate", T.BooleanType()), T.StructField("geometry", T.BooleanType()),
    T.StructField("log_only", T.BooleanType()), T.StructField("fit_bars", T.IntegerType()),
    T.StructField("min_conv", T.DoubleType()), T.StructField("max_conv", T.DoubleType()),
    T.StructField("min_touches", T.IntegerType()), T.StructField("max_exc", T.DoubleType()),
])


def formation_literals(formations: list[dict]) -> Column:
    """The formation settings as an array-of-struct literal."""
    rows = [F.struct(*[F.lit(f.get(n)).cast(t).alias(n)
                       for n, t in ((x.name, x.dataType) for x in _FORMATION_TYPE.fields)]) for f in formations]
    return F.array(*rows)


def per_formation(df: DataFrame, formations: list[dict]) -> DataFrame:
    """Repeat every row once per formation with its settings; no join, no shuffle."""
    return df.withColumn("_f", F.explode(formation_literals(formations))).select("*", "_f.*").drop("_f")


def categorise(events: DataFrame, min_conv: float = 0.5, min_touches: int = 5, max_exc: float = 1.98,
               max_outside: float = 1.01) -> DataFrame:
    """First matching defect decides; what has none is CLEAN. The default limits are fixed values."""
    conv = F.col("convergence")
    return events.withColumn(
        "category",
        F.when(conv < 0, "DIVERGING")
        .when(conv < min_conv, "NEAR-PARALLEL")
        .when((F.col("touch_up") < min_touches) | (F.col("touch_lo") < min_touches), "UNTOUCHED")
        .when((F.col("max_excursion") > max_exc) | (F.col("frac_outside") > max_outside), "ESCAPES")
        .otherwise("CLEAN"))


def direction_split(events: DataFrame) -> DataFrame:
    """CLEAN events labelled by the sign of their mid slope; exact zero belongs to neither."""
    return (
        events.where(F.col("category") == "CLEAN")
        .withColumn("direction", F.when(F.col("mid_travel") < 0, "down-sloping")
                    .when(F.col("mid_travel") > 0, "up-sloping"))
        .where("direction is not null")
    )


def quality_ok() -> Column:
    """Formation band on convergence, touches and excursion; a null limit does not bind."""
    conv = F.col("convergence")

    def within(limit: str, ok: Column) -> Column:
        return F.col(limit).isNull() | ok

    band = (
        within("min_touches", (F.col("touch_up") >= F.col("min_touches")) & (F.col("touch_lo") >= F.col("min_touches")))
        & within("min_conv", conv >= F.col("min_conv"))
        & within("max_conv", conv <= F.col("max_conv"))
        & within("max_exc", F.col("max_excursion") <= F.col("max_exc"))
    )
    return F.when(F.col("quality_gate"), band).otherwise(F.lit(True))


def decide(df: DataFrame, gate_mode: str = "documented") -> DataFrame:
    """``detection`` and ``signal`` of scored rows that carry formation settings.

    'documented' applies the quality band to every formation that has one.
    'executed' applies any gate only to formations with an apex gate, which is
    how the published live loop behaves when run.
    """
    if gate_mode not in ("documented", "executed"):
        raise ValueError(f"gate_mode must be 'documented' or 'executed', got {gate_mode!r}")
    apex = ~F.col("apex_gate") | F.col("apex_ok")
    both = apex & F.col("quality_ok")
    gate = both if gate_mode == "documented" else F.when(F.col("apex_gate"), both).otherwise(F.lit(True))
    over = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    hit = over & (~F.col("geometry") | F.coalesce(gate, F.lit(False)))
    return (
        df.withColumn("quality_ok", quality_ok())
        .withColumn("detection", hit.cast("int"))
        .withColumn("signal", F.when(F.col("log_only"), F.lit(0)).otherwise(hit.cast("int")))
    )


def signal_stats(df: DataFrame) -> DataFrame:
    """The stored statistics, rounded; zeros where the score is below threshold or no geometry applies."""
    live = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)) & F.col("geometry")

    def stat(c: Column, digits: int, gated: bool = False) -> Column:
        return F.when(live, F.round(c.cast("double"), digits) + F.lit(0.0)).otherwise(
            F.lit(None) if gated else F.lit(0.0))

    measured = F.col("quality_gate")
    return df.select(
        "*",
        F.when(live, projected_move(F.col("pattern"), F.col("close"), F.col("mid_travel")))
        .otherwise(F.lit(0.0)).alias("proj_move_usd"),
        stat(F.col("b_upper"), 6).alias("slope_upper"),
        stat(F.col("b_lower"), 6).alias("slope_lower"),
        stat(F.col("apex_min"), 0).alias("stat_apex_min"),
        stat(F.col("apex_price"), 4).alias("stat_apex_price"),
        stat(F.col("mid_travel"), 4).alias("stat_mid_travel"),
        stat(F.col("convergence"), 4, True).alias("stat_convergence"),
        F.when(measured, stat(F.col("touch_up"), 0, True)).alias("stat_touch_up"),
        F.when(measured, stat(F.col("touch_lo"), 0, True)).alias("stat_touch_lo"),
        F.when(measured, stat(F.col("max_excursion"), 4, True)).alias("stat_max_excursion"),
    )
