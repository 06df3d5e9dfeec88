"""Stored tables: upsert, fan-out, reshaping and schema drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tapeforge.functions.scalars import lenient_number
from tapeforge.schemas import DEFAULT_PATTERN, FEATURE_COLS, STAT_COLS
from tapeforge.session import cut_lineage


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Bring an older or narrower table to ``schema``: missing columns become defaults or null."""
    defaults = defaults or {}

    def column(f: T.StructField) -> Column:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]))
        return c.cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the latest by ``order``.

    max_by over a struct combines on the map side, so many copies of one key
    never meet in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*[c for c in keys], "_row.*").select(*df.columns)


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``existing`` with ``updates`` applied; updates beat stored rows, later updates beat earlier ones."""
    both = (existing.withColumn("_rank", F.lit(0))
            .unionByName(updates.withColumn("_rank", F.lit(1)), allowMissingColumns=True))
    return last_wins(both, keys, ["_rank", *order]).drop("_rank")


def upsert_partitions(updates: DataFrame, path: str, keys: list[str], order: list[str], partition: str) -> None:
    """Upsert into a stored table, reading and rewriting only the partitions that ``updates`` touch.

    ``partition`` must follow from the key (the day of ``ts``), so a key never moves.
    Repeating the call with the same updates leaves the same table; a table that is not there yet is created.
    """
    spark = updates.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        write_table(last_wins(updates, keys, order), path, partition_by=[partition])
        return
    stored = spark.read.parquet(path)
    touched = stored.join(updates.select(partition).distinct(), partition, "left_semi").select(*stored.columns)
    merged = cut_lineage(upsert(touched, updates, keys, order))
    write_table(merged, path, partition_by=[partition])


def split_outputs(scored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, scores and fired signals out of one frame of decided rows."""
    bars = scored.select("symbol", "ts", *FEATURE_COLS).dropDuplicates(["symbol", "ts"])
    scores = scored.select("symbol", "ts", "pattern", "window", "score", "signal", F.col("depth").alias("bars"))
    stored = [F.col(f"stat_{c}").alias(c) if f"stat_{c}" in scored.columns else F.col(c) for c in STAT_COLS]
    signals = scored.where(F.col("signal") == 1).select("symbol", "ts", "pattern", "window", *stored)
    return bars, scores, signals


def unpivot_scores(wide: DataFrame, windows: list[int], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Legacy wide score rows to long scores and signals; the last duplicate of a key wins.

    Blank scores become null and blank signals 0. A window whose columns are
    absent is skipped; statistics the old layout never had become null.
    """
    present = [w for w in windows if {f"score_{w}bar", f"signal_{w}bar", f"bars_{w}"} <= set(wide.columns)]

    def row(w: int) -> Column:
        def stat(k: str) -> Column:
            name = f"{k}_{w}bar"
            return (lenient_number(F.col(name).cast("string")) if name in wide.columns
                    else F.lit(None).cast("double")).alias(k)

        return F.struct(
            F.lit(DEFAULT_PATTERN).alias("pattern"), F.lit(w).alias("window"),
            lenient_number(F.col(f"score_{w}bar").cast("string")).alias("score"),
            F.coalesce(lenient_number(F.col(f"signal_{w}bar").cast("string")).cast("int"), F.lit(0)).alias("signal"),
            F.col(f"bars_{w}").cast("int").alias("bars"), *[stat(k) for k in STAT_COLS])

    long = wide.select("symbol", "ts", *order, F.explode(F.array(*[row(w) for w in present])).alias("_r")).select(
        "symbol", "ts", *order, "_r.*")
    keys = ["symbol", "ts", "pattern", "window"]
    unique = last_wins(long, keys, order)
    return (unique.select(*keys, "score", "signal", "bars"),
            unique.where("signal = 1").select(*keys, *STAT_COLS))


def pivot_scores(scores: DataFrame, windows: list[int], pattern: str = DEFAULT_PATTERN) -> DataFrame:
    """One row per bar time with ``score_<w>bar`` and ``signal_<w>bar`` columns."""
    wide = (scores.where(F.col("pattern") == pattern).groupBy("symbol", "ts").pivot("window", windows)
            .agg(F.first("score").alias("score"), F.first("signal").alias("signal")))
    renamed = [F.col(f"{w}_{f}").alias(f"{f}_{w}bar") for w in windows for f in ("score", "signal")]
    return wide.select("symbol", "ts", *renamed)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Parquet sink. With partitions, overwrite replaces only the partitions that have new rows."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """JSON sink for a one-row study summary."""
    df.write.mode("overwrite").json(path)


def clear_outputs(spark: SparkSession, scores_path: str, signals_path: str) -> None:
    """Empty the score and signal tables but keep their schemas; bars are untouched."""
    for path in (scores_path, signals_path):
        spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
