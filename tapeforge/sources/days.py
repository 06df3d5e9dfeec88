"""Tables kept by day that a stream may write to again and again.

A day's rows lie in ``day=<date>/batch=<number>``: the batch that touched the day last has merged all its rows into one
folder, and the folder with the greatest number holds the day. A folder appears whole, by a rename, so a batch that fails
half-way leaves the older folders in force, and when it is tried again it starts from the same older folders and
writes the same ones anew. Folders that nobody reads any more are removed by a later batch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tapeforge.session import cut_lineage
from tapeforge.sources.tables import last_wins


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str, days: list[str] | None = None) -> dict[str, list[int]]:
    """Batch numbers of each day, in order; only of ``days`` if given. A listing of names, no file is opened."""
    target, fs = _files(spark, path)
    out: dict[str, list[int]] = {}
    if not fs.exists(target):
        return out
    for day in days if days is not None else [None]:
        found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={'*' if day is None else day}/batch=*"))
        for status in found or []:
            p = status.getPath()
            out.setdefault(p.getParent().getName().removeprefix("day="), []).append(int(p.getName().removeprefix("batch=")))
    return {d: sorted(b) for d, b in sorted(out.items())}


def merge_days(rows: DataFrame, path: str, keys: list[str], batch_id: int, ts: str = "ts") -> None:
    """Upsert ``rows`` by ``keys`` into the days of their ``ts``; rows of this batch beat stored ones.

    Only the days that the rows touch are read and written. Of rows of one batch that share a key the greatest remains.
    Doing it again with the same number and rows leaves the same table.
    """
    spark = rows.sparkSession
    columns = rows.columns
    rows = rows.withColumn("day", F.date_format(ts, "yyyy-MM-dd"))
    days = [r.day for r in rows.select("day").distinct().collect()]  # as many as the clock puts into a micro-batch
    if not days:
        return
    known = folders(spark, path, days)
    older = {d: [b for b in known.get(d, []) if b < batch_id] for d in days}
    stored = [f"{path}/day={d}/batch={b[-1]}" for d, b in older.items() if b]
    rows = rows.withColumn("_rank", F.lit(1))
    if stored:
        schema = T.StructType([*rows.drop("day", "_rank").schema.fields])
        held = spark.read.schema(schema).option("basePath", path).parquet(*stored).select(*columns)
        rows = rows.unionByName(held.withColumn("day", F.date_format(ts, "yyyy-MM-dd")).withColumn("_rank", F.lit(0)))
    values = [c for c in columns if c not in keys]
    merged = last_wins(rows, [*keys, "day"], ["_rank", *values]).select(*columns, "day", F.lit(batch_id).alias("batch"))
    merged = cut_lineage(merged)  # one small table, so that a day becomes one file
    (merged.repartition(len(days), "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "batch").parquet(path))
    target, fs = _files(spark, path)
    for d, b in older.items():  # the last folder but one stays for readers that have listed it
        for gone in b[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={d}/batch={gone}"), True)


def read_days(spark: SparkSession, path: str, schema: T.StructType, since: str | None = None, until: str | None = None) -> DataFrame:
    """The table as the last batch of every day left it; ``since`` and ``until`` (days, inclusive) bound what is listed and read."""
    paths = [f"{path}/day={d}/batch={b[-1]}" for d, b in folders(spark, path).items()
             if (since is None or d >= since) and (until is None or d <= until)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*paths).select(*schema.fieldNames())


def _walk(spark: SparkSession, path: str, schema: T.StructType, until: str | None = None) -> Iterator[tuple[list[str], DataFrame]]:
    """Days from the newest down with their rows: one, then two more, then four more, and so on."""
    known = sorted(((d, b[-1]) for d, b in folders(spark, path).items() if until is None or d <= until), reverse=True)
    step = 1
    while known:
        some, known, step = known[:step], known[step:], 2 * step
        paths = [f"{path}/day={d}/batch={b}" for d, b in some]
        yield [d for d, _ in some], spark.read.schema(schema).option("basePath", path).parquet(*paths).select(*schema.fieldNames())


def newest_rows(spark: SparkSession, path: str, schema: T.StructType, limit: int, where: Column | None = None,
                ts: str = "ts", until: str | None = None) -> DataFrame:
    """The newest ``limit`` rows (that fit ``where``) in ascending time, from as few of the newest days as hold them.

    Days are read until they hold enough; at most twice as many as needed, whatever the table's age. Ties in time go by the other columns.
    """
    rows, found = None, 0
    for _, part in _walk(spark, path, schema, until):
        part = part if where is None else part.where(where)
        found += part.limit(limit - found).count()
        rows = part if rows is None else rows.unionByName(part)
        if found >= limit:
            break
    if rows is None:
        return spark.createDataFrame([], schema)
    ties = [c for c in schema.fieldNames() if c != ts]
    return rows.orderBy(F.col(ts).desc(), *ties).limit(limit).orderBy(ts, *ties)


def latest_by(spark: SparkSession, path: str, schema: T.StructType, keys: DataFrame, ts: str = "ts") -> DataFrame:
    """The newest row of each of ``keys`` (distinct key columns); older days are read only for keys not seen in newer ones."""
    names = keys.columns
    rest = [c for c in schema.fieldNames() if c not in names]
    open_, out = cut_lineage(keys.distinct()), None
    for _, part in _walk(spark, path, schema):
        last = part.join(open_, names, "left_semi").groupBy(*names).agg(F.max_by(F.struct(*rest), ts).alias("_r"))
        last = cut_lineage(last.select(*names, "_r.*").select(*schema.fieldNames()))
        out = last if out is None else out.unionByName(last)
        open_ = cut_lineage(open_.join(last.select(*names), names, "left_anti"))
        if open_.isEmpty():
            break
    return spark.createDataFrame([], schema) if out is None else out
