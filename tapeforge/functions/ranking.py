"""Exact order statistics without sorting a whole group in one task.

Values are put into order-preserving buckets. Bucket totals give every bucket
its offset; only rows inside one bucket are sorted together. The bucket tables
are small by construction (their size depends on the bucket scheme, not on the
rows), so a hot group is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeforge.session import cut_lineage

PER_OCTAVE = 8192
PARTS = 65536             # second-level buckets within one bucket
BUCKET_ROWS = 1_000_000   # rows of a hash bucket that are numbered in one task


def value_bucket(col: Column | str) -> Column:
    """Monotone integer bucket of a double: ``PER_OCTAVE`` per power of two, sign kept.

    A bucket spans 0.01% of its magnitude, so continuous data does not pile up in
    one, and equal values are collapsed before any sort. However many rows there
    are, a group has at most about 27k buckets per power of ten it covers.
    """
    c = F.col(col) if isinstance(col, str) else col
    scaled = F.floor(F.log2(F.abs(c)) * PER_OCTAVE).cast("long") + F.lit(1100 * PER_OCTAVE)
    return F.when(c == 0, F.lit(0)).when(c > 0, scaled).otherwise(-scaled)


def _running(counts: DataFrame, keys: list[str], bucket: str, cols: list[str], descending: bool) -> DataFrame:
    order = F.col(bucket).desc() if descending else F.col(bucket)
    spec = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    spec = spec.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, bucket, *[F.coalesce(F.sum(c).over(spec), F.lit(0)).alias(f"_before_{c}")
                                          for c in cols])


def running_totals(df: DataFrame, keys: list[str], value: str, cols: list[str],
                   descending: bool = False) -> DataFrame:
    """Add ``cum_<c>``: the sum of c over rows up to and including this one, ordered by value.

    ``df`` must hold one row per (keys, value), i.e. be grouped already. Rows are
    range-partitioned on sampled bounds, so tasks stay even whatever the
    distribution (scores crowding at 1, say). The partition number orders the
    ranges; writing the rows fixes it, so a lost executor cannot change it.
    """
    d = cut_lineage(df.repartitionByRange(*keys, value).withColumn("_bucket", F.spark_partition_id()))
    totals = d.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(c) for c in cols])
    before = _running(totals, keys, "_bucket", cols, descending)
    order = F.col(value).desc() if descending else F.col(value)
    spec = (Window.partitionBy(*keys, "_bucket").orderBy(order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = d.select("*", *[F.sum(c).over(spec).alias(f"_in_{c}") for c in cols])
    out = inner.join(before, [*keys, "_bucket"])
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_before_{c}") + F.col(f"_in_{c}"))
    return out.drop("_bucket", *[f"_before_{c}" for c in cols], *[f"_in_{c}" for c in cols])


def quantiles(df: DataFrame, keys: list[str], *measures: tuple[Column | str, dict[str, float]]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per name.

    Each measure is (column, {name: probability}); all of them share one pass.
    Counts per (group, measure, bucket) locate the few buckets that hold the
    wanted ranks; only their rows are shuffled, collapsed to distinct values, and
    the two neighbours of each rank are read off a running count. Nulls and NaN
    are ignored. A group whose measure has no value at all yields null or no row.
    """
    names = [n for _, probs in measures for n in probs]
    cells = F.array(*[F.struct(F.lit(i).alias("_m"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("_v"))
                      for i, (c, _) in enumerate(measures)])
    d = df.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell._m", "_cell._v")
    d = d.where("_v is not null and not isnan(_v)").withColumn("_bucket", value_bucket("_v"))
    by = [*keys, "_m"]
    counts = d.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    up_to = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        counts.withColumn("_to", F.sum("_n").over(up_to))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
        .withColumn("_from", F.col("_to") - F.col("_n"))
    )
    wanted = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(n).alias("name"), F.lit(float(p)).alias("p"))
                       for i, (_, probs) in enumerate(measures) for n, p in probs.items()])
    rank = F.col("_q.p") * (F.col("_total") - 1)
    targets = (
        placed.withColumn("_q", F.explode(F.filter(wanted, lambda w: w["m"] == F.col("_m"))))
        .withColumn("_rank", rank).withColumn("_low", F.floor("_rank")).withColumn("_high", F.ceil("_rank"))
        .where("(_low >= _from and _low < _to) or (_high >= _from and _high < _to)")
    )
    per_bucket = targets.groupBy(*by, "_bucket", "_from", "_lo", "_hi").agg(
        F.collect_list(F.struct(F.col("_q.name").alias("name"), "_rank", "_low", "_high")).alias("_want"))
    # The same again inside the wanted buckets: scores that crowd in one bucket are parted evenly by value. A part
    # spans less than 2^-29 of an octave, so it has some eight million distinct doubles at most, whatever the data.
    part = F.floor(F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * PARTS)
    near = d.join(per_bucket.select(*by, "_bucket", "_lo", "_hi"), [*by, "_bucket"]).withColumn("_part", part)
    parts = near.groupBy(*by, "_bucket", "_part").agg(F.count(F.lit(1)).alias("_n"))
    up_to_part = (Window.partitionBy(*by, "_bucket").orderBy("_part")
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per_part = (
        parts.withColumn("_to", F.sum("_n").over(up_to_part)).join(per_bucket, [*by, "_bucket"])
        .withColumn("_to", F.col("_from") + F.col("_to")).withColumn("_from", F.col("_to") - F.col("_n"))
        .withColumn("_want", F.filter("_want", lambda w: ((w["_low"] >= F.col("_from")) & (w["_low"] < F.col("_to")))
                                      | ((w["_high"] >= F.col("_from")) & (w["_high"] < F.col("_to")))))
        .where(F.size("_want") > 0).select(*by, "_bucket", "_part", "_from", "_want")
    )
    # One row per distinct value of a wanted part, with the rank range it covers.
    values = (near.join(per_part.select(*by, "_bucket", "_part"), [*by, "_bucket", "_part"], "left_semi")
              .groupBy(*by, "_bucket", "_part", "_v").agg(F.count(F.lit(1)).alias("_c")))
    inside = (Window.partitionBy(*by, "_bucket", "_part").orderBy("_v")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (
        values.withColumn("_cum", F.sum("_c").over(inside))
        .join(per_part, [*by, "_bucket", "_part"])
        .withColumn("_end", F.col("_from") + F.col("_cum")).withColumn("_begin", F.col("_end") - F.col("_c"))
        .select(*keys, "_v", "_begin", "_end", F.explode("_want").alias("_w"))
        .where("(_w._low >= _begin and _w._low < _end) or (_w._high >= _begin and _w._high < _end)")
    )

    def interpolated(name: str) -> Column:
        hit = F.col("_w.name") == name
        low, high = F.min(F.when(hit, F.col("_v"))), F.max(F.when(hit, F.col("_v")))
        part = F.max(F.when(hit, F.col("_w._rank") - F.col("_w._low")))
        return (low + (high - low) * part).alias(name)

    return ranked.groupBy(*keys).agg(*[interpolated(n) for n in names])


def mean_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, value, out): the average rank of every distinct value, ties sharing their mean."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    cum = running_totals(counts, keys, value, ["_ties"])
    return cum.select(*keys, value, (F.col("cum__ties") - F.col("_ties") + (F.col("_ties") + 1) / 2).alias(out))


def hash_key(seed: int | str, *cols: str) -> Column:
    """Deterministic pseudo-random order: md5 of seed and identifying columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hash_rank(df: DataFrame, seed: int | str, ids: list[str], within: list[str] | None = None,
              out: str = "hash_rank", limit: Column | int | None = None) -> DataFrame:
    """0-based position of every row in the seeded random order, dense within a group.

    The leading hex digits split any group, however hot, into equal buckets of at
    most about ``BUCKET_ROWS`` rows; rows are numbered inside a bucket and shifted by
    its offset. With ``limit`` (constant within a group) only ranks below it are
    returned; buckets beyond it fall out of the join that adds the offsets, which runs on
    (group, bucket) and whose partitioning the numbering reuses.
    """
    keys = within or ["_all"]
    d = df.withColumn("_h", hash_key(seed, *ids))
    if not within:
        d = d.withColumn("_all", F.lit(0))
    digits = 3
    if limit is None:  # buckets that are wanted whole: more of them for more rows
        largest = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        while largest > BUCKET_ROWS * 16 ** digits:
            digits += 1
    d = d.withColumn("_bucket", F.substring("_h", 1, digits))
    if limit is not None:
        d = d.withColumn("_limit", (limit if isinstance(limit, Column) else F.lit(limit)).cast("long"))
    sums = [F.count(F.lit(1)).alias("n")] + ([F.first("_limit").alias("_limit")] if limit is not None else [])
    counts = d.groupBy(*keys, "_bucket").agg(*sums)
    before = _running(counts, keys, "_bucket", ["n"], False)
    if limit is not None:
        before = before.join(counts.select(*keys, "_bucket", F.col("_limit").alias("_most")), [*keys, "_bucket"])
        before = before.where("_before_n < _most").drop("_most")
    spec = Window.partitionBy(*keys, "_bucket").orderBy("_h", *ids)
    ranked = d.join(before, [*keys, "_bucket"]).withColumn("_i", F.row_number().over(spec))
    ranked = ranked.withColumn(out, F.col("_before_n") + F.col("_i") - 1)
    if limit is not None:
        ranked = ranked.where(F.col(out) < F.col("_limit")).drop("_limit")
    return ranked.drop("_h", "_bucket", "_i", "_before_n", *([] if within else ["_all"]))
