"""Order-dependent operators that stay even when one group holds most rows.

A plain window over a group sends the whole group to one task. Each function
here takes a ``bucket`` column that never decreases along the order column:
work inside a bucket is a window over (group, bucket), and only one total per
bucket is carried across buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the smallest ``order`` per key, by a map-side combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the largest ``order`` per key (the last writer wins)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def running_sum(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, out: str
) -> DataFrame:
    """Inclusive prefix sum of ``value`` per key in ``order``."""
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.withColumn("_local", F.sum("_value").over(inside))
    joined = local.join(starts, [*keys, "_bucket"])
    return joined.withColumn(out, F.col("_start") + F.col("_local")).select(*df.columns, out)


def row_numbers(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Row number from 1 per key in ``order``."""
    return running_sum(df, keys, bucket, order, F.lit(1).cast("long"), out)


def next_value(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: str, out: str
) -> DataFrame:
    """The value on the following row per key; NULL on the last row."""
    rows = df.withColumn("_bucket", bucket)
    heads = rows.groupBy(*keys, "_bucket").agg(F.min_by(value, F.struct(*order)).alias("_head"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    heads = heads.select(*keys, "_bucket", F.lead("_head").over(across).alias("_next_head"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = rows.withColumn("_local", F.lead(value).over(inside)).withColumn(
        "_is_last", F.lead(F.lit(True)).over(inside).isNull()
    )
    joined = local.join(heads, [*keys, "_bucket"])
    picked = F.when(F.col("_is_last"), F.col("_next_head")).otherwise(F.col("_local"))
    return joined.withColumn(out, picked).select(*df.columns, out)


def range_buckets(rows: DataFrame, order: list[str], parts: int | None = None, out: str = "_bucket") -> DataFrame:
    """``rows`` with the number of their range of ``order``, written once.

    Ranges are cut from a sample of the values, so they hold like numbers of rows whatever the values look like;
    equal rows of ``order`` share a range.
    """
    dealt = rows.repartitionByRange(*([parts] if parts else []), *order)
    return cut_lineage(dealt.withColumn(out, F.spark_partition_id()))


def dense_index(values: DataFrame, keys: list[str], column: str, out: str, parts: int | None = None) -> DataFrame:
    """Position from 0 of each distinct value per key, in value order."""
    distinct = values.where(F.col(column).isNotNull()).select(*keys, column).distinct()
    dealt = range_buckets(distinct, [*keys, column], parts, "_range")
    ranked = row_numbers(dealt, keys, F.col("_range"), [F.col(column)], "_rank")
    return ranked.select(*keys, column, (F.col("_rank") - 1).alias(out))


def stratified_split(
    df: DataFrame, key: str, stratum: str, train: float, validation: float, seed: int, out: str = "split"
) -> DataFrame:
    """Exact train / val / test cut per stratum, in the order of a seeded hash of the key."""
    hashed = df.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(key)))
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    ranked = row_numbers(hashed, [stratum], F.shiftright("_hash", 50), [F.col("_hash"), F.col(key)], "_rank")
    n_train = F.round(F.col("_size") * train)
    n_val = F.round((F.col("_size") - n_train) * (validation / (1 - train)))
    split = (
        F.when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_val, "val").otherwise("test")
    )
    return ranked.join(sizes, stratum).withColumn(out, split).select(*df.columns, out)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], buckets: int | None = None, weight: str | None = None
) -> DataFrame:
    """Linearly interpolated quantiles per key, exact, without gathering a group.

    Distinct values are dealt into ranges of like numbers of them; pass one counts the rows per range, pass two ranks
    only the values of the ranges that hold a wanted rank. One far value or one common value shifts no range.
    ``weight``: ``df`` holds distinct values, each as often as this column says.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), *([F.col(weight).alias("_n")] if weight else []))
    rows = rows if weight else rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = range_buckets(rows, [*keys, "_v"], buckets)
    sizes = placed.groupBy(*keys).agg(F.sum("_n").alias("_rows"))
    placed = placed.join(sizes, keys)
    counts = placed.groupBy(*keys, "_bucket", "_rows").agg(F.sum("_n").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0)))

    def position(p: float) -> Column:
        return (F.col("_rows") - 1) * F.lit(p)

    def holds(p: float) -> Column:
        first, last = F.floor(position(p)), F.ceil(position(p))
        return (F.col("_start") <= last) & (F.col("_start") + F.col("_total") > first)

    wanted = F.lit(False)
    for p in probabilities.values():
        wanted = wanted | holds(p)
    kept = counts.where(wanted).select(*keys, "_bucket", "_start")
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v")
    ranked = placed.join(kept, [*keys, "_bucket"]).withColumn(
        "_end", F.col("_start") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )

    def at(rank: Column) -> Column:
        hit = (F.col("_end") > rank) & (F.col("_end") - F.col("_n") <= rank)
        return F.max(F.when(hit, F.col("_v")))

    parts = []
    for name, p in probabilities.items():
        low, high = at(F.floor(position(p))), at(F.ceil(position(p)))
        share = F.max(position(p) - F.floor(position(p)))
        parts.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(*keys).agg(*parts)
