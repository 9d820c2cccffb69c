"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in blocks (the input's partitions). How many rows of each block go to each shard is drawn first, exactly as a
uniform shuffle would have it (multivariate hypergeometric, from the block and shard sizes alone). Each block then
permutes its rows and deals them out by those counts, and each shard permutes what it got.

Defined results: a NULL text has no bytes (size 1, crc32 of empty text 0); NULL and repeated identifiers are
rows like others; an empty table gives no rows; shard sizes differ by one at most, the first ones are larger. The same
files read in the same splits give the same shards.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Bounds the matrix that is drawn: partitions beyond it share blocks.
MAX_BLOCKS = 1024
# Second-level parts of a shard, so that no task orders a whole shard.
PARTS = 1024


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Marked items among ``draws`` without replacement, by inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    up = down = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left, right, u = mode, mode, rng.random() - up
    while u > 0 and (left > low or right < high):
        if right < high:
            up *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= up
            if u <= 0:
                return right
        if left > low:
            down *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= down
            if u <= 0:
                return left
    return mode


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Row counts from each block to each shard; rows sum to the blocks' sizes, columns to the shards'."""
    rng, total = random.Random(seed), sum(rows)
    free = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for n in rows:
        line, rest, left = [], sum(free), n
        for j in range(shards):
            rest -= free[j]
            line.append(hypergeometric(rng, free[j], rest, left))
            left -= line[-1]
        free = [f - x for f, x in zip(free, line)]
        matrix.append(line)
    return matrix


def shuffle_into_shards(docs: DataFrame, columns: list[str], shards: int = 16, seed: int = 17) -> DataFrame:
    """``columns`` of each row with shard int and slot long (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    rows = docs.select(*columns, F.pmod(F.spark_partition_id(), F.lit(MAX_BLOCKS)).alias("_block"), F.monotonically_increasing_id().alias("_at"))
    rows = cut_lineage(rows)
    counts = sorted((r["_block"], r["n"]) for r in rows.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect())
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    ends = [(b, [sum(line[: j + 1]) for j in range(shards)]) for (b, _), line in zip(counts, matrix)]
    # At most MAX_BLOCKS rows of ``shards`` numbers.
    plan = F.broadcast(spark.createDataFrame(ends, "_block int, _ends array<long>"))
    permuted = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed), "_at"), "_at")
    ranked = rows.withColumn("_rank", F.row_number().over(permuted)).join(plan, "_block")
    dealt = ranked.withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).cast("int"))
    dealt = dealt.withColumn("_key", F.xxhash64(F.lit(seed + 1), "_at"))
    dealt = dealt.withColumn("_part", F.shiftrightunsigned("_key", 64 - int(math.log2(PARTS))).cast("int"))
    dealt = cut_lineage(dealt.select(*columns, "_at", "shard", "_key", "_part"))
    sizes = dealt.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x PARTS rows.
    starts = F.broadcast(sizes.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("shard", "_part").orderBy("_key", "_at")
    placed = dealt.withColumn("_i", F.row_number().over(inside) - 1).join(starts, ["shard", "_part"])
    return placed.select(*columns, "shard", (F.col("_start") + F.col("_i")).cast("long").alias("slot"))
