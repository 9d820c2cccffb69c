"""Table versions by set operations: insert, upsert, replace, delete, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_per_key, last_per_key


def surrogate_id(*keys: str) -> Column:
    """A stable id from the natural key; no counter shared between tasks."""
    return F.xxhash64(*[F.col(k) for k in keys])


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """``old`` plus the rows of ``new`` whose key is not stored yet, the first one per key (by all columns if no order is given)."""
    order = order or [F.col(c) for c in new.columns]
    fresh = first_per_key(new, key, order).join(old.select(*key), key, "left_anti")
    return old.unionByName(fresh.select(*new.columns))


def replace_group(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """Drop all rows of the groups that ``new`` touches, then add ``new``."""
    return old.join(new.select(*group).distinct(), group, "left_anti").unionByName(new)


def upsert_latest(
    old: DataFrame, new: DataFrame, key: list[str], version: Column, touched: str | None = None, run_time: Column | None = None
) -> DataFrame:
    """One row per key, the one with the largest ``version``; ``touched`` gets the run time where ``new`` won."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    kept = last_per_key(rows.withColumn("_version", version), key, [F.col("_version"), F.col("_new")])
    if touched:
        kept = kept.withColumn(touched, F.when(F.col("_new") == 1, run_time).otherwise(F.col(touched)))
    return kept.select(*old.columns)


def children_of(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Child rows whose parent is still there (cascade)."""
    return child.join(parent.select(*key).distinct(), key, "left_semi")


def delete_keys(table: DataFrame, doomed: DataFrame, key: list[str]) -> DataFrame:
    return table.join(doomed.select(*key).distinct(), key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent (foreign key check)."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def duplicate_keys(table: DataFrame, key: list[str]) -> DataFrame:
    """Keys held by more than one row (uniqueness check)."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unprocessed(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Listed keys that are not stored, each once."""
    return todo.select(*key).distinct().join(done.select(*key), key, "left_anti")


def next_unprocessed(todo: DataFrame, done: DataFrame, key: list[str], position: Column) -> DataFrame:
    """The first listed key that is not stored."""
    return todo.join(done.select(*key).distinct(), key, "left_anti").orderBy(position).limit(1)


def next_number(table: DataFrame, column: str, limit: int = 230) -> DataFrame:
    """One above the largest number; 1 when empty, NULL past the limit."""
    top = table.agg(F.max(column).alias("top"))
    return top.select(F.when(F.col("top").isNull(), 1).when(F.col("top") < limit, F.col("top") + 1).alias("next_number"))


def parents_and_children(parsed: DataFrame, key: list[str], kpoints: str) -> tuple[DataFrame, DataFrame]:
    """Parsed rows with a k-point map to parent rows and one child row per k-point."""
    keyed = parsed.withColumn("ebr_id", surrogate_id(*key))
    parents = keyed.drop(kpoints)
    children = keyed.select("ebr_id", F.explode(kpoints).alias("k_point", "cell"))
    return parents, children


def decomposition_items(df: DataFrame, key: list[str], nested: str) -> DataFrame:
    """``array<array<string>>`` to rows numbered from 1 on both levels."""
    outer = df.select(*key, F.posexplode(nested).alias("_i", "_branches"))
    inner = outer.select(*key, "_i", F.posexplode("_branches").alias("_j", "irreps_string"))
    return inner.select(
        *key, (F.col("_i") + 1).alias("decomposition_index"), (F.col("_j") + 1).alias("branch_index"), "irreps_string"
    )


def wide_branches(items: DataFrame, key: list[str]) -> DataFrame:
    """Branch rows to one row per (key, decomposition index) with the first two branches as columns."""
    picked = [
        F.max(F.when(F.col("branch_index") == i, F.col("irreps_string"))).alias(f"branch{i}_irreps") for i in (1, 2)
    ]
    return items.groupBy(*key, "decomposition_index").agg(*picked)


def branch_line(line: Column) -> tuple[Column, Column, Column, Column]:
    """``index branch1 branch2`` to (status, index, branch1, branch2); branch2 keeps inner blanks."""
    parts = F.split(F.trim(F.regexp_replace(line, r"^\s+|\s+$", "")), r"\s+", 3)
    index = F.get(parts, F.lit(0)).try_cast("int")
    status = (
        F.when(F.size(parts) < 3, "Bad Format").when(index.isNull(), "Bad Index").otherwise("ok")
    )
    return status, index, F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
