"""Grouped statistics. Each is a map-side combinable aggregate; nothing gathers an unbounded group."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_per_key

# Integer index columns take the mode, the others the mean.
MODE_COLUMNS = ("z2_0", "z2_1", "z2_2", "z2_3", "chern_number")
MEAN_NAMES = ("mirror_chern", "berry")
FEATURE_WIDTH = 10


def row_counts(tables: dict[str, DataFrame], group: dict[str, str] | None = None) -> DataFrame:
    """One row per table: rows, smallest and largest group number where it has one."""
    parts = []
    for name, table in tables.items():
        column = (group or {}).get(name)
        low = F.min(column) if column else F.lit(None)
        high = F.max(column) if column else F.lit(None)
        parts.append(
            table.agg(F.count(F.lit(1)).alias("n_rows"), low.cast("long").alias("first_group"), high.cast("long").alias("last_group"))
            .select(F.lit(name).alias("table_name"), "n_rows", "first_group", "last_group")
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def value_counts(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, keys: list[str], columns: Iterable[str]) -> DataFrame:
    """Distinct non-null values of several columns as long rows (keys, kind, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.kind", "_p.value")
    return rows.where(F.col("value").isNotNull()).distinct()


def mode_per_key(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Most frequent value per key, the lowest on ties; counted first, so no group is gathered."""
    counts = value_counts(df, keys, column)
    return first_per_key(counts, keys, [-F.col("n"), F.col(column)]).select(*keys, column)


def index_consensus(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: mode of integer index columns, mean of the others; columns are found by name."""
    types = dict(df.dtypes)
    modes = [c for c in df.columns if c in MODE_COLUMNS and types[c] in ("int", "bigint", "boolean")]
    means = [
        c for c in df.columns
        if c not in modes and (c in MODE_COLUMNS or c == "tci" or any(n in c.lower() for n in MEAN_NAMES))
    ]
    result = df.groupBy(*keys).agg(*([F.avg(c).alias(c) for c in means] or [F.count(F.lit(1)).alias("_n")]))
    for column in modes:
        result = result.join(mode_per_key(df, keys, column), keys, "left")
    return result.drop("_n")


def _or_zero(df: DataFrame, column: str | None, make) -> Column:
    return make(F.col(column)).cast("double") if column and column in df.columns else F.lit(0.0)


def _pad(values: list[Column]) -> Column:
    return F.array(*values, *[F.lit(0.0)] * (FEATURE_WIDTH - len(values)))


def _std(c: Column) -> Column:
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def kpoint_features(
    df: DataFrame, keys: list[str], energy="energy", band="band_index", irrep="irrep_label", ebr="ebr_label",
    indices: tuple[str, ...] = (), site="site_symmetry",
) -> DataFrame:
    """Ten numbers per k-point: energy mean, std, min, max, then distinct counts and the mean absolute index."""
    present = [c for c in indices if c in df.columns]
    mean_index = F.lit(0.0)
    if present:
        mean_index = sum((F.coalesce(F.avg(F.abs(c)), F.lit(0.0)) for c in present[1:]), F.coalesce(F.avg(F.abs(present[0])), F.lit(0.0))) / len(present)
    values = [
        _or_zero(df, energy, F.avg), _or_zero(df, energy, _std), _or_zero(df, energy, F.min), _or_zero(df, energy, F.max),
        _or_zero(df, band, F.count_distinct), _or_zero(df, irrep, F.count_distinct), _or_zero(df, ebr, F.count_distinct),
        mean_index, _or_zero(df, site, F.count_distinct),
    ]
    return df.groupBy(*keys).agg(_pad(values).alias("features"))


def irrep_features(
    df: DataFrame, keys: list[str], energy="energy", band="band_index", decomposition="decomposition_index", branch="branch1_irreps"
) -> DataFrame:
    """Ten numbers per irrep: mean, std, rows, distinct bands and decompositions, branches, zeros."""
    values = [
        _or_zero(df, energy, F.avg), _or_zero(df, energy, _std), F.count(F.lit(1)).cast("double"),
        _or_zero(df, band, F.count_distinct), _or_zero(df, decomposition, F.count_distinct), _or_zero(df, branch, F.count),
    ]
    return df.groupBy(*keys).agg(_pad(values).alias("features"))


def decomposition_features(
    df: DataFrame, keys: list[str], kpoint="k_point", irrep="irrep_label", branch1="branch1_irreps", branch2="branch2_irreps"
) -> DataFrame:
    """Ten numbers per decomposition index: rows, distinct k-points and irreps, both branch counts, zeros."""
    values = [
        F.count(F.lit(1)).cast("double"), _or_zero(df, kpoint, F.count_distinct), _or_zero(df, irrep, F.count_distinct),
        _or_zero(df, branch1, F.count), _or_zero(df, branch2, F.count),
    ]
    return df.groupBy(*keys).agg(_pad(values).alias("features"))


def split_values(df: DataFrame, keys: list[str], column: str, separator: str = ",") -> DataFrame:
    """Distinct trimmed parts of separated text as long rows."""
    parts = df.select(*keys, F.explode(F.split(column, separator)).alias("value"))
    return parts.select(*keys, F.trim("value").alias("value")).where("value <> ''").distinct()


def match_rate(df: DataFrame, matched: Column) -> DataFrame:
    """processed, matched and their ratio."""
    counted = df.agg(F.count(F.lit(1)).alias("processed"), F.count_if(matched).alias("matched"))
    return counted.withColumn("match_rate", F.col("matched") / F.greatest(F.col("processed"), F.lit(1)))


def composition_statistics(df: DataFrame, keys: list[str], z: str) -> DataFrame:
    """Mean, population std, min and max of the atomic number, distinct elements and atoms."""
    return df.groupBy(*keys).agg(
        F.avg(z).alias("z_mean"), F.stddev_pop(z).alias("z_std"), F.min(z).alias("z_min"), F.max(z).alias("z_max"),
        F.count_distinct(z).alias("n_elements"), F.count(F.lit(1)).alias("n_atoms"),
    )
