"""Stored pages to tables: band representations, decompositions, topological indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import maintenance as mt
from ..session import cut_lineage
from ..sources import pages as pg
from ..sources.sinks import rebalanced


def ingest_bandreps(pages: DataFrame, group: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages to (ebrs, irreps, failures); ids are hashes of (group, column), so a rerun gives the same rows."""
    # Parsing costs most here, and all three tables come from it: it runs once, into a staging table.
    parsed = cut_lineage(pg.parsed_bandreps(pages, group))
    columns = parsed.where(F.col("ebr_column").isNotNull())
    parents, children = mt.parents_and_children(columns, [group, "ebr_column"], "kpoints")
    ebrs = parents.select(
        F.col("ebr_id").alias("id"), group, labels.wyckoff("wyckoff").alias("w"), labels.orbital("bandrep").alias("o"),
        F.col("note").alias("notes"),
    ).select("id", group, "w.*", "o.*", "notes")
    irreps = children.select(
        F.xxhash64("ebr_id", "k_point").alias("id"), "ebr_id", "k_point", labels.irrep_label("cell").alias("irrep_label"),
        labels.multiplicity("cell").alias("multiplicity"),
    )
    return ebrs, irreps, pg.failures(parsed, group)


def ingest_decompositions(pages: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Decomposition pages to (branch rows, decomposition-into-EBR rows)."""
    parsed = cut_lineage(pg.decompositions(pages, key))
    items = mt.decomposition_items(parsed.where("kind = 'branches'"), [key], "branches")
    lists = parsed.where("kind = 'ebr_list'").select(key, F.explode("ebr_list").alias("decomposes_into"))
    return items, lists


def ingest_indices(pages: DataFrame, group: str, magnetic: bool = False) -> tuple[DataFrame, DataFrame]:
    """Index pages to (indices, irrep values); a page without a table gives no row."""
    rows = pg.magnetic_index_tables(pages, group) if magnetic else pg.index_tables(pages, group)
    keyed = cut_lineage(rows.withColumn("id", F.xxhash64(group, "index_name")))
    indices = keyed.select("id", group, "index_name", "mod_value")
    values = keyed.select(F.col("id").alias("topo_index_id"), F.explode("irreps").alias("irrep_name", "value"))
    return indices, values


def write_group_tables(df: DataFrame, path: str, group: str) -> None:
    """Replace only the partitions of the groups in ``df``."""
    writer = rebalanced(df, group).write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    writer.partitionBy(group).parquet(path)
