"""Batch analysis report: materials joined to the catalogue, classed and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.topology import short_class
from ..operators.joins import last_wins


def classify_materials(materials: DataFrame, catalogue: DataFrame, key: list[str], ordinal: Column) -> DataFrame:
    """Left join to the catalogue (a later row wins); a material without a row is an error."""
    joined = last_wins(materials, catalogue, key, ordinal, "left")
    return joined.withColumn("class", F.when(F.col("Property").isNull(), "error").otherwise(short_class("Property")))


def class_counts(classed: DataFrame) -> DataFrame:
    kind = F.col("class")
    return classed.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kind.isin("SM", "TI")).alias("topological"),
        F.count_if(kind == "SM").alias("sm"), F.count_if(kind == "TI").alias("ti"),
        F.count_if(kind == "trivial").alias("trivial"), F.count_if(kind == "error").alias("errors"),
        F.count_if(~kind.isin("SM", "TI", "error")).alias("non_topological"),
    )


def class_report(materials: DataFrame, catalogue: DataFrame, key: list[str], ordinal: Column) -> DataFrame:
    return class_counts(classify_materials(materials, catalogue, key, ordinal))
