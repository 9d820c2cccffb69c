"""Stored tables: one space group by partition, property dumps, shared graphs, and database tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_group(spark: SparkSession, path: str, value, column: str = "space_group_number") -> DataFrame:
    """Rows of one group; a table partitioned by the column reads that folder only."""
    return spark.read.parquet(path).where(F.col(column) == F.lit(value))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """A bulk property dump, one JSON object per line; a missing key is NULL and ``NaN`` is a number."""
    return spark.read.schema(schemas.BULK_PROPERTIES).json(path)


def shared_graph_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Stored graph sizes per group, for a left join that leaves groups without a graph NULL."""
    return spark.read.parquet(f"{path}/meta")


def read_database_table(
    spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, **options: str
) -> DataFrame:
    """A table of an external database, read in ranges of a numeric column by several tasks."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts)
    )
    return reader.options(**options).load()
