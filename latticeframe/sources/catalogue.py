"""Delimited sources: the material catalogue, single columns, generated id lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue with blanks trimmed from its header names; columns are found by name."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    trimmed = raw.toDF(*[c.strip() for c in raw.columns])
    return trimmed.select(
        *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schemas.schema(schemas.CATALOGUE).fields if f.name in trimmed.columns]
    )


def read_delimited_column(spark: SparkSession, path: str, column: str, separator: str = ";") -> DataFrame:
    """One column of a delimited file by header name; rows too short for it are left out."""
    raw = spark.read.option("header", True).option("sep", separator).csv(path)
    trimmed = raw.toDF(*[c.strip() for c in raw.columns])
    return trimmed.select(column).where(F.col(f"`{column}`").isNotNull())


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def generated_ids(spark: SparkSession, n: int, prefix: str = "JVASP-") -> DataFrame:
    """Ids ``prefix1`` to ``prefixn``."""
    return spark.range(1, n + 1).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("jid"))
