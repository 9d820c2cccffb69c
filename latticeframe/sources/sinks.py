"""Sinks: nested metadata, master index, wide vectors, splits, graphs; and store listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

NESTED = (ArrayType, MapType, StructType)


def rebalanced(table: DataFrame, group: str) -> DataFrame:
    """Rows of a group go to few writers: AQE merges small groups and splits a group that is too large."""
    return table.hint("rebalance", F.col(group))


def write_metadata(records: DataFrame, path: str, group: str | None = None, fmt: str = "parquet") -> None:
    """Nested records, partitioned by space group where one is named."""
    rows = rebalanced(records, group) if group else records
    writer = rows.write.mode("overwrite").format(fmt)
    (writer.partitionBy(group) if group else writer).save(path)


def read_metadata(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Stored records; JSON folders hold one object per file, with ``NaN`` literals allowed."""
    reader = spark.read.schema(schema).format(fmt)
    return (reader.option("multiLine", True) if fmt == "json" else reader).load(path)


def flat_index(records: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that the table fits CSV as well as Parquet."""
    columns = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, NESTED) else F.col(f.name) for f in records.schema.fields
    ]
    return records.select(*columns)


def write_master_index(records: DataFrame, path: str) -> None:
    """The index as Parquet and as CSV below one folder; empty input gives empty tables."""
    index = flat_index(records)
    index.write.mode("overwrite").parquet(f"{path}/parquet")
    index.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")


def wide_vectors(metadata: DataFrame, vectors: DataFrame, method: str, width: int) -> DataFrame:
    """Metadata with one ``feature_i`` column per element; records without that vector are dropped."""
    chosen = vectors.where(F.col("method") == method).select("material_id", "v")
    joined = metadata.join(chosen, "material_id")
    return joined.select(*metadata.columns, *[F.get("v", F.lit(i)).alias(f"feature_{i}") for i in range(width)])


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Each method in its own folder, values as separated text."""
    flat = vectors.withColumn("v", F.array_join(F.transform("v", lambda x: x.cast("string")), " "))
    flat.write.mode("overwrite").partitionBy("method").option("header", True).csv(path)


def write_splits(split: DataFrame, path: str) -> None:
    split.write.mode("overwrite").partitionBy("split").parquet(path)


def write_rows(rows: DataFrame, path: str) -> bool:
    """CSV and JSON of result rows; nothing is written for empty input."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    rows.write.mode("overwrite").json(f"{path}/json")
    return True


def write_graphs(vertices: DataFrame, edges: DataFrame, meta: DataFrame, path: str, group: str) -> None:
    """Vertices, edges and sizes per space group; only the groups present are replaced."""
    for name, table in (("vertices", vertices), ("edges", edges), ("meta", meta)):
        writer = rebalanced(table, group).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(group).parquet(f"{path}/{name}")


def serializable(records: DataFrame, live: list[str]) -> DataFrame:
    return records.drop(*live)
