"""Resume by stream progress: only files that no earlier run has finished are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages arriving in a folder, one file each: (page_key, html)."""
    raw = spark.readStream.format("text").option("wholetext", True).load(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return raw.select(name.alias("page_key"), F.col("value").alias("html"))


def ingest_new_pages(
    spark: SparkSession, folder: str, progress: str, write: Callable[[DataFrame, int], None]
) -> None:
    """Run over the files that are new since the last run, then stop.

    ``progress`` is a folder every executor can reach. ``write`` gets one static DataFrame per
    batch and its number; a batch may be repeated after a failure, so it should replace, not add.
    """
    query = (
        new_pages(spark, folder).writeStream.option("checkpointLocation", progress)
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
