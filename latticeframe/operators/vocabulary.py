"""Vocabularies that grow: label to index tables, append-only and versioned.

A known label keeps its index for ever; labels that are met for the first time get the next ones, in label order. So vectors
that were coded by an earlier version stay right as prefixes of later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import dense_index

SCHEMA = "kind string, label string, idx long, version int"


def empty_vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def additions(known: DataFrame, facts: DataFrame, kind: str = "kind", label: str = "label") -> DataFrame:
    """Rows to append to ``known`` so that it holds every label of ``facts``; each kind is indexed by itself."""
    met = facts.select(F.col(kind).alias("kind"), F.col(label).cast("string").alias("label")).dropna().distinct()
    fresh = cut_lineage(met.join(known.select("kind", "label"), ["kind", "label"], "left_anti"))
    ranked = dense_index(fresh, ["kind"], "label", "_rank")
    size = known.groupBy("kind").agg((F.max("idx") + 1).alias("_size"))
    version = known.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("v")).first()["v"]
    placed = ranked.join(size, "kind", "left")
    return placed.select("kind", "label", (F.coalesce("_size", F.lit(0)) + F.col("_rank")).alias("idx"), F.lit(version).cast("int").alias("version"))


def grow(known: DataFrame, facts: DataFrame, kind: str = "kind", label: str = "label") -> DataFrame:
    """The next version of a vocabulary."""
    return cut_lineage(known.unionByName(additions(known, facts, kind, label)))


def append_labels(spark: SparkSession, path: str, facts: DataFrame, kind: str = "kind", label: str = "label") -> DataFrame:
    """Grow the vocabulary stored at ``path`` (made if absent) and read it back; rows already there are never rewritten."""
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store)
    known = spark.read.schema(SCHEMA).parquet(path) if exists else empty_vocabulary(spark)
    cut_lineage(additions(known, facts, kind, label)).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def codes(facts: DataFrame, keys: list[str], vocabulary: DataFrame, kind: str = "kind", label: str = "label") -> DataFrame:
    """Sparse multi-hot codes: per key and kind the sorted distinct indexes of its labels, and the vocabulary's size."""
    size = vocabulary.groupBy("kind").agg(F.count(F.lit(1)).alias("size"))
    rows = facts.select(*keys, F.col(kind).alias("kind"), F.col(label).cast("string").alias("label")).distinct()
    met = rows.join(vocabulary.select("kind", "label", "idx"), ["kind", "label"]).groupBy(*keys, "kind").agg(F.array_sort(F.collect_set("idx")).alias("indexes"))
    return met.join(size, "kind")
