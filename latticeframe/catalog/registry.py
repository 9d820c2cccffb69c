"""Registered queries: each runs on the given tables and names its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import spread


class Tables:
    """Lazy Parquet tables of one data folder, read as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def spread(self, name: str, *columns: str) -> DataFrame:
        """A table for row-local work, over all cores even when its file is small."""
        return spread(getattr(self, name).select(*columns or ["*"]))

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


@dataclass(frozen=True)
class Entry:
    name: str
    covers: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a function from ``Tables`` to a DataFrame under ``name``."""

    def register(run: Callable[[Tables], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(name, covers, run, sql)
        return run

    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Entry):
        return lambda spark, sf_dir: entry.run(Tables(spark, sf_dir))

    return {name: bind(entry) for name, entry in ENTRIES.items()}


def sql_twins() -> dict[str, str]:
    return {name: entry.sql for name, entry in ENTRIES.items() if entry.sql}
