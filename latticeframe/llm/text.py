"""Shared text helpers: white-space tokens on Arrow batches, and key expressions."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

# Separators of tokens: space and U+0009 to U+000D.
SPACES = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 4 << 20
BATCH_ROWS = 2000


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only; NULL counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a NULL key counts as empty text (fold 0)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts stay near ``limit`` bytes, so that work arrays stay bounded; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield batch.slice(start)


def keyed(schema: str, **columns: DataType) -> StructType:
    """A schema of the given columns, whatever their types and field names, followed by those of a DDL string."""
    return StructType([StructField(c, t) for c, t in columns.items()] + StructType.fromDDL(schema).fields)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's limit of rows per Arrow batch: whole texts are long, and both sides hold a batch at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def release() -> None:
    """Give freed memory back to the system: Python workers live on from task to task, beside others on their machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # no such call on this system


# How to drop what operators keep in a worker from task to task.
KEPT: list[Callable[[], None]] = []


def let_go() -> None:
    for drop in KEPT:
        drop()


def frugal(run):
    """A function on Arrow batches that gives its memory back after each batch, and that of other operators before the first."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            yield from run(iter([batch]))
            release()

    return wrapped


def filled(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "")


def token_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Tokens of texts, lower-cased in A-Z: the code of each token, its row, and the distinct tokens by code."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(filled(texts)))
    rows = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    tokens = parts.flatten()
    full = pc.greater(pc.binary_length(tokens), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        tokens, rows = tokens.filter(pa.array(full)), rows[full]
    coded = tokens.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), rows, coded.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct tokens."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 500_000) -> DataFrame:
    """Broadcast hint for a table of known row count (narrow rows) below ``limit``; a plain shuffle join above it."""
    return F.broadcast(df) if rows <= limit else df


def unit_hash(seed: int, *columns: Column) -> Column:
    """A uniform number in [0, 1) that depends on the seed and the columns only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) * F.lit(2.0**-53)
