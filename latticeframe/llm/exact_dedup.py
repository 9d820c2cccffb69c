"""Exact deduplication by stateful streaming.

Arrivals (digest, identifier, content locator) are an append-only log. A streaming aggregate without watermark
reads the log into disk-backed keyed state (RocksDB) that never expires: per digest the identifier and locator of
the row that stays, and the number of rows. A later run over the same log and checkpoint goes on from there.
Rows that hit an existing digest have their full bytes checked; texts that share a digest without being equal
are told apart by the texts themselves.

Defined results: NULL text counts as empty; texts are equal when identical after lower-casing A-Z; of equal texts the
row with the largest identifier stays, a NULL identifier below all others, of equal identifiers the one with the
largest locator; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .text import ascii_lower, broadcast_if_small

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores share their memory, and reserve no space ahead.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
LOCATOR = ["file", "row"]
# Log bytes that one micro-batch takes into the state.
BATCH_BYTES = 16 << 30


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def located(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, file, row): where each row's content lies. What isn't read from files is written first."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    if "_metadata" in docs.columns:
        rows = cut_lineage(rows)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return rows.select("id", "text", *place)
    except AnalysisException:
        return cut_lineage(rows).select("id", "text", *place)


def append_arrivals(rows: DataFrame, log: str, digest=sha256) -> None:
    """Add located rows to the arrival log."""
    rows.select(digest(ascii_lower(F.col("text"))).alias("digest"), "id", *LOCATOR).write.mode("append").parquet(log)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def advance(spark: SparkSession, log: str, checkpoint: str) -> None:
    """Take all arrivals that no earlier run has taken into the state."""
    schema = spark.read.parquet(log).schema
    with _settings(spark, STATE_CONF):
        arrivals = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(BATCH_BYTES)).parquet(log)
        state = arrivals.groupBy("digest").agg(F.max(F.struct("id", *LOCATOR)).alias("keep"), F.count(F.lit(1)).alias("n"))
        stream = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
        stream.trigger(availableNow=True).start().awaitTermination()


def kept_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, keep (id, file, row), n."""
    raw = spark.read.format("statestore").load(checkpoint)
    keep, n = raw.schema["value"].dataType.names[:2]
    return raw.select("key.digest", F.col(f"value.{keep}").alias("keep"), F.col(f"value.{n}").alias("n"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, digest=sha256, rows: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: id, file, row, keep_id, group_size long, kept boolean, digest binary.

    ``folder`` holds the log and the state (a new one in the shared folder if none is given); given again with
    further rows, those rows are grouped with all earlier ones and the result covers them all. ``rows``: the rows as
    ``located`` gives them, if they are at hand.
    """
    spark = docs.sparkSession
    resumed = folder is not None
    folder = folder or scratch_path(spark, "dedup")
    log, checkpoint = f"{folder}/log", f"{folder}/state"
    rows = located(docs, key, text) if rows is None else rows
    append_arrivals(rows, log, digest)
    arrivals = spark.read.parquet(log)
    if arrivals.isEmpty():
        return arrivals.select("id", *LOCATOR, F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    advance(spark, log, checkpoint)
    state = kept_state(spark, checkpoint)
    groups = cut_lineage(arrivals.join(state, "digest"))
    own = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    result = groups.select("id", *LOCATOR, F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), own.alias("kept"), "digest")
    # Full bytes of all hits: the smallest and the largest text of a digest must be one. Both combine before the
    # shuffle, so a digest with a third of all rows sends one pair of texts per task.
    hits = groups.where("n > 1").select("digest", *LOCATOR)
    texts = _contents(_all_rows(spark, rows, arrivals, text) if resumed else rows, hits)
    span = texts.groupBy("digest").agg(F.min("body").alias("_lo"), F.max("body").alias("_hi"))
    mixed = cut_lineage(span.where(F.col("_lo") != F.col("_hi")).select("digest"))
    if mixed.isEmpty():
        return result
    apart = texts.join(mixed, "digest", "left_semi")
    split = apart.join(groups.select("digest", "id", *LOCATOR), ["digest", *LOCATOR])
    chosen = split.groupBy("digest", "body").agg(F.max(F.struct("id", *LOCATOR)).alias("keep"), F.count(F.lit(1)).alias("n"))
    regrouped = split.join(chosen, ["digest", "body"]).select(
        "id", *LOCATOR, F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), own.alias("kept"), "digest"
    )
    # Rows of earlier runs are told apart like the new ones.
    return result.join(mixed, "digest", "left_anti").select(regrouped.columns).unionByName(regrouped)


def _all_rows(spark: SparkSession, rows: DataFrame, arrivals: DataFrame, text: str) -> DataFrame:
    """(text, file, row) of all rows of the log: those at hand, and the files of earlier runs, which must still be there."""
    own = rows.select("file").distinct()
    # As many as there are files of earlier runs.
    earlier = [r["file"] for r in arrivals.select("file").distinct().join(own, "file", "left_anti").collect()]
    found = rows.select("text", *LOCATOR)
    # Files that ``located`` wrote hold the text under that name.
    for name in {text, "text"}:
        held = [f for f in earlier if name in spark.read.parquet(f).columns]
        earlier = [f for f in earlier if f not in set(held)]
        if held:
            place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
            found = found.unionByName(spark.read.parquet(*held).select(F.col(name).alias("text"), *place))
    if earlier:
        raise FileNotFoundError(f"texts of earlier runs are gone: {earlier[0]}")
    return found


def _contents(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The normalised texts (body) at the locators of hits."""
    return rows.join(broadcast_if_small(hits, hits.count()), LOCATOR).select("digest", *LOCATOR, ascii_lower(F.col("text")).alias("body"))


def addressed(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns renamed to _c0, _c1, ... (so that no name clashes) and the locator of each row.

    Rows that aren't read from files are written first.
    """
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    if "_metadata" not in docs.columns:
        try:
            return plain.select("*", *place)
        except AnalysisException:
            pass
    return cut_lineage(plain).select("*", *place)


def without(rows: DataFrame, gone: DataFrame, names: list[str]) -> DataFrame:
    """``addressed`` rows but those at the locators (file, row) of ``gone``, under their own ``names``."""
    gone = cut_lineage(gone.select(F.col("file").alias("_file"), F.col("row").alias("_row")))
    left = rows.join(broadcast_if_small(gone, gone.count()), ["_file", "_row"], "left_anti")
    return left.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def readdressed(rows: DataFrame, columns: list[str], key: str, text: str) -> DataFrame:
    """(id, text, file, row) of ``addressed`` rows."""
    return rows.select(
        F.col(f"_c{columns.index(key)}").alias("id"), F.col(f"_c{columns.index(text)}").alias("text"), F.col("_file").alias("file"), F.col("_row").alias("row")
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns as given, whatever their names."""
    rows = addressed(docs)
    groups = exact_groups(docs, key, text, rows=readdressed(rows, docs.columns, key, text))
    return without(rows, groups.where(~F.col("kept")), docs.columns)
