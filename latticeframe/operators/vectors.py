"""Fixed-width feature vectors from points and properties.

Point clouds are handled in long form (cloud, dimension, value), so every
statistic is a map-side combinable aggregate, however large one cloud is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import cut_lineage
from .ranking import exact_quantiles

SUMMARY_WIDTH = 128
OVERALL = -1


def long_points(df: DataFrame, cloud: str, vector: str, dimensions: int | None = None) -> DataFrame:
    """(cloud, dim, v) rows from one vector per point."""
    source = F.slice(vector, 1, dimensions) if dimensions else F.col(vector)
    rows = df.select(cloud, F.posexplode(source).alias("dim", "v"))
    return rows.withColumn("v", F.col("v").cast("double"))


def _with_overall(long: DataFrame, cloud: str) -> DataFrame:
    """Each value once under its dimension and once under the overall one."""
    return long.select(cloud, F.explode(F.array(F.col("dim"), F.lit(OVERALL))).alias("dim"), "v")


def cloud_statistics(long: DataFrame, cloud: str) -> DataFrame:
    """Per cloud and dimension: mean, population std, min, max, median, skew and excess kurtosis.

    Dimension -1 holds the overall values.
    """
    rows = _with_overall(long, cloud)
    stats = rows.groupBy(cloud, "dim").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurtosis"),
    )
    medians = exact_quantiles(long, [cloud, "dim"], "v", {"median": 0.5})
    return stats.join(medians, [cloud, "dim"], "left")


def cloud_pooling(long: DataFrame, cloud: str) -> DataFrame:
    """Per cloud and dimension: mean, max, min, median, L2 norm and range."""
    pooled = long.groupBy(cloud, "dim").agg(
        F.avg("v").alias("mean"), F.max("v").alias("max"), F.min("v").alias("min"),
        F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l2"), (F.max("v") - F.min("v")).alias("range"),
    )
    return pooled.join(exact_quantiles(long, [cloud, "dim"], "v", {"median": 0.5}), [cloud, "dim"])


def cloud_moments(long: DataFrame, cloud: str, largest: int = 4) -> DataFrame:
    """Central moments 1..largest per cloud and dimension, around means from a first pass."""
    means = long.groupBy(cloud, "dim").agg(F.avg("v").alias("_mean"))
    centred = long.join(means, [cloud, "dim"]).withColumn("_d", F.col("v") - F.col("_mean"))
    powers = [F.lit(0.0).alias("m1")] + [F.avg(F.pow("_d", k)).alias(f"m{k}") for k in range(2, largest + 1)]
    return centred.groupBy(cloud, "dim").agg(*powers)


def cloud_histograms(long: DataFrame, cloud: str, bins: int = 10) -> DataFrame:
    """Equal-width bin densities per cloud and dimension; dimension -1 is over all values.

    The last bin is closed, and a constant column widens by 0.5 on each side. Empty bins hold 0.
    """
    rows = _with_overall(long, cloud)
    span = rows.groupBy(cloud, "dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    flat = F.col("lo") == F.col("hi")
    span = span.select(
        cloud, "dim", "n", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    placed = rows.join(span.drop("n"), [cloud, "dim"]).withColumn(
        "bin", F.least(F.expr(f"width_bucket(v, lo, hi, {bins})"), F.lit(bins)).cast("int")
    )
    counts = placed.groupBy(cloud, "dim", "bin").agg(F.count(F.lit(1)).alias("_c"))
    grid = span.select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    joined = grid.join(counts, [cloud, "dim", "bin"], "left")
    width = (F.col("hi") - F.col("lo")) / bins
    return joined.select(cloud, "dim", "bin", (F.coalesce("_c", F.lit(0)) / (F.col("n") * width)).alias("density"))


def cloud_covariance(df: DataFrame, cloud: str, vector: str, width: int) -> DataFrame:
    """Per cloud: rows, sums and summed outer products as (cloud, pos, total).

    Each Arrow batch is reduced to one matrix per cloud before anything is shuffled.
    """

    def partial(batches):
        for pdf in batches:
            for key, group in pdf.groupby(cloud):
                x = np.stack(group[vector].to_numpy()).astype("float64")
                parts = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                yield pd.DataFrame({cloud: [key], "parts": [parts.tolist()]})

    key_type = df.schema[cloud].dataType.simpleString()
    partials = df.select(cloud, vector).mapInPandas(partial, f"{cloud} {key_type}, parts array<double>")
    return partials.select(cloud, F.posexplode("parts").alias("pos", "x")).groupBy(cloud, "pos").agg(F.sum("x").alias("total"))


def cloud_pca(df: DataFrame, cloud: str, vector: str, width: int, components: int = 10) -> DataFrame:
    """Component means (0), stds and explained-variance ratios per cloud, k = min(10, min(shape) - 1), as ``features``.

    Eigenvalues come from the covariance matrix, whose size depends on the width only. All of them, those beyond k too, are
    ``variances``: k leaves out one component, at least, of a cloud of more points than dimensions.
    """
    sums = cloud_covariance(df, cloud, vector, width)
    key_type = df.schema[cloud].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total = pdf.sort_values("pos")["total"].to_numpy()
        n = total[0]
        k = int(min(components, min(n, width) - 1))
        if k <= 0:
            return pd.DataFrame({cloud: [], "features": [], "variances": []})
        mean = total[1 : width + 1] / n
        scatter = total[width + 1 :].reshape(width, width) - n * np.outer(mean, mean)
        values = np.clip(np.linalg.eigvalsh(scatter)[::-1], 0, None)
        ratio = values[:k] / values.sum() if values.sum() > 0 else np.zeros(k)
        features = np.concatenate([np.zeros(k), np.sqrt(values[:k] / n), ratio])
        return pd.DataFrame({cloud: [pdf[cloud].iloc[0]], "features": [features.tolist()], "variances": [(values / n).tolist()]})

    return sums.groupBy(cloud).applyInPandas(solve, f"{cloud} {key_type}, features array<double>, variances array<double>")


def _nearest(points: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """The nearest word of each point, of equally near ones the first; in slices, so that no large table is made."""
    out = [((points[i : i + 1024, None, :] - codebook[None]) ** 2).sum(-1).argmin(1) for i in range(0, len(points), 1024)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _points_of(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(values), -1)


def bag_of_words(df: DataFrame, cloud: str, vector: str, codebook: list[list[float]]) -> DataFrame:
    """Share of each cloud's points per word of a codebook (see ``learned_codebook``).

    A point belongs to its nearest word, of equally near ones to the first; NULL vectors to none.
    """
    book = np.array(codebook, dtype="float64")

    def assign(batches):
        for batch in batches:
            word = _nearest(_points_of(batch.column(1)), book).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(word)], ["cloud", "word"])

    schema = StructType([StructField("cloud", df.schema[cloud].dataType), StructField("word", IntegerType())])
    words = df.where(F.col(vector).isNotNull()).select(cloud, F.col(vector).cast("array<double>")).mapInArrow(assign, schema)
    counted = words.withColumnRenamed("cloud", cloud).groupBy(cloud, "word").agg(F.count(F.lit(1)).alias("_c"))
    # At most one row per word and cloud.
    total = F.sum("_c").over(Window.partitionBy(cloud))
    return counted.select(cloud, "word", (F.col("_c") / total).alias("share"))


def learned_codebook(df: DataFrame, vector: str, key: str, clusters: int = 50, rounds: int = 20) -> list[list[float]]:
    """The centres of ``clusters`` clusters of all points, by Lloyd's rounds from the points of the smallest keys.

    A round is one aggregate: each Arrow batch sends the number and the sum of its points per word. A word without
    points stays where it is; rounds end early when no centre moves. The driver holds the codebook only.
    """
    points = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), F.col(key).alias("k"))
    book = np.array([r["v"] for r in points.orderBy("k").limit(clusters).collect()], dtype="float64")
    for _ in range(rounds if len(book) else 0):
        current = book

        def partial(batches, current=current):
            for batch in batches:
                x = _points_of(batch.column(0))
                word = _nearest(x, current)
                sums = np.zeros((len(current), current.shape[1] + 1))
                np.add.at(sums[:, 1:], word, x)
                sums[:, 0] = np.bincount(word, minlength=len(current))
                on = np.flatnonzero(sums[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(list(sums[on]), pa.list_(pa.float64()))], ["word", "s"])

        parts = points.select("v").mapInArrow(partial, "word int, s array<double>").select("word", F.posexplode("s").alias("pos", "x"))
        sums = np.zeros((len(book), book.shape[1] + 1))
        for r in parts.groupBy("word", "pos").agg(F.sum("x").alias("x")).collect():
            sums[r["word"], r["pos"]] = r["x"]
        full = sums[:, 0] > 0
        book = current.copy()
        book[full] = sums[full, 1:] / sums[full, :1]
        if np.array_equal(book, current):
            break
    return book.tolist()


METHODS = ("statistical", "pca", "histogram", "moment", "pool")


# Slots that partial states of a cloud are merged in first.
MERGE_SLOTS = 32


def _state(x: np.ndarray, with_scatter: bool) -> np.ndarray:
    """Mergeable state of points: (7, width + 1) of number, mean, M2 to M4, least and largest per dimension and overall; scatter."""
    columns = [*x.T, x.ravel()]
    out = np.zeros((7, len(columns)))
    for i, v in enumerate(columns):
        v = v[~np.isnan(v)]
        if len(v):
            d = v - v.mean()
            out[:, i] = len(v), v.mean(), (d**2).sum(), (d**3).sum(), (d**4).sum(), v.min(), v.max()
    flat = [out.ravel()]
    if with_scatter:
        whole = x[~np.isnan(x).any(1)]
        mean = whole.mean(0) if len(whole) else np.zeros(x.shape[1])
        flat += [[len(whole)], mean, ((whole - mean).T @ (whole - mean)).ravel()]
    return np.concatenate(flat)


def _merged(p: np.ndarray, q: np.ndarray, width: int) -> np.ndarray:
    """The state of two sets of points from theirs."""
    size = 7 * (width + 1)
    a, b = p[:size].reshape(7, -1), q[:size].reshape(7, -1)
    n = a[0] + b[0]
    safe = np.maximum(n, 1)
    na, nb, d = a[0], b[0], np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    out = np.zeros_like(a)
    out[0], out[1] = n, (na * a[1] + nb * b[1]) / safe
    out[2] = a[2] + b[2] + d**2 * na * nb / safe
    out[3] = a[3] + b[3] + d**3 * na * nb * (na - nb) / safe**2 + 3 * d * (na * b[2] - nb * a[2]) / safe
    out[4] = (
        a[4] + b[4] + d**4 * na * nb * (na**2 - na * nb + nb**2) / safe**3
        + 6 * d**2 * (na**2 * b[2] + nb**2 * a[2]) / safe**2 + 4 * d * (na * b[3] - nb * a[3]) / safe
    )
    out[5] = np.where(na == 0, b[5], np.where(nb == 0, a[5], np.minimum(a[5], b[5])))
    out[6] = np.where(na == 0, b[6], np.where(nb == 0, a[6], np.maximum(a[6], b[6])))
    flat = [out.ravel()]
    if len(p) > size:
        s, t = p[size:], q[size:]
        n = max(s[0] + t[0], 1)
        d = t[1 : width + 1] - s[1 : width + 1]
        flat += [[s[0] + t[0]], (s[0] * s[1 : width + 1] + t[0] * t[1 : width + 1]) / n, s[width + 1 :] + t[width + 1 :] + np.outer(d, d).ravel() * (s[0] * t[0] / n)]
    return np.concatenate(flat)


def cloud_states(df: DataFrame, cloud: str, vector: str, width: int, scatter: bool = True) -> DataFrame:
    """(cloud, state) in one scan of the points: each Arrow batch sends one state per cloud, and states are merged in two steps."""
    point = F.slice(F.col(vector).cast("array<double>"), 1, width)
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) >= width)).select(F.col(cloud).alias("cloud"), point.alias("v"))
    kind = StructField("cloud", df.schema[cloud].dataType)
    list_type = pa.list_(pa.float64())

    def partial(batches):
        for k, batch in enumerate(batches):
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            which = codes.indices.to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            made = [_state(x[which == i], scatter) for i in range(len(codes.dictionary))]
            yield pa.RecordBatch.from_arrays([codes.dictionary, pa.array([k % MERGE_SLOTS] * len(made), pa.int32()), pa.array(made, list_type)], ["cloud", "slot", "state"])

    def merge(table: pa.Table) -> pa.Table:
        states = [np.array(s) for s in table.column("state").to_pylist()]
        while len(states) > 1:
            states = [_merged(*states[i : i + 2], width) if i + 1 < len(states) else states[i] for i in range(0, len(states), 2)]
        return table.slice(0, 1).set_column(table.column_names.index("state"), "state", pa.array([states[0]], list_type))

    slotted = StructType([kind, *StructType.fromDDL("slot int, state array<double>").fields])
    parts = rows.mapInArrow(partial, slotted).groupBy("cloud", "slot").applyInArrow(merge, slotted)
    whole = StructType([kind, *StructType.fromDDL("state array<double>").fields])
    return parts.select("cloud", "state").groupBy("cloud").applyInArrow(merge, whole).withColumnRenamed("cloud", cloud)


def _summaries(states: DataFrame, cloud: str, width: int) -> DataFrame:
    """Per cloud and dimension (-1 for overall) all that follows from the states."""
    per = F.transform(
        F.sequence(F.lit(0), F.lit(width)),
        lambda i: F.struct(*[F.get("state", i + r * (width + 1)).alias(n) for r, n in enumerate(("n", "mean", "s2", "s3", "s4", "min", "max"))]),
    )
    rows = states.select(cloud, F.posexplode(per).alias("dim", "s")).select(cloud, F.when(F.col("dim") == width, OVERALL).otherwise(F.col("dim")).alias("dim"), "s.*")
    varies = F.col("s2") > 0
    return rows.where("n > 0").select(
        cloud, "dim", "n", "mean", "min", "max", F.sqrt(F.col("s2") / F.col("n")).alias("std"),
        F.when(varies, F.sqrt("n") * F.col("s3") / F.pow("s2", F.lit(1.5))).alias("skew"), F.when(varies, F.col("n") * F.col("s4") / (F.col("s2") * F.col("s2")) - 3).alias("kurtosis"),
        F.lit(0.0).alias("m1"), *[(F.col(f"s{k}") / F.col("n")).alias(f"m{k}") for k in (2, 3, 4)],
        F.sqrt(F.col("s2") + F.col("n") * F.col("mean") * F.col("mean")).alias("l2"), (F.col("max") - F.col("min")).alias("range"),
    )


def _binned(counts: DataFrame, spans: DataFrame, cloud: str, bins: int = 10) -> DataFrame:
    """Equal-width bin densities of counted values (cloud, dim, v, _n), as in ``cloud_histograms``."""
    flat = F.col("min") == F.col("max")
    span = spans.select(cloud, "dim", "n", F.when(flat, F.col("min") - 0.5).otherwise(F.col("min")).alias("lo"), F.when(flat, F.col("max") + 0.5).otherwise(F.col("max")).alias("hi"))
    rows = counts.select(cloud, F.explode(F.array(F.col("dim"), F.lit(OVERALL))).alias("dim"), "v", "_n")
    placed = rows.join(span.drop("n"), [cloud, "dim"]).withColumn("bin", F.least(F.expr(f"width_bucket(v, lo, hi, {bins})"), F.lit(bins)).cast("int"))
    found = placed.groupBy(cloud, "dim", "bin").agg(F.sum("_n").alias("_c"))
    grid = span.select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(found, [cloud, "dim", "bin"], "left").select(cloud, "dim", "bin", (F.coalesce("_c", F.lit(0)) / (F.col("n") * width)).alias("density"))


def _components(states: DataFrame, cloud: str, width: int, components: int = 10) -> DataFrame:
    """The features of ``cloud_pca`` from the states."""

    def solve(batches):
        for batch in batches:
            out = []
            for state in batch.column(1).to_pylist():
                tail = np.array(state[7 * (width + 1) :])
                n, k = tail[0], int(min(components, min(tail[0], width) - 1))
                values = np.clip(np.linalg.eigvalsh(tail[width + 1 :].reshape(width, width))[::-1], 0, None)
                ratio = values[: max(k, 0)] / values.sum() if values.sum() > 0 else np.zeros(max(k, 0))
                out.append(None if k <= 0 else np.concatenate([np.zeros(k), np.sqrt(values[:k] / n), ratio]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], [batch.schema.names[0], "features"])

    schema = StructType([StructField(cloud, states.schema[cloud].dataType), *StructType.fromDDL("features array<double>").fields])
    return states.select(cloud, "state").mapInArrow(solve, schema)


METHODS = ("statistical", "pca", "histogram", "moment", "pool")


def vectorize_clouds(df: DataFrame, cloud: str, vector: str, width: int, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Chosen methods over the points of each cloud as long rows (cloud, method, pos, value), in each method's own order.

    Points are scanned twice at most: once for the mergeable states that all methods draw from, once for the counted
    values that medians and histograms need. NULL and shorter vectors are left out.
    """
    states = cut_lineage(cloud_states(df, cloud, vector, width, "pca" in methods))
    table = cut_lineage(_summaries(states, cloud, width))
    if {"statistical", "pool", "histogram"} & set(methods):
        kept = df.where(F.size(vector) >= width)
        counts = cut_lineage(long_points(kept, cloud, vector, width).where(F.col("v").isNotNull()).groupBy(cloud, "dim", "v").agg(F.count(F.lit(1)).alias("_n")))
    if {"statistical", "pool"} & set(methods):
        table = cut_lineage(table.join(exact_quantiles(counts, [cloud, "dim"], "v", {"median": 0.5}, weight="_n"), [cloud, "dim"], "left"))
    single = table.where(F.col("dim") >= 0)

    def rows(source: DataFrame, method: str, places: list[tuple[Column, str]]) -> DataFrame:
        entries = F.array(*[F.struct(place.cast("long").alias("pos"), F.col(n).alias("value")) for place, n in places])
        return source.select(cloud, F.lit(method).alias("method"), F.explode(entries).alias("e")).select(cloud, "method", "e.*")

    def blocks(method: str, names: list[str]) -> DataFrame:
        return rows(single, method, [(F.lit(i * width) + F.col("dim"), n) for i, n in enumerate(names)])

    parts = []
    if "statistical" in methods:
        base = width * 5
        parts.append(blocks("statistical", ["mean", "std", "min", "max", "median"]))
        parts.append(rows(table.where(F.col("dim") == OVERALL), "statistical", [(F.lit(base + i), n) for i, n in enumerate(["mean", "std", "min", "max"])]))
        parts.append(rows(single, "statistical", [(base + 4 + F.col("dim") * 2 + i, n) for i, n in enumerate(["skew", "kurtosis"])]))
    if "pca" in methods:
        found = _components(states, cloud, width).where(F.col("features").isNotNull())
        found = found.select(cloud, F.lit("pca").alias("method"), F.posexplode("features").alias("pos", "value"))
        parts.append(found.withColumn("pos", F.col("pos").cast("long")))
    if "histogram" in methods:
        slot = F.when(F.col("dim") == OVERALL, width).otherwise(F.col("dim"))
        hist = _binned(counts, table, cloud)
        parts.append(rows(hist, "histogram", [(slot * 10 + F.col("bin") - 1, "density")]))
    if "moment" in methods:
        parts.append(blocks("moment", ["m1", "m2", "m3", "m4"]))
    if "pool" in methods:
        parts.append(blocks("pool", ["mean", "max", "min", "median", "l2", "range"]))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def pad(values: Column, width: int = SUMMARY_WIDTH) -> Column:
    """The array filled with zeros to a fixed width; a longer one is an error."""
    missing = F.lit(width) - F.size(values)
    message = F.format_string(f"%d values don't fit a vector of {width}", F.size(values))
    return F.when(missing >= 0, F.concat(values, F.array_repeat(F.lit(0.0), missing))).otherwise(
        F.raise_error(message).cast("array<double>")
    )


def named_vector(names: dict[str, Column]) -> Column:
    """Values as doubles in the given order, 0 when missing."""
    return F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in names.values()])


# Order of the invariant, structure and electronic vectors.
INVARIANTS = ("Z2w_1", "Z2w_2", "Z2w_3", "Z2", "Z4", "Z4pi", "Z8")
CELL = ("a", "b", "c", "alpha", "beta", "gamma")
GAP_POINTS = ("Γ", "M", "Z", "R", "X", "A")



def invariant_vector(z2: Column, higher: Column) -> Column:
    both = F.map_concat(z2, higher)
    return named_vector({n: both[n] for n in INVARIANTS})


def structure_vector(cell: Column, volume: Column, electrons: Column, group: Column) -> Column:
    return named_vector({**{n: cell[n] for n in CELL}, "volume": volume, "electrons": electrons, "group": group})


def electronic_vector(gaps: Column, smallest: Column, soc: Column, fragile: Column, ebr_class: Column) -> Column:
    values = {n: gaps[n] for n in GAP_POINTS}
    return named_vector({**values, "smallest": smallest, "soc": soc.cast("int"), "fragile": fragile, "ebr": ebr_class})


def topology_vector(parts: list[Column], width: int = SUMMARY_WIDTH) -> Column:
    """The whole parts, packed and padded."""
    return pad(F.concat(*parts), width)


def summary_vector(m: DataFrame, width: int = SUMMARY_WIDTH) -> Column:
    """18 numbers of a parsed material, padded; a missing group, class, fragile count or gap is -1."""
    both = F.map_concat("z2_invariants", "higher_order_invariants")
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    minus = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(-1.0))
    values = [zero(both[n]) for n in ("Z2", "Z2w_1", "Z2w_2", "Z2w_3", "Z4", "Z4pi", "Z8")]
    values += [minus(n) for n in ("space_group", "ebr_class", "fragile_bands", "smallest_gap")]
    values += [F.when(F.col("soc_enabled"), 1.0).otherwise(0.0)]
    values += [zero(F.col("lattice_params")[n]) for n in ("a", "b", "c")] + [zero(F.col("volume"))]
    values += [F.size("band_groups").cast("double"), F.size("transitions").cast("double")]
    return pad(F.array(*values), width)


def structure_fallback_vector(width: int = SUMMARY_WIDTH) -> Column:
    """Cell, volume, density, element and atom counts and atomic-number statistics, padded."""
    names = ("a", "b", "c", "alpha", "beta", "gamma", "volume", "density", "n_elements", "n_atoms", "z_mean", "z_std", "z_min", "z_max")
    return pad(F.array(*[F.col(n).cast("double") for n in names]), width)


def combined_vector(*parts: Column) -> Column:
    return F.concat(*parts)


def physics_counts(names: dict[str, Column], indices: dict[str, Column]) -> Column:
    """Counts followed by index values, 0 when missing."""
    return named_vector({**names, **indices})


def multi_hot_positions(facts: DataFrame, keys: list[str], vocabulary: DataFrame, kind: str, value: str) -> DataFrame:
    """Distinct vocabulary positions per key as long rows; a sparse multi-hot vector."""
    return facts.select(*keys, kind, value).distinct().join(vocabulary, [kind, value]).select(*keys, "idx")


def one_hot_sum(values: Column, vocabulary: list[str]) -> Column:
    """Sum of one-hot codes of the values over a given vocabulary."""
    return F.array(*[F.array_contains(values, v).cast("double") for v in vocabulary])
