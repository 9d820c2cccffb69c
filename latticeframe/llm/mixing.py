"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its documents: whole copies plus a
fraction. Fractions are rounded in pairs: of two documents one takes the other's fraction, or gives it up, at
random, until it is 0 or 1; so expectations hold and totals hardly move. Documents of like size meet first, in small
groups; each group leaves one fraction, and those meet in a reduction tree of (source, size band, part).

Defined results: NULL text has size 0; NULL is a source of its own, after all others; a source without words has
target 0 and no copies; repeated rows are rounded each on its own; an empty table gives no rows. All random numbers are
hashes of the row, so reruns agree, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import SPACES, broadcast_if_small, unit_hash

WEIGHTS = (5, 2, 1)
GROUP = 64
CHUNK = 10_000
TINY = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, target, copies): shares by weight, none above ``most`` times its size.

    The sources at their limit are those with the least limit per weight: with one running sum in that order, each
    source knows the level that would hold if all before it were at their limits.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighted = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at + 1))
    weighted = weighted.withColumn("_limit", most * F.col("source_size")).withColumn("_full", F.col("_limit") / F.col("_w"))
    rising = Window.orderBy("_full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(rising), F.lit(0.0))) / (
        F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(rising), F.lit(0.0))
    )
    level = weighted.withColumn("_level", level)
    # The first level that its own source can take is the one that holds for all.
    open_ = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_level"))).over(every)["_level"]
    target = F.least("_limit", F.coalesce(open_ * F.col("_w"), F.col("_limit")))
    known = level.select("source", "source_size", target.alias("target"))
    return known.withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0))


def _fold(items: Column) -> Column:
    """Pivotal rounding along an array of (size, key.., p, u): the items with ``won`` (1, 0, or -1 for the one left) and its p."""

    def meet(acc: Column, x: Column) -> Column:
        p, q = acc["p"], x["p"]
        total = p + q
        low = total < 1
        # The earlier item goes on with the joint fraction (below 1) or becomes whole (from 1 on).
        first = x["u"] < F.when(low, p / F.greatest(total, F.lit(1e-300))).otherwise((1 - q) / F.greatest(2 - total, F.lit(1e-300)))
        settled = F.when(low == first, x["i"]).otherwise(acc["i"])
        stays = F.when(low == first, acc["i"]).otherwise(x["i"])
        rest = F.when(low, total).otherwise(total - 1)
        return F.struct(
            stays.alias("i"), rest.alias("p"), F.when(low, acc["won"]).otherwise(F.concat(acc["won"], F.array(settled))).alias("won")
        )

    first = F.element_at(items, 1)
    start = F.struct(first["i"].alias("i"), first["p"].alias("p"), F.array().cast("array<int>").alias("won"))
    return F.aggregate(F.slice(items, 2, F.size(items)), start, meet)


def _round_groups(rows: DataFrame, keys: list[Column], level: int, seed: int) -> DataFrame:
    """One level of the tree: each group's rows, with won (1 or 0), or -1 and the fraction on the one that is left."""
    # From the largest document to the smallest, so that what is left in the end is mostly a small one.
    item = F.struct((-F.col("size")).alias("down"), "size", unit_hash(seed, "doc_id", "nth").alias("h"), "doc_id", "nth", "p", unit_hash(seed + 1 + level, "doc_id", "nth").alias("u"), "band", "part")
    grouped = rows.groupBy(F.col("source"), *keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    numbered = F.transform("items", lambda x, i: F.struct(x["p"].alias("p"), x["u"].alias("u"), i.cast("int").alias("i")))
    done = grouped.withColumn("numbered", numbered).withColumn("end", _fold(F.col("numbered")))
    flat = done.select("source", "end", F.posexplode("items").alias("i", "x"))
    whole = F.array_contains("end.won", F.col("i"))
    left = F.col("i") == F.col("end.i")
    rest = F.col("end.p")
    won = F.when(whole, 1).when(~left | (rest < TINY), 0).when(rest > 1 - TINY, 1).otherwise(-1)
    return flat.select("source", "x.doc_id", "x.nth", "x.size", "x.band", "x.part", won.cast("int").alias("won"), F.when(left, rest).alias("p"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, seed: int = 29) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, source, nth (among equal rows), size, source_size, target, copies int."""
    sized = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = cut_lineage(source_targets(sized, weights, most))
    # Equal rows are counted, then numbered in chunks, so that a random number belongs to a row and not to a place.
    equal = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
    equal = equal.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {CHUNK}"))))
    each = equal.withColumn("nth", F.explode(F.sequence(F.col("c") * CHUNK, F.least(F.col("m"), (F.col("c") + 1) * CHUNK) - 1)))
    each = each.withColumn("band", F.floor(F.log2(F.col("size") + 1) * 4).cast("int"))
    crowd = each.groupBy("source", "band").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    crowd = cut_lineage(crowd.join(targets, crowd["source"].eqNullSafe(targets["source"])).select(crowd["source"], "band", "parts", (F.col("copies") - F.floor("copies")).alias("p")))
    placed = each.alias("e").join(crowd.alias("c"), F.col("e.source").eqNullSafe(F.col("c.source")) & (F.col("e.band") == F.col("c.band")))
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "nth"), F.col("parts"))
    rows = placed.select("doc_id", "e.source", "nth", "size", "e.band", part.alias("part"), "p")
    widest = crowd.agg(F.max("parts")).first()[0] or 1
    state = cut_lineage(_round_groups(rows, [F.col("band"), F.col("part")], 0, seed))
    settled, level, reach, span = [state.where("won >= 0")], 1, 1, 1
    while reach < widest or span < 256:
        # Parts of a band first, then neighbouring bands (a band's number stays below 256).
        if reach < widest:
            reach *= GROUP
        else:
            span *= 4
        keys = [F.expr(f"band div {span}").alias("b"), F.expr(f"part div {reach}").alias("q")]
        state = cut_lineage(_round_groups(state.where("won < 0"), keys, level, seed))
        settled.append(state.where("won >= 0"))
        level += 1
    # What one source has left is a single fraction: a coin settles it.
    coin = (unit_hash(seed + 1 + level, F.col("doc_id"), F.col("nth")) < F.col("p")).cast("int")
    settled.append(state.where("won < 0").withColumn("won", coin))
    rounded = settled[0]
    for more in settled[1:]:
        rounded = rounded.unionByName(more)
    full = rounded.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    copies = (F.floor("t.copies") + F.col("won")).cast("int")
    return full.select("doc_id", "r.source", "nth", "size", "source_size", "target", copies.alias("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns as given, whatever their names.

    Rows that agree in doc_id, source and size are told apart by their order over all columns.
    """
    chosen = mix_sources(docs, **options).where("copies > 0")
    chosen = cut_lineage(chosen.select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("size").alias("_size"), F.col("nth").alias("_nth"), F.col("copies").alias("_copies")))
    own = [f"_c{i}" for i in range(len(docs.columns))]
    doc_id, source, text = (F.col(own[docs.columns.index(c)]) for c in ("doc_id", "source", "text"))
    sized = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(docs.columns, own)]).withColumn("_words", word_count(text))
    keys = doc_id.eqNullSafe(F.col("_id")) & source.eqNullSafe(F.col("_src")) & (F.col("_words") == F.col("_size"))
    equal = cut_lineage(chosen.where("_nth > 0").select("_id", "_src", "_size").distinct())
    alone, n = chosen, chosen.count()
    parts = []
    if not equal.isEmpty():
        same = [F.col(f"c.{k}").eqNullSafe(F.col(f"e.{k}")) for k in ("_id", "_src", "_size")]
        held = chosen.alias("c").join(equal.alias("e"), same, "left_semi")
        alone = chosen.alias("c").join(equal.alias("e"), same, "left_anti")
        order = Window.partitionBy(doc_id, source, "_words").orderBy(*own)
        numbered = sized.join(equal, keys, "left_semi").withColumn("_at", F.row_number().over(order) - 1)
        parts.append(numbered.join(held, keys & (F.col("_at") == F.col("_nth"))).select(*own, "_copies"))
    parts.append(sized.join(broadcast_if_small(alone, n), keys).select(*own, "_copies"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    taken = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return taken.select(*[F.col(a).alias(c) for a, c in zip(own, docs.columns)])
