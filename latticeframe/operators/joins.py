"""Joins of the data model. All are equi joins; nothing is broadcast by hint, so Spark and AQE size each side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import first_per_key, last_per_key


def kspace_rows(irreps: DataFrame, ebrs: DataFrame, space_groups: DataFrame, branches: DataFrame) -> DataFrame:
    """Irrep rows with EBR, group and branch columns for every group at once; branches multiply rows."""
    return (
        irreps.drop("space_group_id")
        .join(ebrs.drop("created_at", "updated_at").withColumnRenamed("id", "ebr_id"), "ebr_id")
        .join(space_groups.select(F.col("id").alias("space_group_id"), F.col("number").alias("space_group_number")), "space_group_id")
        .join(branches, "ebr_id", "left")
    )


def ebrs_of_groups(ebrs: DataFrame, space_groups: DataFrame) -> DataFrame:
    groups = space_groups.select(F.col("id").alias("space_group_id"), "number")
    return ebrs.join(groups, "space_group_id")


def index_with_irreps(indices: DataFrame, values: DataFrame) -> DataFrame:
    """One row per topological index with a name to value map; an index without values keeps an empty map.

    A name occurs once per index, so the map is bounded by the irrep vocabulary;
    repeated names are reduced before anything is gathered.
    """
    single = values.groupBy("topo_index_id", "irrep_name").agg(F.max("value").alias("value"))
    maps = single.groupBy("topo_index_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("irrep_name", "value")))).alias("irreps")
    )
    empty = F.create_map().cast("map<string,string>")
    joined = indices.join(maps.withColumnRenamed("topo_index_id", "id"), "id", "left")
    return joined.withColumn("irreps", F.coalesce("irreps", empty))


def last_wins(facts: DataFrame, lookup: DataFrame, key: list[str], ordinal: Column, how: str = "inner") -> DataFrame:
    """Join to the lookup row with the largest ordinal per key."""
    return facts.join(last_per_key(lookup, key, [ordinal]), key, how)


def first_match(facts: DataFrame, lookup: DataFrame, key: list[str], order: list[Column], flag: str = "matched") -> DataFrame:
    """Join to the first lookup row per key and say whether there was one."""
    first = first_per_key(lookup, key, order).withColumn(flag, F.lit(True))
    return facts.join(first, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def candidates_with_group(candidates: DataFrame, computed: str | None = None) -> DataFrame:
    """Candidate group from the symmetry struct, else the plain column, else the computed one."""
    sources = [F.col("symmetry.number")]
    for name in ("space_group_number", computed):
        if name and name in candidates.columns:
            sources.append(F.col(name))
    return candidates.withColumn("space_group_number", F.coalesce(*sources))


def with_default(facts: DataFrame, lookup: DataFrame, key: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Left join with a replacement for each missing value."""
    joined = facts.join(lookup, key, "left")
    for name, value in defaults.items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), value))
    return joined


MARKER = "POSCAR"
# Longest n-gram of the index of file names.
GRAM = 8


def ranked_file_match(materials: DataFrame, files: DataFrame) -> DataFrame:
    """Best structure file per material, by the priority of five name patterns, flat before nested.

    ``files`` holds (path, base, depth). A term is the material's id or formula and may stand anywhere in a name. Names are
    indexed by their n-grams of the lengths that terms end in (at most ``GRAM``); a term meets the names that hold its last n-gram,
    and only those are checked against the patterns. The best file of a term is picked before materials meet terms.
    NULL and empty terms match nothing.
    """
    terms = materials.select(
        "material_id",
        F.explode(F.array(F.struct(F.col("material_id").alias("term"), F.lit(True).alias("is_id")),
                          F.struct(F.col("formula").alias("term"), F.lit(False).alias("is_id")))).alias("k"),
    ).select("material_id", "k.*").where(F.length("term") > 0)
    distinct = terms.select("term", "is_id").distinct().withColumn("gram", F.right("term", F.lit(GRAM)))
    # At most GRAM lengths.
    lengths = [r[0] for r in distinct.select(F.length("gram")).distinct().collect()]
    if not lengths:
        lengths = [GRAM]
    # Of files of one name the flattest, first path is the best for any term, so a name stands in the index once. Its rows
    # hold the hash of a gram and the name alone: the patterns are checked on the name, so grams of equal hashes do no harm.
    flat = F.least(F.col("depth"), F.lit(1)).alias("flat")
    named = cut_lineage(files.where(F.contains("base", F.lit(MARKER))).groupBy("base").agg(F.min(F.struct(flat, "path", "depth")).alias("file")))
    grams = F.array_distinct(F.transform(F.concat(*[_grams("base", n) for n in lengths]), lambda g: F.xxhash64(g)))
    # A plan takes exploded rows for as many as there were before, and would broadcast the index of a small file: the join is a merge.
    index = named.select("base", F.explode(grams).alias("gram")).hint("merge")
    asked = distinct.withColumn("gram", F.xxhash64("gram"))
    hits = index.join(asked, "gram").withColumn("pattern_rank", _pattern_rank()).where(F.col("pattern_rank").isNotNull())
    placed = hits.select("term", "is_id", "base", "pattern_rank").join(named, "base")
    found = F.struct("file.flat", "pattern_rank", "file.path", "file.depth").alias("hit")
    best = placed.select("term", "is_id", found).groupBy("term", "is_id").agg(F.min("hit").alias("hit"))
    met = terms.join(best, ["term", "is_id"]).groupBy("material_id").agg(F.min("hit").alias("hit"))
    return met.select("material_id", "hit.path", "hit.depth", "hit.pattern_rank")


def _grams(column: str, n: int) -> Column:
    """All substrings of n characters."""
    found = F.transform(F.sequence(F.lit(1), F.length(column) - n + 1), lambda i: F.substr(column, i, F.lit(n)))
    return F.when(F.length(column) >= n, found).otherwise(F.array().cast("array<string>"))


def _pattern_rank() -> Column:
    """Which of the five patterns the name ``base`` fits for ``term``: 0 to 4, NULL for none."""
    inside = lambda word, start: F.expr(f"locate({word}, base, {start})")
    first = inside("term", 1)
    marked = (first > 0) & (inside(f"'{MARKER}'", "locate(term, base, 1) + length(term)") > 0)
    trailing = F.startswith("base", F.lit(MARKER)) & (inside("term", len(MARKER) + 1) > 0)
    return (
        F.when(marked & F.col("is_id") & (first == 1), 0).when(marked & F.col("is_id"), 1).when(marked, 2)
        .when(trailing & F.col("is_id"), 3).when(trailing, 4)
    )


def missing_numbers(table: DataFrame, column: str, last: int = 230) -> DataFrame:
    """Numbers 1..last that the table does not hold."""
    wanted = table.sparkSession.range(1, last + 1).select(F.col("id").cast("int").alias("number"))
    held = table.select(F.col(column).cast("int").alias("number")).distinct()
    return wanted.join(held, "number", "left_anti")
