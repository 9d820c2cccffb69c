"""Material records: catalogue, candidates, shared graphs and feature vectors in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas, topology as topo
from ..operators import joins as jn
from ..operators import vectors as vec

FALLBACK_GRAPH = "fallback"


def prepared_catalogue(catalogue: DataFrame, ordinal: str) -> DataFrame:
    """One row per normalized formula, the later row wins, with its parsed space group."""
    keyed = catalogue.select(
        formulas.reduced_formula(formulas.element_counts("Formula")).alias("normalized_formula"),
        topo.leading_integer("Space Group").alias("catalogue_group"),
        F.col("Space Group").alias("catalogue_group_text"), "Property", F.col(ordinal).alias("_ordinal"),
    )
    return jn.last_per_key(keyed, ["normalized_formula"], [F.col("_ordinal")]).drop("_ordinal").withColumn("in_catalogue", F.lit(True))


def material_records(
    candidates: DataFrame, catalogue: DataFrame, graphs: DataFrame, ordinal: str, strict_group: bool = False
) -> DataFrame:
    """One record per candidate material.

    ``candidates`` follows schemas.CANDIDATES with ``space_group_number`` resolved, ``graphs``
    holds (space_group_number, graph_path). A candidate without a catalogue row keeps class
    ``Unknown``; with ``strict_group`` one whose catalogue group differs is dropped.
    """
    keyed = candidates.withColumn(
        "normalized_formula", formulas.reduced_formula(formulas.element_counts("formula_pretty"))
    )
    joined = keyed.join(prepared_catalogue(catalogue, ordinal), "normalized_formula", "left")
    joined = joined.where(topo.group_matches(F.col("catalogue_group"), F.col("space_group_number"), strict_group))
    joined = jn.with_default(joined, graphs, ["space_group_number"], {"graph_path": F.lit(FALLBACK_GRAPH)})
    label = topo.binary_label("Property")
    stability, electronic = topo.property_structs()
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    basic = F.array(*[zero(c) for c in ("band_gap", "formation_energy_per_atom", "density", "volume")])
    structural = F.array(*[zero(c) for c in ("space_group_number", "nsites", "total_magnetization", "energy_above_hull")])
    return joined.select(
        F.col("material_id").alias("jid"), F.col("formula_pretty").alias("formula"), "normalized_formula", "space_group_number",
        topo.topological_class("Property", label, F.coalesce("in_catalogue", F.lit(False))).alias("topological_class"),
        label.alias("topological_binary"), "band_gap", F.col("formation_energy_per_atom").alias("formation_energy"),
        zero("energy_above_hull").alias("energy_above_hull"), "density", "volume", "nsites",
        zero("total_magnetization").alias("total_magnetization"),
        F.coalesce("ordering", F.lit("Unknown")).alias("magnetic_type"), "theoretical", stability.alias("stability"),
        electronic.alias("electronic_structure"),
        F.struct("bulk_modulus", "shear_modulus").alias("mechanical_properties"),
        F.create_map(F.lit("Property"), F.col("Property"), F.lit("Space Group"), F.col("catalogue_group_text")).alias("local_database_props"),
        F.create_map(F.lit("kspace_graph"), F.col("graph_path")).alias("file_locations"),
        basic.alias("basic_properties"), structural.alias("structural_properties"),
    )


def with_vectors(records: DataFrame, asph: DataFrame, band_rep: DataFrame) -> DataFrame:
    """Adds the combined vector and the feature sizes; missing parts become empty vectors."""
    empty = F.array().cast("array<double>")
    joined = records.join(asph.select("jid", F.col("v").alias("asph_features")), "jid", "left").join(
        band_rep.select("jid", F.col("v").alias("band_rep_features")), "jid", "left"
    )
    joined = joined.withColumns(
        {c: F.coalesce(c, empty) for c in ("asph_features", "band_rep_features")}
    )
    parts = ("asph_features", "band_rep_features", "basic_properties", "structural_properties")
    combined = joined.withColumn("combined_features", vec.combined_vector(*[F.col(p) for p in parts]))
    names = (*parts, "combined_features")
    sizes = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.size(n) for n in names]))
    return combined.withColumn("vectorized_methods", F.array(*[F.lit(n) for n in names])).withColumn(
        "vectorized_feature_sizes", sizes
    )


def structure_dataset(structures: DataFrame, edges: DataFrame, properties: DataFrame) -> DataFrame:
    """Structures (source_id, formula, num_nodes, num_elements) with graph sizes and the first property row of the same formula."""
    sizes = edges.groupBy("source_id").agg(F.count(F.lit(1)).alias("num_edges"))
    keyed = structures.withColumn("normalized_formula", formulas.reduced_formula(formulas.element_counts("formula")))
    joined = jn.first_match(keyed, properties, ["normalized_formula"], [F.col("ordinal")])
    return joined.join(sizes, "source_id", "left").withColumn(
        "features",
        vec.named_vector({n: F.col(n) for n in ("band_gap", "density", "num_nodes", "num_edges")}),
    )
