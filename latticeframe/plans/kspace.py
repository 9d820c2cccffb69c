"""K-space graphs for all space groups in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import graphs as gr
from ..operators import vectors as vec
from ..session import cut_lineage


@dataclass(frozen=True)
class KspaceGraphs:
    vertices: DataFrame
    edges: DataFrame
    meta: DataFrame
    physics: DataFrame


def kspace_graphs(facts: DataFrame, graph: str = "space_group_number") -> KspaceGraphs:
    """Vertices, edges, sizes and physics counts, keyed by group; groups without rows do not occur.

    ``facts`` holds k_point, irrep_label and what else the join gave: energy, band_index,
    decomposition_index, branch irreps, ebr_label, wyckoff_letter, site_symmetry, index columns.
    """
    keys = [graph]
    # Vertices and members are as small as the k-point and irrep domains and feed every kind of
    # edge, so the facts are read twice here instead of once per edge kind.
    nodes = cut_lineage(gr.vertices(facts, keys))
    labelled = facts.select(
        graph, F.col("k_point").alias("key"), *[c for c in ("irrep_label", "decomposition_index") if c in facts.columns]
    )
    members = cut_lineage(labelled.distinct().join(nodes.select(graph, "key", "idx"), [graph, "key"]))
    wide = lambda e: e.select(*[
        F.col(c) if c in e.columns else F.lit(None).cast(t).alias(c)
        for c, t in (
            (graph, "int"), ("kind", "string"), ("shared", "string"), ("src", "long"), ("dst", "long"), ("weight", "double"),
            ("members", "long"),
        )
    ])
    mean = nodes.withColumn("mean", F.col("features")[0])
    edges = wide(gr.path_edges(mean, keys, "mean" if "energy" in facts.columns else None))
    if "irrep_label" in facts.columns:
        edges = edges.unionByName(wide(gr.clique_edges(members, keys, "irrep_label", gr.SYMMETRY_WEIGHT, "symmetry")))
    if "decomposition_index" in facts.columns and {"branch1_irreps", "branch2_irreps"} & set(facts.columns):
        edges = edges.unionByName(
            wide(gr.clique_edges(members, keys, "decomposition_index", gr.DECOMPOSITION_WEIGHT, "decomposition"))
        )
    # The edges decide which graphs need the fallback chain and are counted afterwards.
    edges = cut_lineage(edges)
    edges = edges.unionByName(wide(gr.chain_fallback(nodes, edges, keys)))
    return KspaceGraphs(nodes, edges, gr.graph_meta(nodes, edges, keys), physics_vectors(facts, keys))


PHYSICS_COUNTS = ("ebr_label", "irrep_label", "wyckoff_letter", "site_symmetry")
PHYSICS_INDICES = ("z2_0", "z2_1", "z2_2", "z2_3", "chern_number")


def physics_vectors(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct counts, five indices with default 0 and two decomposition counts per group."""
    counted = facts.groupBy(*keys).agg(
        *[(F.count_distinct(c) if c in facts.columns else F.lit(0)).cast("long").alias(f"n_{c}") for c in PHYSICS_COUNTS],
        *[
            (F.count_distinct(c) if c in facts.columns else F.lit(0)).cast("long").alias(f"n_{c}")
            for c in ("decomposition_index", "band_index")
        ],
    )
    indices = agg.index_consensus(facts.select(*keys, *[c for c in PHYSICS_INDICES if c in facts.columns]), keys)
    joined = counted.join(indices, keys, "left")
    values = {f"n_{c}": F.col(f"n_{c}") for c in PHYSICS_COUNTS}
    values |= {c: F.col(c) if c in joined.columns else F.lit(None).cast("double") for c in PHYSICS_INDICES}
    values |= {f"n_{c}": F.col(f"n_{c}") for c in ("decomposition_index", "band_index")}
    return joined.select(*keys, vec.named_vector(values).alias("physics"))
