"""Fixed schemas of the stored tables, as Spark DDL text; ``schema`` gives the type of one."""

from pyspark.sql.types import StructType


SPACE_GROUPS = "id BIGINT, number INT, created_at TIMESTAMP, updated_at TIMESTAMP"
MAGNETIC_SPACE_GROUPS = "bns_number STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
EBRS = (
    "id BIGINT, space_group_id BIGINT, wyckoff_letter STRING, site_symmetry STRING, orbital_label STRING, "
    "orbital_multiplicity INT, notes STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
IRREPS = "id BIGINT, space_group_id BIGINT, ebr_id BIGINT, k_point STRING, irrep_label STRING, multiplicity INT"
DECOMPOSITION_ITEMS = (
    "id BIGINT, space_group_id BIGINT, ebr_id BIGINT, decomposition_index INT, branch_index INT, irreps_string STRING"
)
DECOMPOSITION_EBRS = "id BIGINT, space_group_id BIGINT, parent_ebr_id BIGINT, decomposes_into STRING"
DECOMPOSITION_BRANCHES = "ebr_id BIGINT, decomposition_index INT, branch1_irreps STRING, branch2_irreps STRING"
TOPOLOGICAL_INDICES = (
    "id BIGINT, space_group_id STRING, space_group_symbol STRING, index_name STRING, mod_value INT, created_at TIMESTAMP"
)
IRREP_VALUES = "id BIGINT, topo_index_id BIGINT, irrep_name STRING, value STRING"
CATALOGUE = (
    "`Formula` STRING, `Space Group` STRING, `Property` STRING, `ICSD_ID` BIGINT, `POSCAR_link` STRING, "
    "`MatProject_link` STRING"
)
BULK_PROPERTIES = (
    "jid STRING, formula STRING, spg_number INT, spg_symbol STRING, optb88vdw_bandgap DOUBLE, mbj_bandgap DOUBLE, "
    "formation_energy_peratom DOUBLE, kv DOUBLE, gv DOUBLE, n_electrons DOUBLE, n_dos DOUBLE, magmom_oszicar DOUBLE, "
    "epsilon_x DOUBLE, epsilon_y DOUBLE, epsilon_z DOUBLE, density DOUBLE"
)
_MODULUS = "STRUCT<voigt: DOUBLE, reuss: DOUBLE, vrh: DOUBLE>"
CANDIDATES = (
    "material_id STRING, formula_pretty STRING, symmetry STRUCT<number: INT, symbol: STRING>, "
    "lattice ARRAY<ARRAY<DOUBLE>>, species ARRAY<STRING>, frac_coords ARRAY<ARRAY<DOUBLE>>, band_gap DOUBLE, "
    "formation_energy_per_atom DOUBLE, energy_above_hull DOUBLE, density DOUBLE, volume DOUBLE, nsites INT, "
    "total_magnetization DOUBLE, ordering STRING, theoretical BOOLEAN, is_gap_direct BOOLEAN, cbm DOUBLE, vbm DOUBLE, "
    f"bulk_modulus {_MODULUS}, shear_modulus {_MODULUS}"
)
MATERIAL = (
    "material_id STRING, formula STRING, icsd_id STRING, space_group INT, space_group_symbol STRING, "
    "lattice_params MAP<STRING, DOUBLE>, volume DOUBLE, valence_electrons INT, topological_type STRING, "
    "topological_subtype STRING, z2_invariants MAP<STRING, INT>, higher_order_invariants MAP<STRING, INT>, "
    "band_gaps MAP<STRING, DOUBLE>, smallest_gap DOUBLE, soc_enabled BOOLEAN, "
    "band_groups ARRAY<STRUCT<num_bands: INT, subclass: STRING, "
    "reps: ARRAY<STRUCT<k_point: STRING, irrep_label: STRING, degeneracy: INT>>>>, "
    "fragile_bands INT, ebr_class INT, transitions ARRAY<STRUCT<target_number: INT, target_symbol: STRING, "
    "indices: MAP<STRING, INT>, info: STRING>>"
)
MATERIAL_METADATA = (
    "jid STRING, formula STRING, normalized_formula STRING, space_group STRING, space_group_number INT, "
    "topological_class STRING, topological_binary DOUBLE, band_gap DOUBLE, formation_energy DOUBLE, "
    "energy_above_hull DOUBLE, density DOUBLE, volume DOUBLE, nsites INT, total_magnetization DOUBLE, "
    "magnetic_type STRING, theoretical BOOLEAN, "
    "stability STRUCT<energy_above_hull: DOUBLE, formation_energy_per_atom: DOUBLE, is_stable: BOOLEAN>, "
    "electronic_structure STRUCT<band_gap: DOUBLE, is_metal: BOOLEAN, is_gap_direct: BOOLEAN, cbm: DOUBLE, vbm: DOUBLE>, "
    f"mechanical_properties STRUCT<bulk_modulus: {_MODULUS}, shear_modulus: {_MODULUS}>, "
    "processing_timestamp TIMESTAMP, local_database_props MAP<STRING, STRING>, num_atoms INT, "
    "file_locations MAP<STRING, STRING>, vectorized_methods ARRAY<STRING>, vectorized_feature_sizes MAP<STRING, INT>"
)
VERTICES = "graph_id STRING, idx INT, key STRING, features ARRAY<DOUBLE>"
EDGES = "graph_id STRING, src INT, dst INT, kind STRING, weight DOUBLE"
VECTORS = "material_id STRING, method STRING, v ARRAY<DOUBLE>"

# Natural keys and references, checked by maintenance.duplicate_keys and maintenance.orphans.
KEYS = {
    "space_groups": ["number"],
    "magnetic_space_groups": ["bns_number"],
    "ebrs": ["id"],
    "topological_indices": ["space_group_id", "index_name"],
}
REFERENCES = {
    ("ebrs", "space_group_id"): ("space_groups", "id"),
    ("irreps", "ebr_id"): ("ebrs", "id"),
    ("ebr_decomposition_items", "ebr_id"): ("ebrs", "id"),
    ("irrep_values", "topo_index_id"): ("topological_indices", "id"),
}


def schema(ddl: str) -> StructType:
    """The type of one of the texts above; needs a running session."""
    return StructType.fromDDL(ddl)
