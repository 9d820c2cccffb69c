"""Predicates over materials: invariant patterns, band features, record checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headings that a band-representation text must hold.
REQUIRED_SECTIONS = ("Wyckoff pos.", "Band-Rep.", "Decomposable")
# Fields that a finished record must hold.
REQUIRED_FIELDS = (
    "jid", "formula", "normalized_formula", "space_group_number", "topological_label", "asph_features",
    "band_rep_features", "crystal_graph", "kspace_graph", "local_topo_data",
)


def pattern_match(values: dict[str, Column], pattern: dict[str, object], match_all: bool = True) -> Column:
    """Whether all (or any) named values equal the pattern; a missing value never matches."""
    tests = [F.coalesce(values[n] == F.lit(v), F.lit(False)) if n in values else F.lit(False) for n, v in pattern.items()]
    if not tests:
        return F.lit(match_all)
    return reduce((lambda a, b: a & b) if match_all else (lambda a, b: a | b), tests)


def invariant_pattern(material: DataFrame, pattern: dict[str, int], match_all: bool = True) -> DataFrame:
    """Materials whose invariant maps fit the pattern."""
    names = F.map_concat("z2_invariants", "higher_order_invariants")
    return material.where(pattern_match({n: names[n] for n in pattern}, pattern, match_all))


def has_band_group(
    groups: Column,
    num_bands: int | None = None,
    subclass: str | None = None,
    irrep: tuple[str, str] | None = None,
    min_degeneracy: int | None = None,
) -> Column:
    """Whether one band group meets every given condition; ``irrep`` is (k-point, label)."""

    def fits(group: Column) -> Column:
        ok = F.lit(True)
        if num_bands is not None:
            ok = ok & (group["num_bands"] == num_bands)
        if subclass is not None:
            ok = ok & (group["subclass"] == subclass)
        if irrep is not None:
            k_point, label = irrep

            def rep_fits(rep: Column) -> Column:
                hit = (rep["irrep_label"] == label) & (rep["k_point"] == k_point)
                if min_degeneracy is not None:
                    hit = hit & F.coalesce(rep["degeneracy"] >= min_degeneracy, F.lit(False))
                return hit

            ok = ok & F.exists(group["reps"], rep_fits)
        return F.coalesce(ok, F.lit(False))

    return F.exists(groups, fits)


def missing_sections(text: Column, sections=REQUIRED_SECTIONS) -> Column:
    """The required headings that the text lacks, in order."""
    return F.filter(F.array(*[F.lit(s) for s in sections]), lambda s: ~F.contains(text, s))


def record_problems(df: DataFrame, required=REQUIRED_FIELDS, vectors=(), present=()) -> Column:
    """Reasons why a record is not complete; empty for a valid record."""
    reasons = []
    for name in required:
        if name not in df.columns:
            reasons.append(F.lit(f"missing {name}"))
        elif name in vectors:
            reasons.append(F.when(F.coalesce(F.size(name), F.lit(0)) <= 0, f"empty {name}"))
        elif name in present:
            reasons.append(F.when(F.col(name).isNull(), f"null {name}"))
    return F.array_compact(F.array(*reasons))


def drop_null_properties(properties: Column) -> Column:
    return F.map_filter(properties, lambda _, v: v.isNotNull())
