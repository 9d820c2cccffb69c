"""Classes, labels and ids read out of catalogue text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered keyword rules of the two class schemes.
CLASS_RULES = (
    ("TI", "Topological Insulator"),
    ("SM", "Semimetal"),
    ("WEYL", "Weyl Semimetal"),
    ("DIRAC", "Dirac Semimetal"),
)
CLASS_RULES_SHORT = (
    (("SM", "ESFD"), "SM"),
    (("TI", "NLC"), "TI"),
    (("TRIVIAL", "LCEBR"), "trivial"),
)


def _upper(value) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.upper(F.coalesce(c, F.lit("")))


def binary_label(value) -> Column:
    """1.0 if the text names a topological class, else 0.0."""
    pattern = "|".join(word for word, _ in CLASS_RULES)
    return _upper(value).rlike(pattern).cast("double")


def topological_class(value, label: Column | None = None, matched: Column | None = None) -> Column:
    """First keyword wins; then the numeric label; ``Unknown`` where no catalogue row matched."""
    text = _upper(value)
    (word, name), *rest = CLASS_RULES
    chain = F.when(text.contains(word), name)
    for word, name in rest:
        chain = chain.when(text.contains(word), name)
    if label is not None:
        chain = chain.when(label > 0.5, "Topological")
    chain = chain.otherwise("Trivial")
    return chain if matched is None else F.when(matched, chain).otherwise("Unknown")


def short_class(value) -> Column:
    """SM, TI, trivial or unknown, in that order of precedence."""
    text = _upper(value)
    chain = None
    for words, name in CLASS_RULES_SHORT:
        hit = text.contains(words[0])
        for word in words[1:]:
            hit = hit | text.contains(word)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("unknown")


def leading_integer(value, separator: str = " ") -> Column:
    """The integer before the first separator; NULL if there is none."""
    c = F.col(value) if isinstance(value, str) else value
    return F.substring_index(F.trim(c), separator, 1).try_cast("int")


def group_matches(catalogue_group: Column, computed_group: Column, strict: bool = True) -> Column:
    """An absent or zero catalogue group passes; otherwise both must agree when ``strict``."""
    absent = catalogue_group.isNull() | (catalogue_group == 0)
    return absent | (catalogue_group == computed_group) if strict else F.lit(True)


def is_blank(value) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def safe_name(value) -> Column:
    """Text with every character that is neither letter nor digit replaced by ``_``."""
    c = F.col(value) if isinstance(value, str) else value
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")


def detail_id(url) -> Column:
    """The number after ``detail/`` in a link; NULL without one."""
    c = F.col(url) if isinstance(url, str) else url
    return F.when(c.rlike(r"detail/\d+"), F.regexp_extract(c, r"detail/(\d+)", 1))


def category_text(value) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(c.cast("string"), F.lit("N/A"))


def category_number(value) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(c.cast("double"), F.lit(float("nan")))


def property_structs(
    gap="band_gap", hull="energy_above_hull", formation="formation_energy_per_atom", direct="is_gap_direct",
    cbm="cbm", vbm="vbm",
) -> tuple[Column, Column]:
    """(stability, electronic structure) as structs; ``is_metal`` is NULL where the gap is."""
    stability = F.struct(
        F.col(hull).alias("energy_above_hull"),
        F.col(formation).alias("formation_energy_per_atom"),
        (F.coalesce(F.col(hull), F.lit(0.0)) <= 0.025).alias("is_stable"),
    )
    electronic = F.struct(
        F.col(gap).alias("band_gap"),
        (F.col(gap) == 0).alias("is_metal"),
        F.col(direct).alias("is_gap_direct"),
        F.col(cbm).alias("cbm"),
        F.col(vbm).alias("vbm"),
    )
    return stability, electronic
