"""Material detail text to one nested row, by column expressions over the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import last_value_map, let
from .labels import trimmed

# Names and patterns of the detail text.
PAIR = r"([A-Za-z0-9π,]+)\s*=\s*(\d+)"
Z2_NAMES = ("Z2w_1", "Z2w_2", "Z2w_3", "Z2")
HIGHER_NAMES = ("Z4", "Z4pi", "Z8")
K_NAMES = "ΓΜMΖZRXAΥYΣ"  # Greek and Latin capitals that look alike
DEFAULT_K = ("Γ", "M", "Z", "R", "X", "A")
CELL_PATTERNS = {
    "a": (r"(?i)Cell Length A\s*([\d.]+)", r"(?i)a\s*=\s*([\d.]+)"),
    "b": (r"(?i)Cell Length B\s*([\d.]+)", r"(?i)b\s*=\s*([\d.]+)"),
    "c": (r"(?i)Cell Length C\s*([\d.]+)", r"(?i)c\s*=\s*([\d.]+)"),
    "alpha": (r"(?i)Cell Angle alpha\s*([\d.]+)", r"(?iu)Cell Angle α\s*([\d.]+)", r"(?i)alpha\s*=\s*([\d.]+)"),
    "beta": (r"(?i)Cell Angle beta\s*([\d.]+)", r"(?iu)Cell Angle β\s*([\d.]+)", r"(?i)beta\s*=\s*([\d.]+)"),
    "gamma": (r"(?i)Cell Angle gamma\s*([\d.]+)", r"(?iu)Cell Angle γ\s*([\d.]+)", r"(?i)gamma\s*=\s*([\d.]+)"),
}
SPACE_GROUP_PATTERNS = (
    r"(?i)(?:Symmetry Group:|\s)\s*(\d+)\s*\(([^)]+)\)",
    r"(?i)Symmetry Group\s+(\d+)\s*\(\*+([^*]+)\*+\)",
    r"(?m)^\s*(\d+)\s+\(([^)]+)\)",
)
STATUS = r"(?i)Topological Status(?:[^:]*):\s*([^(]+)\s*\(([^)]+)\)"
BAND_SECTION = (
    r"(?is)(Nr\. Bands\s+Subclass\s+Γ\s+M\s+Z\s+R\s+X\s+A.*?)"
    r"(?:\n\n|Transitions upon symmetry lowering|Minimal subgroups are highlighted)"
)
TRANSITION_START = r"^(\d+)\s*\(([^)]+)\)"


def _find(text: Column, *patterns: str, group: int = 1) -> Column:
    """First group of the first pattern that matches; NULL without a match."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def formula(text: Column) -> Column:
    """First line of letters, digits and blanks only that is no header; stars around it are dropped."""
    lines = F.transform(F.split(text, r"\n"), lambda s: F.regexp_replace(s, r"^[\s*]+|[\s*]+$", ""))
    fits = lambda s: (
        s.rlike(r"^[A-Za-z0-9\s]+$") & ~F.lower(s).rlike(r"^(symmetry group:|topological status:|icsd:)")
    )
    return F.coalesce(F.get(F.filter(lines, fits), F.lit(0)), F.lit("UnknownFormula"))


def space_group(text: Column) -> Column:
    """(number, symbol) by the first of three patterns; stars in the symbol are dropped."""
    return F.struct(
        _find(text, *SPACE_GROUP_PATTERNS).try_cast("int").alias("number"),
        F.replace(trimmed(_find(text, *SPACE_GROUP_PATTERNS, group=2)), F.lit("*"), F.lit("")).alias("symbol"),
    )


def status(text: Column) -> Column:
    return F.struct(trimmed(_find(text, STATUS)).alias("type"), trimmed(_find(text, STATUS, group=2)).alias("subtype"))


def named_integers(text: Column) -> Column:
    """``name = integer`` pairs as a map; the last of a repeated name wins, ``Z2w,1`` reads as ``Z2w_1``."""
    names = F.transform(
        F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)),
        lambda n: F.regexp_replace(F.replace(n, F.lit("Z4π"), F.lit("Z4pi")), r"^Z2w,", "Z2w_"),
    )
    values = F.transform(F.regexp_extract_all(text, F.lit(PAIR), F.lit(2)), lambda v: v.cast("int"))
    pairs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.alias("value")))

    return last_value_map(pairs, "name", "value")


def invariants(text: Column) -> tuple[Column, Column]:
    """(Z2 map, higher-order map) from the index section, or from the whole text without one."""
    section = F.coalesce(_find(text, r"(?is)Topological indices:(.*?)(?:$|\n[A-Z])"), text)
    pairs = named_integers(section)
    return (
        F.map_filter(pairs, lambda k, _: k.isin(*Z2_NAMES)),
        F.map_filter(pairs, lambda k, _: k.isin(*HIGHER_NAMES)),
    )


def lattice_parameters(text: Column) -> Column:
    """Cell values by name; a value that no pattern finds is left out."""
    values = [(name, _find(text, *patterns).try_cast("double")) for name, patterns in CELL_PATTERNS.items()]
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in values])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def gaps(text: Column) -> Column:
    """Gap per k-point from the gap section; empty without one."""
    section = F.coalesce(
        _find(
            text,
            r"(?is)Gaps at high-symmetry points.*?:(.*?)(?:Smallest Computed Gap|Nr Fragile Bands|EBR equivalence class|---)",
        ),
        F.lit(""),
    )
    pattern = F.lit(rf"([{K_NAMES}])\s*[:\s-]?\s*([\d.-]+)")
    names = F.regexp_extract_all(section, pattern, F.lit(1))
    values = F.transform(F.regexp_extract_all(section, pattern, F.lit(2)), lambda v: v.try_cast("double"))
    pairs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    return last_value_map(F.filter(pairs, lambda p: p["value"].isNotNull()), "name", "value")


def band_groups(text: Column) -> Column:
    """Band table rows: number of bands, subclass, and irrep with degeneracy per k-point.

    Rows that do not start with an integer are skipped; ``-`` is an empty cell; a
    label without ``(d)`` has a NULL degeneracy.
    """
    section = F.coalesce(_find(text, BAND_SECTION), F.lit(""))
    lines = F.transform(F.split(trimmed(section), r"\n"), trimmed)

    def rows(all_lines: Column) -> Column:
        # The header names come from the fixed pattern above.
        names = F.array(*[F.lit(k) for k in DEFAULT_K])
        # Cells past the last k-point stay joined to it, as the split is bounded.
        split = lambda s: F.split(s, r"\s+", len(DEFAULT_K) + 2)

        def rep(name: Column, word: Column) -> Column:
            pattern = r"^(\S+?)\s*\((\d+)\)"
            hit = word.rlike(pattern)
            return F.struct(
                name.alias("k_point"),
                F.when(hit, F.regexp_extract(word, pattern, 1)).otherwise(trimmed(word)).alias("irrep_label"),
                F.when(hit, F.regexp_extract(word, pattern, 2).try_cast("int")).alias("degeneracy"),
            )

        def group(s: Column) -> Column:
            return let(
                split(s),
                lambda w: F.struct(
                    w[0].try_cast("int").alias("num_bands"),
                    F.get(w, F.lit(1)).alias("subclass"),
                    F.filter(
                        F.zip_with(names, F.slice(w, 3, len(DEFAULT_K)), rep),
                        lambda r: r["irrep_label"].isNotNull() & ~r["irrep_label"].isin("", "-"),
                    ).alias("reps"),
                ),
            )

        body = F.slice(all_lines, 2, F.greatest(F.size(all_lines), F.lit(1)))
        return F.filter(F.transform(body, group), lambda g: g["num_bands"].isNotNull() & g["subclass"].isNotNull())

    return let(lines, rows)


def transitions(text: Column) -> Column:
    """Symmetry-lowering rows: ``n (symbol)`` starts one; later lines add indices, or one note."""
    section = F.coalesce(
        _find(text, r"(?is)Transitions upon symmetry lowering(.*?)(?:EBR equivalence class|Minimal subgroups are highlighted|$)"),
        F.lit(""),
    )
    lines = F.filter(
        F.transform(F.split(section, r"\n"), trimmed), lambda s: (s != "") & ~s.rlike("(?i)^(symmetry group|---)")
    )

    def blocks(all_lines: Column) -> Column:
        starts = F.filter(
            F.transform(all_lines, lambda s, i: F.when(s.rlike(TRANSITION_START), i + 1)), lambda i: i.isNotNull()
        )
        ends = lambda starts: F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(all_lines) + 1))

        def block(start: Column, end: Column) -> Column:
            first = F.element_at(all_lines, start)
            rest = F.slice(all_lines, start + 1, end - start - 1)
            body = F.concat_ws("\n", F.regexp_replace(first, TRANSITION_START, ""), F.array_join(rest, "\n"))
            notes = F.filter(rest, lambda s: ~s.rlike(PAIR))
            return F.struct(
                F.regexp_extract(first, TRANSITION_START, 1).try_cast("int").alias("target_number"),
                trimmed(F.regexp_extract(first, TRANSITION_START, 2)).alias("target_symbol"),
                named_integers(body).alias("indices"),
                F.get(notes, F.lit(0)).alias("info"),
            )

        return let(starts, lambda at: F.when(F.size(at) > 0, F.zip_with(at, ends(at), block)))

    empty = F.array().cast("array<struct<target_number:int,target_symbol:string,indices:map<string,int>,info:string>>")
    return F.coalesce(let(lines, blocks), empty)


def parse_details(df: DataFrame, key: str, text: str) -> DataFrame:
    """Detail texts to the parsed-material schema, one row each."""
    c = F.col(text)
    z2, higher = invariants(c)
    group, state = space_group(c), status(c)
    integer = lambda pattern: _find(c, pattern).try_cast("int")
    number = lambda pattern: _find(c, pattern).try_cast("double")
    return df.select(
        F.col(key).cast("string").alias("material_id"), formula(c).alias("formula"),
        _find(c, r"(?i)ICSD:\s*(\d+)").alias("icsd_id"),
        group["number"].alias("space_group"), group["symbol"].alias("space_group_symbol"),
        lattice_parameters(c).alias("lattice_params"), number(r"(?i)Cell Volume\s*([\d.]+)").alias("volume"),
        integer(r"(?i)Nr of valence electrons:\s*(\d+)").alias("valence_electrons"),
        state["type"].alias("topological_type"), state["subtype"].alias("topological_subtype"),
        z2.alias("z2_invariants"), higher.alias("higher_order_invariants"), gaps(c).alias("band_gaps"),
        number(r"(?i)Smallest Computed Gap\s*([\d.-]+)").alias("smallest_gap"),
        (F.lower(_find(c, r"(?i)With SOC:\s*(Yes|No)")) == "yes").alias("soc_enabled"),
        band_groups(c).alias("band_groups"),
        integer(r"(?i)Nr Fragile Bands\s*(\d+)").alias("fragile_bands"),
        integer(r"(?i)EBR equivalence class\s*(\d+)").alias("ebr_class"), transitions(c).alias("transitions"),
    )
