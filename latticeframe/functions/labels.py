"""Text forms of band representations: Wyckoff cells, orbitals, irreps and k rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text patterns of the source pages.
WYCKOFF = r"^(\d+\w)\(([^)]+)\)$"
ORBITAL = r"^(.+)\((\d+)\)$"
TRAILING_COUNT = r"\((\d+)\)$"
IRREP_UNIT = r"[A-ZΓa-z0-9+\-↑↓]+?\([^\)]+\)"
COMPONENT = rf"(?:\d+\s+{IRREP_UNIT}|{IRREP_UNIT})"
CELL = rf"{COMPONENT}(?:\s*⊕\s*{COMPONENT})*|-|\S+"
BNS_LINE = r"BNS:\s*([\d.]+)"
BARE_NUMBER = r"^\s*([\d.]+)\s*$"


# What ``\s`` stands for.
SPACES = " \t\n\x0b\f\r"


def trimmed(c: Column) -> Column:
    """The text without white space around it."""
    return F.btrim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    """Words of a text; an empty one has one empty word. Runs are replaced first, as ``split`` compiles a pattern per call but for one character."""
    return F.split(F.regexp_replace(trimmed(c), r"\s+", " "), " ")


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def match_or_null(value, pattern: str, group: int = 1) -> Column:
    """The group of the first match, NULL without a match."""
    c = _col(value)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def wyckoff(value) -> Column:
    """``2a(4/mm)`` to (letter ``2a``, site symmetry ``4/mm``); other text keeps an empty symmetry."""
    c = _col(value)
    hit = c.rlike(WYCKOFF)
    return F.struct(
        F.when(hit, F.regexp_extract(c, WYCKOFF, 1)).otherwise(c).alias("wyckoff_letter"),
        F.when(hit, F.regexp_extract(c, WYCKOFF, 2)).otherwise(F.lit("")).alias("site_symmetry"),
    )


def orbital(value) -> Column:
    """``A1↑G(2)`` to (label, 2); the multiplicity defaults to 1."""
    c = _col(value)
    hit = c.rlike(ORBITAL)
    return F.struct(
        F.when(hit, F.regexp_extract(c, ORBITAL, 1)).otherwise(c).alias("orbital_label"),
        F.when(hit, F.regexp_extract(c, ORBITAL, 2).cast("int")).otherwise(1).alias("orbital_multiplicity"),
    )


def multiplicity(value) -> Column:
    """The trailing ``(d)`` as an integer, else NULL."""
    return match_or_null(value, TRAILING_COUNT).cast("int")


def irrep_label(value) -> Column:
    """The text without its trailing ``(d)``."""
    c = _col(value)
    return F.when(c.rlike(ORBITAL), F.regexp_extract(c, ORBITAL, 1)).otherwise(c)


def kpoint_cells(value) -> Column:
    """The cells of one k row; components joined by ⊕ stay in one cell."""
    return F.regexp_extract_all(_col(value), F.lit(CELL), F.lit(0))


def irrep_dimension(value) -> Column:
    """Total dimension of a comma list: leading count (default 1) times trailing ``(d)`` (default 1)."""
    c = _col(value)

    def part(text: Column) -> Column:
        trimmed = F.trim(text)
        lead = F.coalesce(match_or_null(trimmed, r"^(\d+)\s+").cast("long"), F.lit(1).cast("long"))
        size = F.coalesce(multiplicity(trimmed).cast("long"), F.lit(1).cast("long"))
        return lead * size

    total = F.aggregate(F.transform(F.split(c, ","), part), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(0).cast("long")).otherwise(total)


def bns_number(line, bare: bool = True) -> Column:
    """The BNS number of a line; a bare number counts when ``bare``. NULL otherwise."""
    tagged = match_or_null(line, BNS_LINE)
    return F.coalesce(tagged, match_or_null(line, BARE_NUMBER)) if bare else tagged


def kpoint_coordinates(value) -> Column:
    """``(x,y,z)`` or ``x y z`` to three numbers; two numbers get a zero, anything else is NULL."""
    c = _col(value)
    inner = F.regexp_replace(c, r"[()\[\],]", " ")
    numbers = F.transform(F.regexp_extract_all(inner, F.lit(r"\S+"), F.lit(0)), lambda x: x.try_cast("double"))
    valid = F.forall(numbers, lambda x: x.isNotNull())
    return (
        F.when(valid & (F.size(numbers) == 3), numbers)
        .when(valid & (F.size(numbers) == 2), F.concat(numbers, F.array(F.lit(0.0))))
    )
