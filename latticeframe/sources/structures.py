"""Structures from mixed encodings: JSON objects, structure text, or raw arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.arrays import let

# Keys tried in this order.
STRUCTURE_ENCODINGS = ("atoms", "structure", "final_str", "initial_structure")
JSON_STRUCTURE = "lattice array<array<double>>, coords array<array<double>>, elements array<string>, cartesian boolean"


def _words(line: Column) -> Column:
    return F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")


def _numbers(line: Column) -> Column:
    return F.transform(F.slice(_words(line), 1, 3), lambda w: w.try_cast("double"))


def _finish(source: str, lattice: Column, coords: Column, elements: Column, cartesian: Column) -> Column:
    frac = let(
        geometry.inverse(lattice), lambda m: F.transform(coords, lambda v: geometry.row_times_matrix(v, m))
    )
    return F.struct(
        F.lit(source).alias("source"), lattice.alias("lattice"),
        F.when(F.coalesce(cartesian, F.lit(False)), frac).otherwise(coords).alias("frac"), elements.alias("elements"),
    )


def from_json_text(text: Column) -> Column:
    """A structure object; NULL when the text is no such object."""
    parsed = F.from_json(text, JSON_STRUCTURE)
    return F.when(
        F.ltrim(text).startswith("{") & parsed["lattice"].isNotNull(),
        _finish("atoms", parsed["lattice"], parsed["coords"], parsed["elements"], parsed["cartesian"]),
    )


def from_structure_text(text: Column) -> Column:
    """A structure text; NULL when it is shorter than a header or its scale is no number."""

    def build(lines: Column) -> Column:
        scale = F.get(lines, F.lit(1)).try_cast("double")
        lattice = F.array(
            *[F.transform(_numbers(F.get(lines, F.lit(i))), lambda v: v * scale) for i in (2, 3, 4)]
        )
        counts = F.transform(_words(F.get(lines, F.lit(6))), lambda w: w.try_cast("int"))
        total = F.aggregate(counts, F.lit(0), lambda a, n: a + n)
        elements = F.flatten(F.zip_with(_words(F.get(lines, F.lit(5))), counts, lambda e, n: F.array_repeat(e, n)))
        coords = F.transform(F.slice(lines, 9, total), _numbers)
        cartesian = ~F.lower(F.trim(F.get(lines, F.lit(7)))).startswith("d")
        return F.when(
            (F.size(lines) > 8) & scale.isNotNull() & total.isNotNull(), _finish("text", lattice, coords, elements, cartesian)
        )

    return let(F.split(text, r"\r?\n"), build)


def decode_structure(df: DataFrame, encodings: tuple[str, ...], raw: str | None = None) -> DataFrame:
    """Adds ``source`` and ``structure_data``: the first encoding that can be read, then the raw arrays."""
    tries = []
    for name in encodings:
        tries += [from_json_text(F.col(name)), from_structure_text(F.col(name))]
    if raw:
        r = F.col(raw)
        tries.append(
            F.when(r.isNotNull(), _finish("raw", r["lattice"], r["coords"], r["elements"], r["cartesian"]))
        )
    return df.withColumn("structure_data", F.coalesce(*tries)).withColumn("source", F.col("structure_data.source"))
