"""Stored pages to records: band-representation, index, decomposition and search-result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as h
from ..functions.arrays import last_value_map
from ..functions.topology import detail_id

# Keys of the header rows after lower-casing and dropping ``.`` and ``/``.
WYCKOFF_ROW = "wyckoff pos"
BANDREP_ROW = "band-rep"
DECOMPOSABLE_ROW = "decomposableindecomposable"
# Fixed value: what marks the table of band representations.
BOXED = r"(?i)\bframe\s*=\s*[\"']?box"


def _first_text(row: Column) -> Column:
    return row[0]["text"]


def _row_key(row: Column) -> Column:
    return F.regexp_replace(F.lower(_first_text(row)), r"[./]", "")


def _at(row: Column, i: Column, name: str, default) -> Column:
    return F.coalesce(F.get(row, i)[name], F.lit(default))


def parsed_bandreps(pages: DataFrame, key: str, html: str = "html", outer: bool = True) -> DataFrame:
    """One row per page and EBR column: Wyckoff and band-rep cell, note, k-point map.

    The boxed table is read inside its row, so nothing is shuffled. A page has columns when its boxed table has a row of
    two cells or more; a missing heading leaves its text empty. Any other page is one row with NULL ``ebr_column`` (left out
    unless ``outer``).
    """
    boxed = F.get(F.filter("tables", lambda t: t["attributes"].rlike(BOXED)), F.lit(0))["rows"]
    is_k = lambda r: F.contains(_first_text(r), F.lit(":"))
    named = lambda name: F.try_element_at(
        F.filter("heads", lambda r: _row_key(r) == name), F.lit(-1)
    )
    page = h.read_pages(pages, key, html).select(key, boxed.alias("rows")).select(
        key,
        F.array_max(F.transform("rows", lambda r: F.size(r))).alias("width"),
        F.filter("rows", is_k).alias("krows"),
        F.filter("rows", lambda r: ~is_k(r)).alias("heads"),
    )
    page = page.select(
        key, "width", "krows", named(WYCKOFF_ROW).alias("w"), named(BANDREP_ROW).alias("b"), named(DECOMPOSABLE_ROW).alias("d"),
    )
    columns = F.when(F.col("width") > 1, F.sequence(F.lit(1), F.col("width") - 1))
    column = page.select("*", (F.explode_outer if outer else F.explode)(columns).alias("ebr_column"))
    i = F.col("ebr_column")
    points = F.transform(
        F.filter("krows", lambda r: F.size(r) > i),
        lambda r: F.struct(F.substring_index(_first_text(r), ":", 1).alias("k"), r[i]["text"].alias("cell")),
    )
    return column.select(
        key, "ebr_column", _at(F.col("w"), i, "text", "").alias("wyckoff"), _at(F.col("b"), i, "text", "").alias("bandrep"),
        F.when(_at(F.col("d"), i, "has_form", False), "decomposable").otherwise("indecomposable").alias("note"),
        last_value_map(points, "k", "cell").alias("kpoints"),
    )


def bandrep_columns(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """The EBR columns of all pages that have some."""
    return parsed_bandreps(pages, key, html, outer=False)


def failures(parsed: DataFrame, key: str) -> DataFrame:
    """Of ``parsed_bandreps``, the pages without an EBR column."""
    return parsed.where(F.col("ebr_column").isNull()).select(key, F.lit("no main table").alias("reason"))


def failed_pages(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Pages without an EBR column, so that every page is either here or in ``bandrep_columns``."""
    return failures(parsed_bandreps(pages, key, html), key)


def index_tables(pages: DataFrame, key: str, html: str = "html", header_row: int = 1) -> DataFrame:
    """Index rows: name, modulus (NULL unless whole) and irrep to value map.

    ``header_row`` 1 is the non-magnetic layout, whose second row names the irreps.
    """
    rows = h.read_pages(pages, key, html).select(key, F.explode(h.grids(F.col("tables"))).alias("rows"))
    rows = rows.where(F.size("rows") >= 2).select(
        key, F.transform(F.col("rows")[header_row], lambda c: c["text"]).alias("names"),
        F.posexplode(F.slice("rows", header_row + 2, F.greatest(F.size("rows"), F.lit(1)))).alias("position", "row"),
    ).where(F.size("row") >= 2)
    texts = F.transform("row", lambda c: c["text"])
    names = F.slice("names", 1, F.size("names") - 1)
    pairs = F.zip_with(
        names, F.slice(texts, 2, F.size("names") - 1), lambda n, v: F.struct(n.alias("name"), v.alias("value"))
    )
    return rows.select(
        key, texts[0].alias("index_name"), F.element_at(texts, -1).try_cast("int").alias("mod_value"),
        last_value_map(F.filter(pairs, lambda p: p["name"].isNotNull()), "name", "value").alias("irreps"),
    )


def magnetic_index_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Magnetic layout: the header is the first row that looks like one; empty cells and the modulus are left out."""
    rows = h.read_pages(pages, key, html).select(key, F.explode(h.grids(F.col("tables"))).alias("rows"))
    texts = rows.where(F.size("rows") >= 2).select(
        key, F.transform("rows", lambda r: F.transform(r, lambda c: c["text"])).alias("rows")
    )

    def heading(row: Column) -> Column:
        return F.exists(
            F.slice(row, 2, F.greatest(F.size(row), F.lit(1))),
            lambda s: (s != "") & (F.contains(F.lower(s), F.lit("rep")) | (F.length(s) < 10)),
        )

    flags = F.transform("rows", heading)
    found = texts.withColumn("_h", F.array_position(flags, True).cast("int")).where("_h > 0")
    body = found.select(
        key, F.col("rows")[F.col("_h") - 1].alias("head"),
        F.explode(F.slice("rows", F.col("_h") + 1, F.size("rows"))).alias("row"),
    ).where((F.size("row") >= 2) & (F.col("row")[0] != ""))
    names = F.slice("head", 2, F.greatest(F.size("head"), F.lit(1)))
    values = F.slice("row", 2, F.greatest(F.size("row"), F.lit(1)))
    modulus = F.element_at("row", -1)
    pairs = F.filter(
        F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.alias("value"))),
        lambda p: p["name"].isNotNull() & (p["value"] != "") & (p["value"] != modulus),
    )
    built = body.select(
        key, F.col("row")[0].alias("index_name"),
        F.when(modulus.rlike(r"^\d+$"), modulus.try_cast("int")).alias("mod_value"),
        last_value_map(pairs, "name", "value").alias("irreps"),
    )
    return built.where(F.size("irreps") > 0)


def decompositions(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Branch table, else strings holding ``↑G``, else NULL kind.

    ``branches`` is rows of cells without the first one; ``ebr_list`` the strings.
    """
    grids = h.grids(F.col("tables"))
    is_branch = lambda g: F.exists(g, lambda r: F.exists(r, lambda c: F.contains(F.lower(c["text"]), F.lit("branch"))))
    table = F.get(F.filter(grids, is_branch), F.lit(0))
    texts = F.filter("texts", lambda s: F.contains(s, F.lit("↑G")))
    picked = h.read_pages(pages, key, html, "tables texts").select(key, table.alias("_table"), texts.alias("_texts"))
    rows = F.transform(
        F.slice("_table", 2, F.greatest(F.size("_table"), F.lit(1))),
        lambda r: F.transform(F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), lambda c: c["text"]),
    )
    kind = F.when(F.col("_table").isNotNull(), "branches").when(F.size("_texts") > 0, "ebr_list")
    return picked.select(
        key, kind.alias("kind"), F.when(kind == "branches", F.filter(rows, lambda r: F.size(r) > 0)).alias("branches"),
        F.when(kind == "ebr_list", F.col("_texts")).alias("ebr_list"),
    )


# The columns of a search-result row.
RESULT_COLUMNS = ("compound", "symmetry_group", "topological_indices", "crossing_type", "type")


def search_results(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Result rows of up to five cells with the detail link and its id."""
    rows = h.read_pages(pages, key, html).select(key, F.explode(F.flatten(h.grids(F.col("tables")))).alias("r"))
    link = F.get(
        F.filter(F.transform("r", lambda c: c["href"]), lambda u: F.contains(u, F.lit("detail")) | F.contains(u, F.lit("#"))),
        F.lit(0),
    )
    found = rows.select(
        key, *[F.get("r", F.lit(i))["text"].alias(n) for i, n in enumerate(RESULT_COLUMNS)], link.alias("detail_url")
    )
    present = sum((F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in RESULT_COLUMNS[1:]),
                  F.when(F.col("detail_url").isNotNull(), 1).otherwise(0))
    kept = found.where(F.col("compound").isNotNull() | (present > 1))
    return kept.withColumn("icsd_number", detail_id("detail_url"))
