"""Band-representation texts with headed sections, in three layouts, parsed inside their row.

Each parser adds the columns ``wyckoff``, ``orbitals``, ``notes`` (arrays of words), ``krows``
(array of label and cells) and ``status``; ``columns_to_rows`` turns them into one row per EBR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labels
from .arrays import let

WYCKOFF, BANDREP, DECOMPOSABLE = "Wyckoff pos.", "Band-Rep.", "Decomposable"


def _words(c: Column) -> Column:
    return F.filter(labels.words(F.coalesce(c, F.lit(""))), lambda w: w != "")


def _joined(text: Column) -> Column:
    """Lines that end in a backslash continue on the next one."""
    return F.regexp_replace(text, r"\\\s*\n\s*", " ")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\r?\n"), lambda s: labels.trimmed(s) != "")


def _first(flags: Column) -> Column:
    """1-based position of the first true flag, 0 if there is none."""
    return F.array_position(flags, True).cast("int")


def _line_after(lines: str, header: str) -> Column:
    position = _first(F.transform(lines, lambda s: F.startswith(s, F.lit(header))))
    return F.when(position > 0, F.get(lines, position))


def notes_and_status(df: DataFrame) -> DataFrame:
    """Column-count and notes rules.

    Wyckoff and orbital counts must agree. Surplus notes keep the last ones; a
    single note may stand for many columns, any other shortage is an error.
    """
    n, notes = F.size("wyckoff"), F.size("notes")
    short = (notes > 0) & (notes < n) & ~((notes == 1) & (n > 1))
    status = (
        F.when(F.size("wyckoff") == 0, f"missing {WYCKOFF}")
        .when(F.size("orbitals") == 0, f"missing {BANDREP}")
        .when(F.size("orbitals") != n, "column mismatch")
        .when(short, "notes mismatch")
        .otherwise("ok")
    )
    kept = F.when(notes > n, F.slice("notes", -n, n)).otherwise(F.col("notes"))
    return df.withColumn("status", status).withColumn("notes", F.when(F.col("status") == "ok", kept).otherwise(F.col("notes")))


def _check_cells(df: DataFrame) -> DataFrame:
    """Rows whose cell count differs from the column count turn the status to an error."""
    bad = F.exists("krows", lambda r: F.size(r["cells"]) != F.size("wyckoff"))
    return df.withColumn("status", F.when((F.col("status") == "ok") & bad, "cell mismatch").otherwise(F.col("status")))


def parse_layout_a(df: DataFrame, text: str) -> DataFrame:
    """Each heading stands on its own line and its content on the next; k rows follow the notes.

    After ``Decomposable`` a line of at most two words that names a note and precedes a longer
    line counts as a heading, not as the notes.
    """
    located = df.withColumn("_l", _lines(_joined(F.col(text)))).withColumn(
        "_d", _first(F.transform("_l", lambda s: F.startswith(s, F.lit(DECOMPOSABLE))))
    )
    here, after = F.get("_l", F.col("_d")), F.get("_l", F.col("_d") + 1)
    is_heading = (
        (F.size(_words(here)) <= 2)
        & (F.size(_words(after)) > F.size(_words(here)))
        & F.contains(F.lower(here), F.lit("decomposable"))
    )
    located = located.withColumn("_skip", F.coalesce(is_heading, F.lit(False)).cast("int"))
    notes = F.when(F.col("_d") > 0, F.get("_l", F.col("_d") + F.col("_skip")))
    klines = F.when(F.col("_d") > 0, F.slice("_l", F.col("_d") + F.col("_skip") + 2, F.size("_l"))).otherwise(F.array())
    krow = lambda s: F.struct(
        F.regexp_replace(_words(s)[0], ":+$", "").alias("label"),
        F.slice(_words(s), 2, F.greatest(F.size(_words(s)), F.lit(1))).alias("cells"),
    )
    parsed = located.select(
        "*", _words(_line_after("_l", WYCKOFF)).alias("wyckoff"), _words(_line_after("_l", BANDREP)).alias("orbitals"),
        _words(notes).alias("notes"), F.transform(klines, krow).alias("krows"),
    ).drop("_l", "_d", "_skip", text)
    return notes_and_status(parsed)


K_START = r"(?i)[A-ZΓ]+:\s*\([^)]+\)"


def parse_layout_b(df: DataFrame, text: str) -> DataFrame:
    """Headings anywhere in the text; k rows look like ``K:(x,y,z) cells``; notes are picked by their word count."""
    whole_text = _joined(labels.trimmed(F.col(text)))
    located = df.withColumn("_t", whole_text).withColumn(
        "_k", F.regexp_instr(F.col("_t"), F.lit(f"({K_START})"))
    )
    located = located.select(
        "*",
        _words(F.regexp_extract("_t", r"(?is)Wyckoff pos\.(.*?)Band-Rep\.", 1)).alias("wyckoff"),
        _words(F.regexp_extract("_t", r"(?is)Band-Rep\.(.*?)Decomposable", 1)).alias("orbitals"),
        F.when(F.col("_k") > 0, F.expr("substring(_t, 1, _k - 1)")).alias("_before"),
        F.when(F.col("_k") > 0, F.expr("substring(_t, _k)")).alias("_after"),
    )
    note_lines = F.transform(
        _lines(F.regexp_extract("_before", r"(?is)Decomposable\\?\s*(.*)$", 1)), lambda s: _words(s)
    )
    n = F.size("wyckoff")
    located = located.withColumn("_n", note_lines)
    fitting = F.try_element_at(F.filter("_n", lambda w: F.size(w) == n), F.lit(-1))
    last = F.try_element_at("_n", F.lit(-1))
    lone = (F.size(last) == 1) & F.lower(last[0]).isin("decomposable", "indecomposable")
    notes = F.coalesce(fitting, F.when(~lone, last), F.array().cast("array<string>"))
    start = r"^([A-ZΓ]+):\s*\([^)]+\)\s*"
    rows = F.filter(F.transform(F.split("_after", "\n"), labels.trimmed), lambda s: s.rlike(start))
    krow = lambda s: F.struct(
        F.regexp_extract(s, start, 1).alias("label"), labels.kpoint_cells(F.regexp_replace(s, start, "")).alias("cells")
    )
    parsed = located.select(
        "*", notes.alias("notes"), F.coalesce(F.transform(rows, krow), F.array()).alias("krows")
    ).drop("_t", "_n", "_before", "_after", text)
    checked = _check_cells(notes_and_status(parsed))
    no_rows = (F.col("status") == "ok") & ((F.col("_k") == 0) | (F.size("krows") == 0))
    return checked.withColumn("status", F.when(no_rows, "no k rows").otherwise(F.col("status"))).drop("_k")


def parse_layout_c(df: DataFrame, text: str) -> DataFrame:
    """A heading starts its own line and its content runs until the next heading or k row ``K: cells``."""
    k_line = r"^[A-ZΓ]+:"
    lines = df.withColumn("_l", F.transform(_lines(F.col(text)), labels.trimmed))
    is_heading = lambda s: s.rlike(r"^(Wyckoff pos\.|Band-Rep\.|Decomposable)")

    ends = lambda s: is_heading(s) | s.rlike(k_line)
    # Whether a line ends a section and its place, told once per line.
    lines = lines.withColumn("_ends", F.filter(F.transform("_l", lambda s, i: F.when(ends(s), i + 1)), lambda i: i.isNotNull()))

    def section(header: str) -> Column:
        starts = F.filter("_ends", lambda i: F.startswith(F.get("_l", i - 1), F.lit(header)))

        def content(start: Column) -> Column:
            end = F.coalesce(F.get(F.filter("_ends", lambda i: i > start), F.lit(0)), F.size("_l") + 1)
            first = F.substr(F.get("_l", start - 1), F.lit(len(header) + 1))
            return _words(F.concat_ws(" ", first, F.array_join(F.slice("_l", start + 1, end - start - 1), " ")))

        return F.coalesce(let(F.get(starts, F.lit(0)), lambda i: F.when(i.isNotNull(), content(i))), F.array().cast("array<string>"))

    krow = lambda s: F.struct(
        labels.trimmed(F.substring_index(s, ":", 1)).alias("label"),
        labels.kpoint_cells(F.regexp_replace(s, r"^[^:]*:\s*", "")).alias("cells"),
    )
    parsed = lines.select(
        "*", section(WYCKOFF).alias("wyckoff"), section(BANDREP).alias("orbitals"), section(DECOMPOSABLE).alias("notes"),
        F.transform(F.filter("_l", lambda s: s.rlike(k_line)), krow).alias("krows"),
    ).drop("_l", text)
    status = F.when((F.size("wyckoff") == 0) | (F.size("orbitals") == 0), "missing section").otherwise("ok")
    return _check_cells(parsed.withColumn("status", status))


def columns_to_rows(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per EBR column of each text with status ``ok``; a missing note means indecomposable."""
    columns = F.when(F.col("status") == "ok", F.sequence(F.lit(1), F.size("wyckoff")))
    rows = parsed.select("*", F.explode(columns).alias("ebr_column"))
    i = F.col("ebr_column") - 1
    points = F.map_from_entries(
        F.transform("krows", lambda r: F.struct(r["label"].alias("k"), F.get(r["cells"], i).alias("cell")))
    )
    return rows.select(
        *keys, "ebr_column", labels.wyckoff(F.get("wyckoff", i)).alias("w"), labels.orbital(F.get("orbitals", i)).alias("o"),
        F.coalesce(F.get("notes", i), F.lit("indecomposable")).alias("notes"), points.alias("kpoints"),
    ).select(*keys, "ebr_column", "w.*", "o.*", "notes", "kpoints")
