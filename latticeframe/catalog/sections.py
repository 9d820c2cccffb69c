"""Section-text queries: texts rendered from orders, parsed in each of the three layouts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import sections as sec
from .registry import Tables, query

def _columns(make, n: Column, separator: str = " ") -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), n), make), separator)


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


class Parts:
    """Column expressions of one text; made per query, since columns need a running session."""

    def __init__(self, fewest: int = 1):
        self.key, self.cust = F.col("o_orderkey"), F.col("o_custkey")
        key, cust = self.key, self.cust
        self.n = (cust % 3 + fewest).cast("int")
        self.wyckoff = _columns(lambda i: _text(i, "a(", cust % 7, "/m)"), self.n)
        self.orbitals = _columns(lambda i: _text("A", i, "↑G(", key % 4 + 1, ")"), self.n)
        self.notes = _columns(lambda i: F.when((key + i) % 2 == 0, "decomposable").otherwise("indecomposable"), self.n)

    def cells(self, prefix: str, separator: str) -> Column:
        return _columns(lambda i: _text(prefix, i, "(", self.cust % 5 + 1, ")"), self.n, separator)


SQL = """
    select o_orderkey, i::int as ebr_column, i || 'a' as wyckoff_letter, (o_custkey % 7) || '/m' as site_symmetry,
           'A' || i || '↑G' as orbital_label, (o_orderkey % 4 + 1)::int as orbital_multiplicity,
           case when (o_orderkey + i) % 2 = 0 then 'decomposable' else 'indecomposable' end as notes,
           {gm} as gm, 'X' || i || '(' || (o_custkey % 5 + 1) || ')' as x
    from (select *, unnest(generate_series(1, o_custkey % 3 + {fewest})) as i from orders)
"""


def _result(parsed):
    rows = sec.columns_to_rows(parsed, ["o_orderkey"])
    return rows.select(
        "o_orderkey", "ebr_column", "wyckoff_letter", "site_symmetry", "orbital_label", "orbital_multiplicity", "notes",
        F.col("kpoints")["GM"].alias("gm"), F.col("kpoints")["X"].alias("x"),
    )


@query("sections_a", "FN5", SQL.format(fewest=2, gm="'GM' || i || '(' || (o_custkey % 5 + 1) || ')'"))
def sections_a(t: Tables):
    # Two columns at least: the layout takes a shorter line before a longer one for a heading.
    p = Parts(2)
    text = _text(
        "\nWyckoff pos.\n\n", p.wyckoff, "\nBand-Rep.\\\n\n".replace("\\", ""), F.replace(p.orbitals, F.lit(" "), F.lit(" \\\n  ")),
        "\nDecomposable\n", F.when((p.n == 2) | (p.key % 2 == 0), "Decomposable\n").otherwise(""), p.notes,
        "\nGM: ", p.cells("GM", " "), "\n X: ", p.cells("X", "  "), "\n",
    )
    texts = t.spread("orders", "o_orderkey", "o_custkey").select("o_orderkey", text.alias("text"))
    return _result(sec.parse_layout_a(texts, "text"))


@query("sections_b", "FN6 FN4", SQL.format(fewest=1, gm="(o_custkey % 9) || ' GM' || i || '(' || (o_custkey % 5 + 1) || ') ⊕ A1(1)'"))
def sections_b(t: Tables):
    p = Parts()
    gm = _columns(lambda i: _text(p.cust % 9, " GM", i, "(", p.cust % 5 + 1, ") ⊕ A1(1)"), p.n)
    text = _text(
        "page WYCKOFF pos. ", p.wyckoff, "\nBand-Rep. ", F.replace(p.orbitals, F.lit(" "), F.lit("\n")),
        "\nDecomposable\\\n some heading words that do not fit\n", p.notes, "\nGM:(0,0,0) ", gm, "\nX: (0,1/2,0) ", p.cells("X", " "), "\n",
    )
    texts = t.spread("orders", "o_orderkey", "o_custkey").select("o_orderkey", text.alias("text"))
    return _result(sec.parse_layout_b(texts, "text"))


@query(
    "sections_c",
    "FN7",
    SQL.format(fewest=1, gm="'GM' || i || '(' || (o_custkey % 5 + 1) || ')'") + " where o_orderkey % 6 <> 0",
)
def sections_c(t: Tables):
    p = Parts()
    extra = F.when(p.key % 6 == 0, " Y9(1)").otherwise("")
    text = _text(
        "title\n Wyckoff pos. ", F.replace(p.wyckoff, F.lit(" "), F.lit("\n")), "\nBand-Rep.\n", p.orbitals, "\nDecomposable ", p.notes,
        "\nGM: ", p.cells("GM", " "), extra, "\nX:", p.cells("X", " "), "\n",
    )
    texts = t.spread("orders", "o_orderkey", "o_custkey").select("o_orderkey", text.alias("text"))
    return _result(sec.parse_layout_c(texts, "text"))


@query(
    "notes_rules",
    "FN8",
    """
    with c as (select o_orderkey, o_custkey % 4 + 1 as n, o_orderkey % 4 + 1 as m, o_orderkey % 6 as k from orders)
    select case when n <> m and o_orderkey % 5 = 0 then 'column mismatch' when k > 0 and k < n and not (k = 1 and n > 1)
                then 'notes mismatch' else 'ok' end as status, n::int as columns,
           case when n <> m and o_orderkey % 5 = 0 or k > 0 and k < n and not (k = 1 and n > 1) then k
                else least(k, n) end::int as notes, count(*) as texts,
           min(case when n <> m and o_orderkey % 5 = 0 or k < n then 'n1' else 'n' || (k - n + 1) end) as first_note
    from c where k > 0 group by all
    """,
)
def notes_rules(t: Tables):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    n, k = (cust % 4 + 1).cast("int"), (key % 6).cast("int")
    m = F.when(key % 5 == 0, (key % 4 + 1).cast("int")).otherwise(n)
    words = lambda p, size: F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.lit(p), i.cast("string")))
    rows = t.orders.where(k > 0).select(
        words("w", n).alias("wyckoff"), words("o", m).alias("orbitals"), words("n", k).alias("notes")
    )
    ruled = sec.notes_and_status(rows)
    return ruled.groupBy("status", F.size("wyckoff").alias("columns"), F.size("notes").alias("notes")).agg(
        F.count("*").alias("texts"), F.min(F.col("notes")[0]).alias("first_note")
    )
