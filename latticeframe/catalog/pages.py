"""HTML page queries: pages rendered from driver rows, then parsed back; and the driver's own pages."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import html as h
from ..sources import pages as pg
from .registry import Tables, query


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _row(head: str, cell, n: Column) -> Column:
    cells = F.transform(F.sequence(F.lit(1), n), lambda i: _text("<td>", cell(i), "</td>"))
    return F.concat(F.lit(f"<tr><th>{head}</th>"), F.array_join(cells, ""), F.lit("</tr>"))


def bandrep_pages(t: Tables):
    """One page per order with one to three EBR columns; every tenth page holds no table, another tenth an odd heading."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    n = (cust % 3 + 1).cast("int")
    form = '<form action="d.pl"><input name="i" value="1"></form>Decomposable'
    table = F.concat(
        F.lit("<html><!-- <table frame='box'> --><table><tr><td>menu</td></tr></table><table frame='box' border=1>"),
        F.when(key % 10 == 5, _row("Wyckoff positions", lambda i: _text("odd"), n)).otherwise(
            _row("Wyckoff pos.", lambda i: _text(i, "a(", cust % 11, "/m)"), n)
        ),
        _row("Band-Rep.", lambda i: _text("<b>A", i, "</b>&uarr;G(", key % 4 + 1, ")"), n),
        _row("Decomposable<br>/Indecomposable", lambda i: F.when((key + i) % 2 == 0, form).otherwise("Indecomposable<table><tr><td>in</td></tr><tr><td>ner</td></tr></table>"), n),
        _row("GM:(0,0,0)", lambda i: _text(" GM", cust % 7, "(1) &oplus; GM", i, "(2) "), n),
        _row("&#88;:(0,1/2,0)", lambda i: _text("&#x58;<sub>", i, "</sub>&nbsp;"), n),
        F.lit("</table></html>"),
    )
    html = F.when(key % 10 == 0, "<html><p>No EBR</p></html>").otherwise(table)
    return t.spread("orders", "o_orderkey", "o_custkey").select("o_orderkey", html.alias("html"))


@query(
    "bandrep_html",
    "SC8",
    """
    select o_orderkey, i::int as ebr_column, case when o_orderkey % 10 = 5 then '' else i || 'a(' || (o_custkey % 11) || '/m)' end as wyckoff,
           'A' || i || '↑G(' || (o_orderkey % 4 + 1) || ')' as bandrep,
           case when (o_orderkey + i) % 2 = 0 then 'decomposable' else 'indecomposable' end as note,
           'GM' || (o_custkey % 7) || '(1) ⊕ GM' || i || '(2)' as gm, 'X' || i as x, 2::int as points
    from (select *, unnest(generate_series(1, o_custkey % 3 + 1)) as i from orders where o_orderkey % 10 <> 0)
    """,
)
def bandrep_html(t: Tables):
    columns = pg.bandrep_columns(bandrep_pages(t), "o_orderkey")
    return columns.select(
        "o_orderkey", "ebr_column", "wyckoff", "bandrep", "note", F.col("kpoints")["GM"].alias("gm"),
        F.col("kpoints")["X"].alias("x"), F.size("kpoints").alias("points"),
    )


@query(
    "html_cells",
    "SC8",
    """
    select page_id, href, text, count(*) as n from (
      select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) as href,
             trim(unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2))) as text from pages) group by all
    """,
)
def html_cells(t: Tables):
    found = h.links(t.pages, "page_id")
    return found.groupBy("page_id", "href", "text").agg(F.count("*").alias("n"))


def index_pages(t: Tables):
    """One page per customer: a title row, an irrep row, then one row per index."""
    key = F.col("c_custkey")
    n = (key % 3 + 1).cast("int")
    body = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: _text("<tr><td>Z", i, "<td> ", F.col("c_nationkey") + i, "<td>", key % 9, "<td>",
                        F.when((key + i) % 4 == 0, "-").otherwise((i * 2).cast("string")), "</tr>"),
    )
    html = F.concat(
        F.lit("<table><tr><td colspan=4>indices</td></tr><tr><td>GM1<td>X<i>2</i><td>mod</tr>"), F.array_join(body, "\n"),
        F.lit("</table>"),
    )
    return t.spread("customer", "c_custkey", "c_nationkey").select("c_custkey", F.when(key % 12 == 0, "<p>none").otherwise(html).alias("html"))


@query(
    "index_html",
    "SC9",
    """
    select c_custkey, 'Z' || i as index_name, case when (c_custkey + i) % 4 > 0 then i * 2 end::int as mod_value,
           (c_nationkey + i)::varchar as gm1, (c_custkey % 9)::varchar as x2
    from (select *, unnest(generate_series(1, c_custkey % 3 + 1)) as i from customer where c_custkey % 12 <> 0)
    """,
)
def index_html(t: Tables):
    rows = pg.index_tables(index_pages(t), "c_custkey")
    return rows.select(
        "c_custkey", "index_name", "mod_value", F.col("irreps")["GM1"].alias("gm1"), F.col("irreps")["X2"].alias("x2")
    )


@query(
    "magnetic_index_html",
    "SC9",
    """
    select c_custkey, 'Z' || i as index_name, i::int as mod_value,
           nullif((c_nationkey + 10)::varchar, '') as gm1, case when c_custkey % 9 <> i then (c_custkey % 9)::varchar end as x2
    from (select *, unnest(generate_series(1, c_custkey % 3 + 1)) as i from customer)
    """,
)
def magnetic_index_html(t: Tables):
    key = F.col("c_custkey")
    body = F.transform(
        F.sequence(F.lit(1), (key % 3 + 1).cast("int")),
        lambda i: _text("<tr><th>Z", i, "</th><td>", F.col("c_nationkey") + 10, "</td><td>", key % 9, "</td><td>", i, "</td></tr>"),
    )
    html = F.concat(F.lit("<table><tr><th>index</th><th>GM1</th><th>X2</th></tr>"), F.array_join(body, ""), F.lit("</table>"))
    rows = pg.magnetic_index_tables(t.customer.select("c_custkey", html.alias("html")), "c_custkey")
    return rows.select(
        "c_custkey", "index_name", "mod_value", F.col("irreps")["GM1"].alias("gm1"), F.col("irreps")["X2"].alias("x2")
    )


@query(
    "decomp_html",
    "SC10",
    """
    select event_id, case event_id % 3 when 0 then 'branches' when 1 then 'ebr_list' end as kind,
           case event_id % 3 when 0 then 'A' || user_id || ',B1|C' || (event_id % 5) || ',D'
                             when 1 then 'A1↑G(' || user_id || ')|' || event_type || '↑G' end as content
    from events
    """,
)
def decomp_html(t: Tables):
    parsed = pg.decompositions(_decomposition_pages(t), "event_id")
    branches = F.array_join(F.transform("branches", lambda r: F.array_join(r, ",")), "|")
    return parsed.select("event_id", "kind", F.coalesce(branches, F.array_join("ebr_list", "|")).alias("content"))


def _decomposition_pages(t: Tables):
    kind = F.col("event_id") % 3
    table = _text(
        "<table><tr><th></th><th>Branch 1</th><th>branch 2</th></tr><tr><td>1</td><td>A", F.col("user_id"),
        "</td><td>B1</td></tr><tr><td>2<td>C", F.col("event_id") % 5, "<td> D </table>",
    )
    plain = _text("<p>As: <b>A1&uarr;G(", F.col("user_id"), ")</b> and <i> ", F.col("event_type"), "&uarr;G </i></p>")
    html = F.when(kind == 0, table).when(kind == 1, plain).otherwise("<p>neither</p>")
    return t.spread("events").select("event_id", html.alias("html"))


@query(
    "search_rows",
    "SC14",
    """
    select c_custkey, c_name as compound, c_nationkey::varchar as symmetry_group, 'http://x/detail/' || c_custkey as detail_url,
           c_custkey::varchar as icsd_number, case when c_custkey % 2 = 0 then c_mktsegment end as type from customer
    """,
)
def search_rows(t: Tables):
    key = F.col("c_custkey")
    html = F.concat(
        _text("<table><tr><td><a href='http://x/detail/", key, "'>", F.col("c_name"), "</a></td><td>", F.col("c_nationkey"),
              "</td><td>Z4=1</td><td>-</td>"),
        F.when(key % 2 == 0, F.concat(F.lit("<td>"), "c_mktsegment", F.lit("</td>"))).otherwise(""), F.lit("</tr></table>"),
    )
    rows = pg.search_results(t.customer.select("c_custkey", html.alias("html")), "c_custkey")
    return rows.select("c_custkey", "compound", "symmetry_group", "detail_url", "icsd_number", "type")


@query(
    "ebr_ingest",
    "PL3",
    """
    with c as (select *, unnest(generate_series(1, o_custkey % 3 + 1)) as i from orders where o_orderkey % 10 <> 0)
    select 'ebrs' as target, count(*) as n, count(case when (o_orderkey + i) % 2 = 0 then 1 end) as flagged from c
    union all select 'irreps', count(*) * 2, count(*) from c
    union all select 'failures', count(*), 0 from orders where o_orderkey % 10 = 0
    """,
)
def ebr_ingest(t: Tables):
    from ..plans.ingest import ingest_bandreps

    pages = bandrep_pages(t).withColumnRenamed("o_orderkey", "space_group_id")
    ebrs, irreps, failures = ingest_bandreps(pages, "space_group_id")
    counts = [
        ("ebrs", ebrs, F.count_if(F.col("notes") == "decomposable")),
        ("irreps", irreps, F.count_if(F.col("multiplicity") == 2)),
        ("failures", failures, F.lit(0).cast("long")),
    ]
    parts = [df.agg(F.count("*").alias("n"), flag.alias("flagged")).select(F.lit(n).alias("target"), "n", "flagged") for n, df, flag in counts]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "index_ingest",
    "PL4",
    """
    with c as (select *, unnest(generate_series(1, c_custkey % 3 + 1)) as i from customer where c_custkey % 12 <> 0)
    select 'indices' as target, count(*) as n, count(case when (c_custkey + i) % 4 > 0 then 1 end) as filled from c
    union all select 'irrep_values', count(*) * 2, count(*) * 2 from c
    """,
)
def index_ingest(t: Tables):
    from ..plans.ingest import ingest_indices

    pages = index_pages(t).withColumnRenamed("c_custkey", "space_group_id")
    indices, values = ingest_indices(pages, "space_group_id")
    a = indices.agg(F.count("*").alias("n"), F.count("mod_value").alias("filled")).withColumn("target", F.lit("indices"))
    b = values.agg(F.count("*").alias("n"), F.count("value").alias("filled")).withColumn("target", F.lit("irrep_values"))
    return a.unionByName(b).select("target", "n", "filled")


@query(
    "decomp_ingest",
    "PL3 SC10",
    """
    select 'branch' as target, event_id, i::int as decomposition_index, j::int as branch_index,
           case when i = 1 then case when j = 1 then 'A' || user_id else 'B1' end else case when j = 1 then 'C' || (event_id % 5) else 'D' end end as content
    from events, (values (1), (2)) a(i), (values (1), (2)) b(j) where event_id % 3 = 0
    union all select 'ebr', event_id, null, null, 'A1↑G(' || user_id || ')' from events where event_id % 3 = 1
    union all select 'ebr', event_id, null, null, event_type || '↑G' from events where event_id % 3 = 1
    """,
)
def decomp_ingest(t: Tables):
    from ..plans.ingest import ingest_decompositions

    items, lists = ingest_decompositions(_decomposition_pages(t), "event_id")
    none = F.lit(None).cast("int")
    a = items.select(F.lit("branch").alias("target"), "event_id", "decomposition_index", "branch_index", F.col("irreps_string").alias("content"))
    b = lists.select(
        F.lit("ebr").alias("target"), "event_id", none.alias("decomposition_index"), none.alias("branch_index"), F.col("decomposes_into").alias("content")
    )
    return a.unionByName(b)
