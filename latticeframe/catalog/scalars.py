"""Scalar text and number functions on driver columns."""

from pyspark.sql import functions as F

from ..functions import formulas, geometry, labels
from ..functions import topology as topo
from .registry import Tables, query


@query(
    "regex_pair",
    "FN1 FN2 FN3",
    r"""
    select p_partkey, n || 'a' as wyckoff_letter, sym as site_symmetry, lower(p_type) || '↑G' as orbital_label,
           case when p_size % 3 = 0 then 1 else p_size end::int as orbital_multiplicity,
           case when p_size % 3 > 0 then p_size end::int as multiplicity, p_type as irrep_label
    from (select *, regexp_extract(p_brand, '#(\d+)', 1) as n, case when p_size % 2 = 0 then p_name else '' end as sym
          from part)
    """,
)
def regex_pair(t: Tables):
    n = F.regexp_extract("p_brand", r"#(\d+)", 1)
    size = F.col("p_size")
    wyckoff_text = F.when(size % 2 == 0, F.concat(n, F.lit("a("), "p_name", F.lit(")"))).otherwise(F.concat(n, F.lit("a")))
    count = F.when(size % 3 == 0, "").otherwise(F.concat(F.lit("("), size.cast("string"), F.lit(")")))
    texts = t.part.select(
        "p_partkey",
        wyckoff_text.alias("w"),
        F.concat(F.lower("p_type"), F.lit("↑G"), count).alias("o"),
        F.concat("p_type", count).alias("i"),
    )
    return texts.select(
        "p_partkey", labels.wyckoff("w").alias("wy"), labels.orbital("o").alias("orb"),
        labels.multiplicity("i").alias("multiplicity"), labels.irrep_label("i").alias("irrep_label"),
    ).select("p_partkey", "wy.*", "orb.*", "multiplicity", "irrep_label")


@query(
    "tokenize",
    "FN4",
    r"""
    select l_orderkey, l_linenumber, l_partkey, count(*) as copies, min(case when l_returnflag = 'A' then 3 else 2 end) as cells,
           min('A' || l_linenumber || '(1)') as first_cell,
           min(l_suppkey || ' Γ' || l_linenumber || '(2) ⊕ X1(1)') as second_cell
    from lineitem group by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag
    """,
)
def tokenize(t: Tables):
    line = F.col("l_linenumber").cast("string")
    first = F.concat(F.lit("A"), line, F.lit("(1)"))
    second = F.concat(F.col("l_suppkey").cast("string"), F.lit(" Γ"), line, F.lit("(2) ⊕ X1(1)"))
    tail = F.when(F.col("l_returnflag") == "A", "  -").otherwise("")
    row = F.concat(first, F.lit("   "), second, tail)
    cells = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", labels.kpoint_cells(row).alias("c")
    )
    return (
        cells.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
        .agg(
            F.count("*").alias("copies"), F.min(F.size("c")).alias("cells"), F.min(F.col("c")[0]).alias("first_cell"),
            F.min(F.col("c")[1]).alias("second_cell"),
        )
        .drop("l_suppkey", "l_returnflag")
    )


@query(
    "weighted_tokens",
    "AG19",
    """select p_partkey, case when p_size % 5 = 0 then 0 else p_size * 2 + 1 + 3 * (p_size % 4 + 1) end::bigint as dimension
       from part""",
)
def weighted_tokens(t: Tables):
    size = F.col("p_size")
    text = F.concat(
        size.cast("string"), F.lit(" G4("), F.lit("2), "), F.col("p_type"), F.lit(", 3 A1("),
        (size % 4 + 1).cast("string"), F.lit(")"),
    )
    text = F.when(size % 5 == 0, F.lit("  ")).otherwise(text)
    return t.part.select("p_partkey", labels.irrep_dimension(text).alias("dimension"))


@query(
    "norm_tokens",
    "FN9 AG18",
    """
    with w as (
      select p_partkey, el, sum(n) as n from (
        select p_partkey, 'Na' as el, p_size as n from part union all
        select p_partkey, 'Cl', p_size * (p_partkey % 3 + 1) from part union all
        select p_partkey, case when p_partkey % 2 = 0 then 'O' else 'Na' end, p_size * 2 from part) group by all),
    g as (select p_partkey, case when count(*) = 2 then gcd(min(n), max(n))
             else gcd(gcd(min(n), max(n)), (sum(n) - min(n) - max(n))) end as d from w group by p_partkey)
    select w.p_partkey, string_agg(el || case when n = d then '' else (n // d)::varchar end, '' order by el) as formula
    from w join g on w.p_partkey = g.p_partkey group by w.p_partkey
    """,
)
def norm_tokens(t: Tables):
    rows = t.spread("part", "p_partkey", "p_size")
    return rows.select("p_partkey", formulas.reduced_formula(formulas.element_counts(_formula())).alias("formula"))


def _formula():
    size, key = F.col("p_size"), F.col("p_partkey")
    return F.concat(
        F.lit("Na"), size.cast("string"), F.lit(" Cl"), (size * (key % 3 + 1)).cast("string"), F.lit(" "),
        F.when(key % 2 == 0, "O").otherwise("Na"), (size * 2).cast("string"),
    )


@query(
    "norm_tokens2",
    "FN10",
    """
    select p_partkey, string_agg(el || n, '' order by el) as formula from (
      select p_partkey, el, sum(n)::bigint as n from (
        select p_partkey, 'Na' as el, p_size as n from part union all
        select p_partkey, 'Cl', p_size * (p_partkey % 3 + 1) from part union all
        select p_partkey, case when p_partkey % 2 = 0 then 'O' else 'Na' end, p_size * 2 from part) group by all)
    group by p_partkey
    """,
)
def norm_tokens2(t: Tables):
    return t.part.select("p_partkey", formulas.full_formula(formulas.element_counts(_formula())).alias("formula"))


@query("safe_name", "FN11", "select c_custkey, regexp_replace(c_name, '[^A-Za-z0-9]', '_', 'g') as safe from customer")
def safe_name(t: Tables):
    return t.customer.select("c_custkey", topo.safe_name("c_name").alias("safe"))


@query(
    "regex_lines",
    "SC11",
    r"""
    select number, count(*) as n from (
      select case when regexp_matches(line, 'BNS:\s*[\d.]+') then regexp_extract(line, 'BNS:\s*([\d.]+)', 1)
                  when regexp_matches(line, '^\s*[\d.]+\s*$') then regexp_extract(line, '^\s*([\d.]+)\s*$', 1) end as number
      from (select unnest(string_split(text || chr(10) || 'group BNS: ' || (doc_id % 230) || '.' || (n_chars % 7)
                          || chr(10) || ' ' || (doc_id % 9) || '.5 ', chr(10))) as line from documents))
    where number is not null group by number
    """,
)
def regex_lines(t: Tables):
    doc, chars = F.col("doc_id"), F.col("n_chars")
    text = F.concat(
        "text", F.lit("\ngroup BNS: "), (doc % 230).cast("string"), F.lit("."), (chars % 7).cast("string"),
        F.lit("\n "), (doc % 9).cast("string"), F.lit(".5 "),
    )
    lines = t.documents.select(F.explode(F.split(text, "\n")).alias("line"))
    numbers = lines.select(labels.bns_number("line").alias("number")).where(F.col("number").isNotNull())
    return numbers.groupBy("number").agg(F.count("*").alias("n"))


@query(
    "parse_vector",
    "FN18",
    """
    select l_orderkey, l_linenumber, l_partkey, sum(l_discount) as x, sum(l_tax) as y,
           sum(case when l_returnflag = 'N' then 0.0 else l_linenumber / 4 end)::double as z, count(*) as n
    from lineitem where l_returnflag <> 'R' group by all
    """,
)
def parse_vector(t: Tables):
    numbers = [F.col("l_discount").cast("string"), F.col("l_tax").cast("string")]
    third = (F.col("l_linenumber") / 4).cast("string")
    text = (
        F.when(F.col("l_returnflag") == "N", F.concat_ws(" ", *numbers))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("("), F.concat_ws(",", *numbers, third), F.lit(")")))
        .otherwise("u,v,w")
    )
    parsed = t.lineitem.withColumn("k", labels.kpoint_coordinates(text)).where(F.col("k").isNotNull())
    return parsed.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.sum(F.col("k")[0]).alias("x"), F.sum(F.col("k")[1]).alias("y"), F.sum(F.col("k")[2]).alias("z"),
        F.count("*").alias("n"),
    )


@query(
    "affine3",
    "FN19",
    """
    select l_linenumber, l_returnflag, count(*) as n, round(sum(l_quantity * 2 + l_discount * 0.5), 2) as x,
           round(sum(l_discount * 3 + l_tax * 0.25), 2) as y, round(sum(l_tax * 4), 2) as z,
           round(sum(l_quantity), 2) as back_x, round(sum(l_discount), 2) as back_y, round(sum(l_tax), 2) as back_z
    from lineitem group by l_linenumber, l_returnflag
    """,
)
def affine3(t: Tables):
    lattice = geometry.matrix(
        [[F.lit(v) for v in row] for row in ([2.0, 0.0, 0.0], [0.5, 3.0, 0.0], [0.0, 0.25, 4.0])]
    )
    frac = F.array("l_quantity", "l_discount", "l_tax")
    placed = t.lineitem.select("l_linenumber", "l_returnflag", frac.alias("frac"), lattice.alias("lattice"))
    placed = placed.withColumn("cart", geometry.row_times_matrix(F.col("frac"), F.col("lattice")))
    placed = placed.withColumn("back", geometry.row_times_matrix(F.col("cart"), geometry.inverse(F.col("lattice"))))
    sums = []
    for i, axis in enumerate("xyz"):
        sums.append(F.round(F.sum(F.col("cart")[i]), 2).alias(axis))
        sums.append(F.round(F.sum(F.col("back")[i]), 2).alias(f"back_{axis}"))
    return placed.groupBy("l_linenumber", "l_returnflag").agg(F.count("*").alias("n"), *sums)


@query(
    "trig_matrix",
    "FN20",
    """
    with c as (select p_partkey, p_size as a, p_size + 1 as b, p_size + 2 as c, radians(60 + p_size % 30) as al,
                      radians(70 + p_size % 20) as be, radians(80 + p_size % 10) as ga from part),
    m as (select *, (cos(al) - cos(be) * cos(ga)) / sin(ga) as lean from c)
    select p_partkey, round(b * cos(ga), 6) as bx, round(b * sin(ga), 6) as b_y, round(c * cos(be), 6) as cx,
           round(c * lean, 6) as cy, round(c * sqrt(1 - cos(be) * cos(be) - lean * lean), 6) as cz,
           round(a * b * sin(ga) * c * sqrt(1 - cos(be) * cos(be) - lean * lean), 3) as volume from m
    """,
)
def trig_matrix(t: Tables):
    size = F.col("p_size")
    m = geometry.lattice_from_cell(size, size + 1, size + 2, 60 + size % 30, 70 + size % 20, 80 + size % 10)
    built = t.part.select("p_partkey", m.alias("m"))
    m = F.col("m")
    return built.select(
        "p_partkey", F.round(m[1][0], 6).alias("bx"), F.round(m[1][1], 6).alias("b_y"), F.round(m[2][0], 6).alias("cx"),
        F.round(m[2][1], 6).alias("cy"), F.round(m[2][2], 6).alias("cz"), F.round(geometry.volume(m), 3).alias("volume"),
    )


@query(
    "lookup_map",
    "FN21",
    """
    select p_partkey, z::int as z, round(z / 100.0, 4)::double as z_scaled,
           round(case when z between 1 and 2 then 1 when z between 3 and 10 then 2 when z between 11 and 18 then 3 else 4 end
                 / 8.0, 4)::double as period_scaled, round((z % 18) / 18.0, 4)::double as column_scaled
    from (select p_partkey, case p_name when '' then 0 else
            case p_size % 6 when 0 then 1 when 1 then 8 when 2 then 11 when 3 then 26 when 4 then 92 else 0 end end as z
          from part)
    """,
)
def lookup_map(t: Tables):
    key = F.col("p_size") % 6
    symbol = F.when(key == 0, "H").when(key == 1, "O").when(key == 2, "Na").when(key == 3, "Fe").when(key == 4, "U")
    z = t.part.select("p_partkey", formulas.atomic_number(symbol.otherwise("Xx")).alias("z"))
    features = formulas.element_features(F.col("z"))
    return z.withColumn("f", features).select(
        "p_partkey", "z", F.round(F.col("f")[0], 4).alias("z_scaled"), F.round(F.col("f")[1], 4).alias("period_scaled"),
        F.round(F.col("f")[2], 4).alias("column_scaled"),
    )


@query(
    "url_id",
    "FN22 SC14",
    r"""select page_id, nullif(regexp_extract(url || case when page_id % 2 = 0 then '/detail/' || page_id else '' end,
               'detail/(\d+)', 1), '') as icsd from pages""",
)
def url_id(t: Tables):
    link = F.concat("url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/detail/"), "page_id")).otherwise(""))
    return t.pages.select("page_id", topo.detail_id(link).alias("icsd"))
