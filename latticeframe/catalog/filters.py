"""Predicate and projection queries."""

from pyspark.sql import functions as F

from ..functions import topology as topo
from ..operators import filters as flt
from .registry import Tables, query


PATTERN = {"p_brand": "Brand#2", "p_type": "PROMO"}


@query(
    "pattern_all",
    "FL1",
    "select p_partkey from part where p_brand = 'Brand#2' and p_type = 'PROMO'",
)
def pattern_all(t: Tables):
    part = t.part
    return part.where(flt.pattern_match({n: part[n] for n in PATTERN}, PATTERN, True)).select("p_partkey")


@query(
    "pattern_any",
    "FL1",
    "select p_partkey from part where p_brand = 'Brand#2' or p_type = 'PROMO' or p_size = 7",
)
def pattern_any(t: Tables):
    part = t.part
    pattern = {**PATTERN, "p_size": 7}
    return part.where(flt.pattern_match({n: part[n] for n in pattern}, pattern, False)).select("p_partkey")


@query(
    "nested_exists",
    "FL2",
    """
    with g as (
      select o_orderkey, (o_orderkey + i) % 6 as num_bands, case when (o_custkey + i) % 2 = 0 then 'NLC' else 'LCEBR' end
               as subclass, (o_orderkey * i) % 5 as label, (o_custkey + i) % 4 as degeneracy
      from (select *, unnest(generate_series(1, 1 + o_custkey % 4)) as i from orders))
    select distinct o_orderkey from g where num_bands = 4 and subclass = 'NLC' and label = 2 and degeneracy >= 2
    """,
)
def nested_exists(t: Tables):
    i_groups = F.transform(
        F.sequence(F.lit(1).cast("long"), 1 + F.col("o_custkey") % 4),
        lambda i: F.struct(
            ((F.col("o_orderkey") + i) % 6).alias("num_bands"),
            F.when((F.col("o_custkey") + i) % 2 == 0, "NLC").otherwise("LCEBR").alias("subclass"),
            F.array(
                F.struct(
                    F.lit("X").alias("k_point"),
                    ((F.col("o_orderkey") * i) % 5).cast("string").alias("irrep_label"),
                    ((F.col("o_custkey") + i) % 4).alias("degeneracy"),
                )
            ).alias("reps"),
        ),
    )
    kept = t.orders.withColumn("groups", i_groups).where(
        flt.has_band_group(F.col("groups"), 4, "NLC", ("X", "2"), min_degeneracy=2)
    )
    return kept.select("o_orderkey").distinct()


@query(
    "ci_filter",
    "FL3 ST2",
    "select c_custkey, c_mktsegment from customer where lower(c_mktsegment) = 'building'",
)
def ci_filter(t: Tables):
    kept = t.customer.where(F.lower("c_mktsegment") == "building")
    return kept.select("c_custkey", "c_mktsegment").orderBy("c_custkey")


@query(
    "binary_label",
    "FL4",
    """select label, count(*) as n from (
         select case when regexp_matches(upper(coalesce(p_type || ' ' || p_name, '')), 'TI|SM|WEYL|DIRAC')
                     then 1.0 else 0.0 end::double as label from part) group by label""",
)
def binary_label(t: Tables):
    text = F.concat_ws(" ", "p_type", "p_name")
    return t.part.select(topo.binary_label(text).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "ordered_class",
    "FL5",
    """
    select p_partkey, case
        when contains(u, 'TI') then 'Topological Insulator' when contains(u, 'SM') then 'Semimetal'
        when contains(u, 'WEYL') then 'Weyl Semimetal' when contains(u, 'DIRAC') then 'Dirac Semimetal'
        when p_size > 25 then 'Topological' else 'Trivial' end as topological_class
    from (select *, upper(p_type || ' ' || case when p_partkey % 7 = 0 then 'ti (nlc)' when p_partkey % 7 = 1
                          then 'Weyl' when p_partkey % 7 = 2 then 'dirac' else p_name end) as u from part)
    """,
)
def ordered_class(t: Tables):
    key = F.col("p_partkey") % 7
    text = F.concat_ws(
        " ", "p_type",
        F.when(key == 0, "ti (nlc)").when(key == 1, "Weyl").when(key == 2, "dirac").otherwise(F.col("p_name")),
    )
    label = F.when(F.col("p_size") > 25, 1.0).otherwise(0.0)
    return t.part.select("p_partkey", topo.topological_class(text, label).alias("topological_class"))


@query(
    "ordered_class2",
    "FL6",
    """
    select class, count(*) as n, sum(o_orderkey)::bigint as key_sum from (
      select o_orderkey, case when contains(u, 'SM') or contains(u, 'ESFD') then 'SM'
             when contains(u, 'TI') or contains(u, 'NLC') then 'TI'
             when contains(u, 'TRIVIAL') or contains(u, 'LCEBR') then 'trivial' else 'unknown' end as class
      from (select o_orderkey, upper(case o_custkey % 3 when 0 then 'ti ' when 1 then 'trivial (' else '' end
                                     || o_orderpriority) as u from orders)) group by class
    """,
)
def ordered_class2(t: Tables):
    key = F.col("o_custkey") % 3
    text = F.concat(F.when(key == 0, "ti ").when(key == 1, "trivial (").otherwise(""), "o_orderpriority")
    classed = t.orders.select("o_orderkey", topo.short_class(text).alias("class"))
    return classed.groupBy("class").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query(
    "leading_int",
    "FL7 FL9",
    """select priority, count(*) as n from (
         select try_cast(split_part(trim(case when o_orderkey % 11 = 0 then '(x) ' else '' end || o_orderpriority), '-', 1)
                         as int) as priority from orders) where priority is not null group by priority""",
)
def leading_int(t: Tables):
    text = F.concat(F.when(F.col("o_orderkey") % 11 == 0, "(x) ").otherwise(""), "o_orderpriority")
    parsed = t.orders.where(~topo.is_blank("o_orderpriority")).select(topo.leading_integer(text, "-").alias("priority"))
    return parsed.where(F.col("priority").isNotNull()).groupBy("priority").agg(F.count("*").alias("n"))


@query(
    "consistent_pairs",
    "FL8",
    """
    select s_nationkey as catalogue_group, count(*) as n, round(sum(l_quantity), 2) as quantity
    from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey
         join customer on o_custkey = c_custkey
    where s_nationkey is null or s_nationkey = 0 or s_nationkey = c_nationkey group by s_nationkey
    """,
)
def consistent_pairs(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity")
    joined = (
        lines.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    )
    kept = joined.where(topo.group_matches(F.col("s_nationkey"), F.col("c_nationkey")))
    return kept.groupBy(F.col("s_nationkey").alias("catalogue_group")).agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    "validate_rows",
    "FL10",
    """
    select problems, count(*) as n from (
      select concat_ws(',', case when len(words) = 0 then 'empty words' end,
                            case when quality is null then 'null quality' end,
                            'missing crystal_graph') as problems
      from (select d.doc_id, regexp_extract_all(text, '[A-Z][a-z]{9,}') as words, quality
            from documents d left join labels l on d.doc_id = l.doc_id)) group by problems
    """,
)
def validate_rows(t: Tables):
    words = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{9,}"), F.lit(0))
    joined = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left").select(
        "doc_id", words.alias("words"), "quality"
    )
    required = ("words", "quality", "crystal_graph")
    problems = flt.record_problems(joined, required, vectors=("words",), present=("quality",))
    return joined.select(F.concat_ws(",", problems).alias("problems")).groupBy("problems").agg(F.count("*").alias("n"))


TAGS = ("<nav>", "<article>", "<table", "<footer", "<h2>")


@query(
    "missing_sections",
    "FL11",
    "select page_id, concat_ws(',', "
    + ", ".join(f"case when not contains(html, '{tag}') then '{tag}' end" for tag in TAGS)
    + ") as missing from pages",
)
def missing_sections(t: Tables):
    return t.pages.select("page_id", F.concat_ws(",", flt.missing_sections(F.col("html"), TAGS)).alias("missing"))


@query(
    "map_drop_null",
    "FL12",
    """select event_id, concat_ws(',', case when event_type <> 'click' then 'event_type=' || event_type end,
              case when value >= 20 then 'value=' || floor(value)::bigint end, 'user=' || user_id) as properties from events""",
)
def map_drop_null(t: Tables):
    properties = F.create_map(
        F.lit("event_type"), F.when(F.col("event_type") != "click", F.col("event_type")),
        F.lit("value"), F.when(F.col("value") >= 20, F.floor("value").cast("string")),
        F.lit("user"), F.col("user_id").cast("string"),
    )
    kept = F.map_entries(flt.drop_null_properties(properties))
    text = F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return t.events.select("event_id", F.concat_ws(",", text).alias("properties"))


@query(
    "derived_struct",
    "FL13 FL14",
    """
    select o_orderkey, coalesce(hull, 0.0) <= 0.025 as is_stable, gap = 0 as is_metal, gap as band_gap,
           coalesce(magnetization, 0.0) as magnetization
    from (select o_orderkey, case when o_orderkey % 3 > 0 then (o_custkey % 10) / 100.0 end::double as hull,
                 case when o_orderkey % 4 > 0 then o_custkey % 5 end::double as gap,
                 case when o_orderkey % 5 > 0 then o_custkey % 7 end::double as magnetization from orders)
    """,
)
def derived_struct(t: Tables):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    source = t.orders.select(
        "o_orderkey",
        F.when(key % 3 > 0, (cust % 10) / 100.0).alias("energy_above_hull"),
        F.when(key % 4 > 0, (cust % 5).cast("double")).alias("band_gap"),
        F.when(key % 5 > 0, (cust % 7).cast("double")).alias("total_magnetization"),
        F.lit(None).cast("double").alias("formation_energy_per_atom"),
        F.lit(None).cast("boolean").alias("is_gap_direct"),
        F.lit(None).cast("double").alias("cbm"),
        F.lit(None).cast("double").alias("vbm"),
    )
    stability, electronic = topo.property_structs()
    built = source.select("o_orderkey", "total_magnetization", stability.alias("stability"), electronic.alias("electronic"))
    return built.select(
        "o_orderkey", "stability.is_stable", "electronic.is_metal", "electronic.band_gap",
        F.coalesce("total_magnetization", F.lit(0.0)).alias("magnetization"),
    )
