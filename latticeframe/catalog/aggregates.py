"""Aggregation queries."""

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import ranking
from .registry import Tables, query


@query(
    "store_status",
    "AG1 AG2 AG15",
    """
    select 'customer' as table_name, count(*) as n_rows, min(c_nationkey)::bigint as first_group,
           max(c_nationkey)::bigint as last_group, round(count(distinct c_nationkey) / 230.0 * 100, 4)::double as percent
    from customer
    union all select 'orders', count(*), min(o_custkey), max(o_custkey),
           round(count(distinct o_custkey) / 230.0 * 100, 4)::double from orders
    union all select 'lineitem', count(*), null, null, null from lineitem
    """,
)
def store_status(t: Tables):
    counts = agg.row_counts(
        {"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem},
        {"customer": "c_nationkey", "orders": "o_custkey"},
    )
    held = t.customer.agg(F.count_distinct("c_nationkey").alias("held")).select(F.lit("customer").alias("table_name"), "held")
    held = held.unionByName(
        t.orders.agg(F.count_distinct("o_custkey").alias("held")).select(F.lit("orders").alias("table_name"), "held")
    )
    joined = counts.join(held, "table_name", "left")
    return joined.withColumn("percent", F.round(F.col("held") / F.lit(230) * 100, 4)).drop("held")


@query(
    "vocab",
    "AG3 WN3",
    """
    select kind, value, (row_number() over (partition by kind order by value) - 1)::bigint as idx from (
      select distinct 'irrep' as kind, event_type as value from events
      union select distinct 'k_point', p_brand || ' ' || p_name from part)
    """,
)
def vocab(t: Tables):
    values = t.events.select(F.lit("irrep").alias("kind"), F.col("event_type").alias("value")).unionByName(
        t.part.select(F.lit("k_point").alias("kind"), F.concat_ws(" ", "p_brand", "p_name").alias("value"))
    )
    return ranking.dense_index(values, ["kind"], "value", "idx")


@query("value_counts", "AG5", "select l_linestatus, l_returnflag, count(*) as n from lineitem group by all")
def value_counts(t: Tables):
    return agg.value_counts(t.lineitem, ["l_linestatus"], "l_returnflag")


@query(
    "collect_sets",
    "AG6 AG11 AG14",
    r"""
    select user_id, 'event_type' as kind, event_type as value from events group by all
    union all select user_id, 'day', strftime(ts, '%Y-%m-%d') from events group by all
    """,
)
def collect_sets(t: Tables):
    events = t.events.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return agg.distinct_values(events, ["user_id"], ["event_type", "day"])


@query(
    "mode_or_mean",
    "AG7",
    """
    with c as (select o_orderpriority, o_custkey % 7 as z2_0, count(*) as n from orders group by all),
    m as (select o_orderpriority, z2_0 from c qualify row_number() over (partition by o_orderpriority order by n desc, z2_0) = 1)
    select m.o_orderpriority, z2_0::int as z2_0, round(avg(o_totalprice), 2) as berry_phase
    from m join orders o on o.o_orderpriority = m.o_orderpriority group by all
    """,
)
def mode_or_mean(t: Tables):
    rows = t.orders.select(
        "o_orderpriority", (F.col("o_custkey") % 7).cast("int").alias("z2_0"), F.col("o_totalprice").alias("berry_phase")
    )
    result = agg.index_consensus(rows, ["o_orderpriority"])
    return result.withColumn("berry_phase", F.round("berry_phase", 2))


def _flat(df, keys, digits=4):
    return df.select(*keys, *[F.round(F.col("features")[i], digits).alias(f"f{i}") for i in range(10)])


@query(
    "group_features",
    "AG8",
    """
    select user_id, round(avg(sqrt(value)), 4) as f0, round(coalesce(stddev_samp(sqrt(value)), 0), 4) as f1,
           round(min(sqrt(value)), 4) as f2, round(max(sqrt(value)), 4) as f3,
           count(distinct event_id % 9)::double as f4, count(distinct event_type)::double as f5,
           count(distinct event_id % 4)::double as f6, round(avg(abs((event_id % 5) - 2)), 4)::double as f7,
           count(distinct dayofmonth(ts))::double as f8, 0.0::double as f9
    from events group by user_id
    """,
)
def group_features(t: Tables):
    event = F.col("event_id")
    rows = t.events.select(
        "user_id", F.sqrt("value").alias("energy"), (event % 9).alias("band_index"), F.col("event_type").alias("irrep_label"),
        (event % 4).alias("ebr_label"), ((event % 5) - 2).alias("z2_0"), F.dayofmonth("ts").alias("site_symmetry"),
    )
    return _flat(agg.kpoint_features(rows, ["user_id"], indices=("z2_0",)), ["user_id"])


@query(
    "group_features2",
    "AG9",
    """
    select l_partkey, round(avg(sqrt(l_extendedprice)), 4) as f0, round(coalesce(stddev_samp(sqrt(l_extendedprice)), 0), 4) as f1,
           count(*)::double as f2, count(distinct l_linenumber)::double as f3, count(distinct l_quantity::int)::double as f4,
           count(case when l_returnflag = 'R' then 1 end)::double as f5, 0.0::double as f6, 0.0::double as f7,
           0.0::double as f8, 0.0::double as f9
    from lineitem group by l_partkey
    """,
)
def group_features2(t: Tables):
    rows = t.lineitem.select(
        "l_partkey", F.sqrt("l_extendedprice").alias("energy"), F.col("l_linenumber").alias("band_index"),
        F.col("l_quantity").cast("int").alias("decomposition_index"),
        F.when(F.col("l_returnflag") == "R", F.lit("b")).alias("branch1_irreps"),
    )
    return _flat(agg.irrep_features(rows, ["l_partkey"]), ["l_partkey"])


@query(
    "group_features3",
    "AG10",
    """
    select l_suppkey, count(*)::double as f0, count(distinct l_linenumber)::double as f1,
           count(distinct l_returnflag || l_linestatus)::double as f2, count(case when l_returnflag = 'R' then 1 end)::double as f3,
           count(case when l_returnflag = 'A' then 1 end)::double as f4, 0.0::double as f5, 0.0::double as f6,
           0.0::double as f7, 0.0::double as f8, 0.0::double as f9
    from lineitem group by l_suppkey
    """,
)
def group_features3(t: Tables):
    rows = t.lineitem.select(
        "l_suppkey", F.col("l_linenumber").alias("k_point"), F.concat("l_returnflag", "l_linestatus").alias("irrep_label"),
        F.when(F.col("l_returnflag") == "R", "b").alias("branch1_irreps"),
        F.when(F.col("l_returnflag") == "A", "b").alias("branch2_irreps"),
    )
    return _flat(agg.decomposition_features(rows, ["l_suppkey"]), ["l_suppkey"])


@query(
    "split_flatten",
    "AG12",
    "select p_brand, trim(w) as value from (select p_brand, unnest(string_split(p_name || ' ,' || p_type, ' ')) as w from part)"
    " where trim(w) <> '' and trim(w) <> ',' and not starts_with(w, ',') group by all"
    " union select p_brand, ',' || p_type from part",
)
def split_flatten(t: Tables):
    rows = t.part.select("p_brand", F.concat("p_name", F.lit(" ,"), "p_type").alias("words"))
    return agg.split_values(rows, ["p_brand"], "words", " ")


@query(
    "ordered_arrays",
    "AG13",
    """
    select l_orderkey, l_linenumber as band_index, round(e, 2) as energy,
           row_number() over (partition by l_orderkey order by e, l_linenumber) as position
    from (select l_orderkey, l_linenumber, min(l_extendedprice) as e from lineitem group by all)
    """,
)
def ordered_arrays(t: Tables):
    # One row per (k-point, band) first, so a k-point holds at most as many rows as there are bands.
    bands = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("band_index")).agg(
        F.min("l_extendedprice").alias("energy")
    )
    ranked = ranking.row_numbers(
        bands, ["l_orderkey"], F.floor(F.col("energy") / 1e7), [F.col("energy"), F.col("band_index")], "position"
    )
    return ranked.withColumn("energy", F.round("energy", 2))


@query(
    "match_rate",
    "AG15",
    """select count(*) as processed, count(quality) as matched, round(count(quality) / greatest(count(*), 1), 6) as match_rate
       from documents d left join labels l on d.doc_id = l.doc_id""",
)
def match_rate(t: Tables):
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return agg.match_rate(joined, F.col("quality").isNotNull()).withColumn("match_rate", F.round("match_rate", 6))


@query(
    "class_stats",
    "AG16 PL6",
    """
    with c as (select p_partkey, case when s is null then 'error' when contains(upper(s), 'SM') or contains(upper(s), 'ESFD') then 'SM'
                      when contains(upper(s), 'TI') or contains(upper(s), 'NLC') then 'TI'
                      when contains(upper(s), 'TRIVIAL') or contains(upper(s), 'LCEBR') then 'trivial' else 'unknown' end as class
               from (select p_partkey, case p_size % 5 when 0 then null when 1 then 'SM (ES)' when 2 then 'TI (NLC)'
                            when 3 then 'trivial (LCEBR)' else p_type end as s from part))
    select count(*) as total, count(case when class in ('SM', 'TI') then 1 end) as topological,
           count(case when class = 'SM' then 1 end) as sm, count(case when class = 'TI' then 1 end) as ti,
           count(case when class = 'trivial' then 1 end) as trivial, count(case when class = 'error' then 1 end) as errors,
           count(case when class not in ('SM', 'TI', 'error') then 1 end) as non_topological from c
    """,
)
def class_stats(t: Tables):
    from ..plans.reports import class_report

    kind = F.col("p_size") % 5
    catalogue = t.part.where(kind != 0).select(
        "p_partkey",
        F.when(kind == 1, "SM (ES)").when(kind == 2, "TI (NLC)").when(kind == 3, "trivial (LCEBR)").otherwise(F.col("p_type"))
        .alias("Property"),
    )
    return class_report(t.part.select("p_partkey"), catalogue, ["p_partkey"], F.col("p_partkey"))


@query(
    "token_counts",
    "AG18",
    r"""
    select doc_id, count(*) as elements, sum(n)::bigint as atoms, max(n)::bigint as largest from (
      select doc_id, w, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]?')) as w from documents)
      group by all) group by doc_id
    """,
)
def token_counts(t: Tables):
    words = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]?"), F.lit(0))).alias("w"))
    counts = words.groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(
        F.count("*").alias("elements"), F.sum("n").alias("atoms"), F.max("n").alias("largest")
    )


@query(
    "composition_stats",
    "AG20 FV14",
    """
    select l_orderkey, round(avg(l_linenumber), 4) as z_mean, round(stddev_pop(l_linenumber), 4) as z_std,
           min(l_linenumber) as z_min, max(l_linenumber) as z_max, count(distinct l_linenumber) as n_elements, count(*) as n_atoms
    from lineitem group by l_orderkey
    """,
)
def composition_stats(t: Tables):
    stats = agg.composition_statistics(t.lineitem, ["l_orderkey"], "l_linenumber")
    return stats.withColumn("z_mean", F.round("z_mean", 4)).withColumn("z_std", F.round("z_std", 4))


@query(
    "vector_sizes",
    "AG21",
    "select label, count(*) as records, min(len(embedding))::int as width, sum(len(embedding))::bigint as total from embeddings group by label",
)
def vector_sizes(t: Tables):
    sized = t.embeddings.select("label", F.size("embedding").alias("w"))
    return sized.groupBy("label").agg(F.count("*").alias("records"), F.min("w").alias("width"), F.sum("w").alias("total"))


@query("distinct_values", "AG4 SC3", "select distinct p_type from part")
def distinct_values(t: Tables):
    from ..session import scratch_path
    from ..sources.catalogue import read_delimited_column

    path = scratch_path(t.spark, "delimited")
    t.part.select("p_partkey", "p_type", "p_size").write.option("header", True).option("sep", ";").csv(path)
    return read_delimited_column(t.spark, path, "p_type").distinct().orderBy("p_type")


@query("first_n_parts", "SC2 ST3", "select p_partkey, p_name from part order by p_partkey limit 25")
def first_n_parts(t: Tables):
    from ..sources.catalogue import first_rows

    return first_rows(t.part.select("p_partkey", "p_name"), [F.col("p_partkey")], 25)
