"""Join queries."""

from pyspark.sql import functions as F

from ..operators import joins as jn
from ..operators import ranking
from .registry import Tables, query


def kspace_tables(t: Tables):
    """Driver tables in the shape of the band-representation tables (SURVEY role map)."""
    irreps = t.lineitem.select(
        F.col("l_orderkey").alias("ebr_id"),
        F.concat(F.lit("K"), F.col("l_linenumber")).alias("k_point"),
        F.concat("l_returnflag", "l_linestatus").alias("irrep_label"),
        F.col("l_quantity").cast("int").alias("multiplicity"),
        F.lit(0).alias("space_group_id"),
    )
    ebrs = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("space_group_id"),
        F.col("o_orderpriority").alias("orbital_label"), F.col("o_orderstatus").alias("notes"),
        F.lit(None).alias("created_at"), F.lit(None).alias("updated_at"),
    )
    groups = t.nation.select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") + 1).alias("number"))
    branches = t.orders.where("o_orderkey % 3 = 0").select(
        F.col("o_orderkey").alias("ebr_id"),
        F.explode(F.sequence(F.lit(1), (F.col("o_orderkey") % 2 + 1).cast("int"))).alias("decomposition_index"),
        F.col("o_orderstatus").alias("branch1_irreps"),
    )
    return irreps, ebrs, groups, branches


@query(
    "kspace_join",
    "JN1",
    """
    select c_nationkey + 1 as space_group_number, decomposition_index, count(*) as n, sum(l_quantity::int)::bigint as multiplicity
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
         join nation on n_nationkey = c_nationkey
         left join (select o_orderkey as ebr_id, unnest(generate_series(1, o_orderkey % 2 + 1))::int as decomposition_index
                    from orders where o_orderkey % 3 = 0) on ebr_id = o_orderkey
    group by all
    """,
)
def kspace_join(t: Tables):
    rows = jn.kspace_rows(*kspace_tables(t))
    return rows.groupBy("space_group_number", "decomposition_index").agg(
        F.count("*").alias("n"), F.sum("multiplicity").alias("multiplicity")
    )


@query(
    "keyed_scan",
    "SC4",
    "select o_orderkey, o_totalprice, o_orderpriority from orders where o_custkey = 7",
)
def keyed_scan(t: Tables):
    return t.orders.where(F.col("o_custkey") == 7).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query(
    "inner_list",
    "JN2",
    """select s_suppkey as id, n_nationkey as number, s_name as orbital_label from supplier join nation on s_nationkey = n_nationkey
       where n_regionkey = 2""",
)
def inner_list(t: Tables):
    ebrs = t.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("space_group_id"), F.col("s_name").alias("orbital_label")
    )
    groups = t.nation.where("n_regionkey = 2").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("number"))
    return jn.ebrs_of_groups(ebrs, groups).select("id", "number", "orbital_label").orderBy("id")


@query(
    "three_way",
    "JN3",
    """
    select c_nationkey, l_linenumber as k_point, count(*) as n, count(distinct o_orderkey) as ebrs
    from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey
    where c_mktsegment = 'MACHINERY' group by all
    """,
)
def three_way(t: Tables):
    customers = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = t.orders.select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    lines = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("k_point"))
    joined = customers.join(orders, "o_custkey").join(lines, "l_orderkey")
    return joined.groupBy("c_nationkey", "k_point").agg(
        F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("ebrs")
    ).orderBy("c_nationkey", "k_point")


@query(
    "left_to_map",
    "JN4",
    """
    select c_custkey, coalesce(string_agg(o_orderpriority || '=' || v, ',' order by o_orderpriority), '') as irreps
    from customer left join (select o_custkey, o_orderpriority, max(o_orderstatus) as v from orders where o_orderstatus <> 'F'
                             group by all) on c_custkey = o_custkey group by c_custkey
    """,
)
def left_to_map(t: Tables):
    indices = t.customer.select(F.col("c_custkey").alias("id"))
    values = t.orders.where("o_orderstatus <> 'F'").select(
        F.col("o_custkey").alias("topo_index_id"), F.col("o_orderpriority").alias("irrep_name"),
        F.col("o_orderstatus").alias("value"),
    )
    rows = jn.index_with_irreps(indices, values)
    text = F.transform(F.array_sort(F.map_entries("irreps")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select(F.col("id").alias("c_custkey"), F.concat_ws(",", text).alias("irreps"))


@query(
    "last_wins_join",
    "JN5 WN1",
    """
    with newest as (select o_custkey, o_orderkey, o_orderstatus from orders
                    qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
    select newest.o_orderkey, o_orderstatus, count(*) as n, round(sum(l_extendedprice), 2) as price
    from lineitem join newest on l_orderkey = newest.o_orderkey group by all
    """,
)
def last_wins_join(t: Tables):
    newest = ranking.last_per_key(
        t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"],
        [F.col("o_orderdate"), F.col("o_orderkey")],
    )
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    joined = jn.last_wins(lines, newest.select("o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderkey"], F.col("o_orderdate"))
    return joined.groupBy("o_orderkey", "o_orderstatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )


@query(
    "first_match",
    "JN6 WN1",
    """
    with f as (select l_partkey, l_orderkey, l_linenumber, l_suppkey from lineitem
               qualify row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey) = 1)
    select p_partkey, l_orderkey, l_suppkey, l_orderkey is not null as matched from part left join f on p_partkey = l_partkey
    """,
)
def first_match(t: Tables):
    lookup = t.lineitem.select(
        F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_suppkey"
    )
    joined = jn.first_match(
        t.part.select("p_partkey"), lookup, ["p_partkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    )
    return joined.select("p_partkey", "l_orderkey", "l_suppkey", "matched")


@query(
    "two_key_match",
    "JN7",
    """
    with f as (select s_nationkey, s_suppkey % 5 as slot, min(s_suppkey) as s_suppkey from supplier group by all)
    select c_custkey, s_suppkey from customer left join f on c_nationkey = s_nationkey and c_custkey % 5 = slot
    """,
)
def two_key_match(t: Tables):
    lookup = t.supplier.select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 5).alias("slot"), "s_suppkey")
    facts = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 5).alias("slot"))
    return jn.first_match(facts, lookup, ["nation", "slot"], [F.col("s_suppkey")]).select("c_custkey", "s_suppkey")


@query(
    "fallback_key",
    "JN8",
    r"""
    with c as (select event_id, user_id, value, coalesce(case when event_id % 3 = 0 then k end,
                      case when event_id % 3 = 1 then k + 1 end, user_id) as space_group_number
               from (select *, regexp_extract(props, '\d+')::bigint as k from events)),
    f as (select user_id, space_group_number, event_id, value from c
          qualify row_number() over (partition by user_id, space_group_number order by event_id) = 1)
    select c_custkey, event_id, value from customer join f on user_id = c_custkey and space_group_number = c_nationkey
    """,
)
def fallback_key(t: Tables):
    k = F.get_json_object("props", "$.k").cast("long")
    third = F.col("event_id") % 3
    candidates = t.events.select(
        "event_id", "user_id", "value", F.struct(F.when(third == 0, k).alias("number")).alias("symmetry"),
        F.when(third == 1, k + 1).alias("space_group_number"),
    )
    keyed = jn.candidates_with_group(candidates, "user_id").drop("symmetry")
    facts = t.customer.select(
        "c_custkey", F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("space_group_number")
    )
    joined = jn.first_match(facts, keyed, ["user_id", "space_group_number"], [F.col("event_id")]).where("matched")
    return joined.select("c_custkey", "event_id", "value")


@query(
    "broadcast_default",
    "JN9 SC13",
    """select c_custkey, coalesce(n_name, 'fallback graph') as graph from customer
       left join (select * from nation where n_regionkey <> 1) on c_nationkey = n_nationkey""",
)
def broadcast_default(t: Tables):
    shared = t.nation.where("n_regionkey <> 1").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("graph"))
    joined = jn.with_default(
        t.customer.select("c_custkey", "c_nationkey"), shared, ["c_nationkey"], {"graph": F.lit("fallback graph")}
    )
    return joined.select("c_custkey", "graph")


@query(
    "ranked_like",
    "JN10",
    """
    with m as (select 'JVASP-' || p_partkey as material_id, replace(p_name, ' ', '') as formula, p_partkey % 8 as kind from part),
    files as (
      select case kind when 0 then material_id || '_POSCAR.vasp' when 1 then 'old_' || material_id || '_POSCAR'
                       when 2 then 'x_' || formula || '_POSCAR_' || kind when 3 then 'POSCAR_' || material_id || '.vasp'
                       when 4 then 'POSCAR_' || formula when 5 then 'sub/' || material_id || '_POSCAR'
                       when 6 then 'sub/POSCAR_' || material_id else material_id || '.cif' end as path
      from m),
    f as (select path, split_part(path, '/', -1) as base, case when contains(path, '/') then 1 else 0 end as depth
          from files where contains(path, 'POSCAR')),
    hit as (
      select material_id, path, depth, case when base like material_id || '%POSCAR%' then 0 when base like '%' || material_id || '%POSCAR%' then 1
          when base like '%' || formula || '%POSCAR%' then 2 when base like 'POSCAR%' || material_id || '%' then 3
          when base like 'POSCAR%' || formula || '%' then 4 end as pattern_rank
      from m join f on contains(base, material_id) or contains(base, formula)),
    best as (select material_id, min((depth, pattern_rank, path)) as b from hit where pattern_rank is not null group by material_id)
    select material_id, b[3] as path, b[2]::int as pattern_rank from best
    """,
)
def ranked_like(t: Tables):
    kind = F.col("p_partkey") % 8
    m = t.part.select(
        F.concat(F.lit("JVASP-"), "p_partkey").alias("material_id"), F.replace("p_name", F.lit(" "), F.lit("")).alias("formula"),
        kind.alias("kind"),
    )
    mid, formula = F.col("material_id"), F.col("formula")
    path = (
        F.when(F.col("kind") == 0, F.concat(mid, F.lit("_POSCAR.vasp")))
        .when(F.col("kind") == 1, F.concat(F.lit("old_"), mid, F.lit("_POSCAR")))
        .when(F.col("kind") == 2, F.concat(F.lit("x_"), formula, F.lit("_POSCAR_2")))
        .when(F.col("kind") == 3, F.concat(F.lit("POSCAR_"), mid, F.lit(".vasp")))
        .when(F.col("kind") == 4, F.concat(F.lit("POSCAR_"), formula))
        .when(F.col("kind") == 5, F.concat(F.lit("sub/"), mid, F.lit("_POSCAR")))
        .when(F.col("kind") == 6, F.concat(F.lit("sub/POSCAR_"), mid))
        .otherwise(F.concat(mid, F.lit(".cif")))
    )
    files = m.select(path.alias("path")).select(
        "path", F.substring_index("path", "/", -1).alias("base"), (F.size(F.split("path", "/")) - 1).alias("depth")
    )
    return jn.ranked_file_match(m.select("material_id", "formula"), files).select("material_id", "path", "pattern_rank")


@query(
    "nested_view",
    "JN11",
    """
    select c_nationkey, count(distinct c_custkey) as groups, count(distinct o_orderkey) as ebrs, count(l_orderkey) as irreps,
           coalesce(sum(l_linenumber), 0)::bigint as branch_sum
    from customer left join orders on c_custkey = o_custkey left join lineitem on l_orderkey = o_orderkey group by c_nationkey
    """,
)
def nested_view(t: Tables):
    irreps = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("irreps"), F.sum("l_linenumber").alias("branch_sum")
    )
    ebrs = t.orders.select("o_orderkey", "o_custkey").join(irreps, "o_orderkey", "left").groupBy("o_custkey").agg(
        F.count("*").alias("ebrs"), F.sum("irreps").alias("irreps"), F.sum("branch_sum").alias("branch_sum")
    )
    view = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(ebrs, "o_custkey", "left")
    return view.groupBy("c_nationkey").agg(
        F.count("*").alias("groups"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ebrs", "irreps", "branch_sum")]
    )


@query(
    "missing_numbers",
    "JN12",
    """select string_agg(number, ',' order by number) as missing, count(*) as n from (
         select unnest(generate_series(1, 230))::int as number) where number not in (select p_size * 3 from part)""",
)
def missing_numbers(t: Tables):
    missing = jn.missing_numbers(t.part.select((F.col("p_size") * 3).alias("size")), "size")
    # At most 230 numbers by definition, so one array holds them.
    listed = missing.agg(F.array_sort(F.collect_list("number")).alias("numbers"), F.count("*").alias("n"))
    return listed.select(F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("missing"), "n")


@query(
    "generated_ids",
    "SC16",
    """select 'JVASP-' || i as jid, p_name is not null as stored from (
         select unnest(generate_series(1, (select count(*) * 2 from part))) as i) left join part on p_partkey = i""",
)
def generated_ids(t: Tables):
    from ..sources.catalogue import generated_ids as ids

    stored = t.part.select(F.concat(F.lit("JVASP-"), "p_partkey").alias("jid"), F.lit(True).alias("stored"))
    joined = jn.with_default(ids(t.spark, t.part.count() * 2), stored, ["jid"], {"stored": F.lit(False)})
    return joined.select("jid", "stored")


@query(
    "first_and_count",
    "GR15",
    """select o_custkey, count(*) as n_operations, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first_rotation,
              arg_min(o_orderpriority, (o_orderdate, o_orderkey)) as first_translation from orders group by o_custkey""",
)
def first_and_count(t: Tables):
    first = F.min_by(F.struct("o_orderkey", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey"))
    grouped = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_operations"), first.alias("f"))
    return grouped.select(
        "o_custkey", "n_operations", F.col("f.o_orderkey").alias("first_rotation"),
        F.col("f.o_orderpriority").alias("first_translation"),
    )
