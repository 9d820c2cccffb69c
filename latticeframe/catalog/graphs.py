"""Graph queries.

Vertices are distinct values of a small domain (days, line numbers, priorities), so
the vertex count of one graph does not grow with the data; the facts behind them do.
"""

from pyspark.sql import functions as F

from ..operators import graphs as gr
from .registry import Tables, query


def user_days(t: Tables):
    """Events as k-space facts: graph = user, k-point = day, irrep = event type, energy = value."""
    return t.events.select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("k_point"), F.col("event_type").alias("irrep_label"),
        F.sqrt("value").alias("energy"), (F.col("event_id") % 9).alias("band_index"),
    )


DAYS_SQL = """
    with d as (select user_id, strftime(ts, '%Y-%m-%d') as k, event_type, sqrt(value) as energy, event_id from events),
    n as (select user_id, k, avg(energy) as mean, (row_number() over (partition by user_id order by k) - 1)::bigint as idx
          from d group by user_id, k)
"""


def _nodes(t: Tables):
    return gr.vertices(user_days(t), ["user_id"])


@query(
    "node_index",
    "WN3",
    DAYS_SQL + "select user_id, k as key, idx from n",
)
def node_index(t: Tables):
    return gr.node_index(user_days(t), ["user_id"], "k_point").withColumnRenamed("k_point", "key")


@query(
    "graph_vertices",
    "GR1",
    DAYS_SQL
    + """, f as (select user_id, k, round(avg(energy), 4) as f0, round(coalesce(stddev_samp(energy), 0), 4) as f1,
                 count(distinct event_id % 9)::double as f4, count(distinct event_type)::double as f5 from d group by all)
      select n.user_id, n.k as key, idx, f0, f1, f4, f5, 10::int as width from n join f on n.user_id = f.user_id and n.k = f.k
      union all select user_id, event_type || ' irrep', (row_number() over (partition by user_id order by event_type) - 1)::bigint,
                round(avg(energy), 4), round(coalesce(stddev_samp(energy), 0), 4), 0.0, 0.0, 10 from d group by user_id, event_type
      union all select user_id, 'default', 0, 0.0, 0.0, 0.0, 0.0, 10 from d group by user_id""",
)
def graph_vertices(t: Tables):
    facts = user_days(t)
    by_point = gr.vertices(facts, ["user_id"])
    by_irrep = gr.vertices(facts.drop("k_point"), ["user_id"]).withColumn("key", F.concat("key", F.lit(" irrep")))
    single = gr.vertices(facts.select("user_id"), ["user_id"])
    rows = by_point.unionByName(by_irrep).unionByName(single)
    f = F.col("features")
    picked = [F.round(f[0], 4).alias("f0"), F.round(f[1], 4).alias("f1")]
    # Distinct bands and irreps are features of k-points only.
    for i in (4, 5):
        picked.append(F.when(F.col("key").rlike("^[0-9-]+$"), f[i]).otherwise(0.0).alias(f"f{i}"))
    return rows.select("user_id", "key", "idx", *picked, F.size(f).alias("width"))


MEMBERS_SQL = """
    with m as (select distinct l_orderkey, l_returnflag || l_linestatus as shared, l_linenumber::bigint as idx from lineitem),
    s as (select l_orderkey, shared, count(*) as members from m group by all having count(*) > 1)
"""


@query(
    "clique_edges",
    "GR2",
    MEMBERS_SQL
    + """select m.l_orderkey, m.shared, m.idx as src, null::bigint as dst, 0.8::double as weight, members
         from m join s on m.l_orderkey = s.l_orderkey and m.shared = s.shared""",
)
def clique_edges(t: Tables):
    edges = gr.clique_edges(_line_members(t), ["l_orderkey"], "shared", gr.SYMMETRY_WEIGHT, "symmetry")
    return edges.select("l_orderkey", "shared", "src", "dst", "weight", "members")


def _line_members(t: Tables):
    """Graph = order, k-point = line number, shared irrep = status flags."""
    return t.lineitem.select(
        "l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("shared"), F.col("l_linenumber").cast("long").alias("idx")
    )


@query(
    "clique_edges2",
    "GR3",
    """
    with m as (select distinct l_partkey % 10 as g, l_partkey::varchar as shared, l_suppkey as idx from lineitem),
    s as (select g, shared, count(*) as members from m group by all having count(*) > 1)
    select m.g, m.shared, m.idx as src, null::bigint as dst, s.members from m join s on m.g = s.g and m.shared = s.shared
    """,
)
def clique_edges2(t: Tables):
    edges = gr.clique_edges(_supplier_members(t), ["g"], "shared", gr.DECOMPOSITION_WEIGHT, "decomposition")
    return edges.select("g", "shared", "src", "dst", "members")


def _supplier_members(t: Tables):
    """Suppliers sharing a part."""
    return t.lineitem.select(
        (F.col("l_partkey") % 10).alias("g"), F.col("l_partkey").alias("shared"), F.col("l_suppkey").alias("idx")
    )


@query(
    "graph_meta",
    "GR10 SK9",
    """
    with m as (select distinct l_partkey % 10 as g, l_partkey as shared, l_suppkey as idx from lineitem),
    s as (select g, shared, count(*) as k from m group by all)
    select s.g, n.nodes as num_nodes, sum(k * (k - 1) // 2)::bigint as num_edges, 10::int as feature_dim
    from s join (select g, count(distinct idx) as nodes from m group by g) n on n.g = s.g group by s.g, n.nodes
    """,
)
def graph_meta(t: Tables):
    members = _supplier_members(t)
    nodes = members.select("g", "idx").distinct()
    edges = gr.clique_edges(members, ["g"], "shared", gr.DECOMPOSITION_WEIGHT, "decomposition")
    return gr.graph_meta(nodes, edges, ["g"])


@query(
    "adjacency",
    "GR7",
    MEMBERS_SQL
    + """, e as (select m.l_orderkey, m.idx as src, null::bigint as dst, 'symmetry|' || m.shared as clique
                 from m join s on m.l_orderkey = s.l_orderkey and m.shared = s.shared),
      n as (select distinct l_orderkey, l_linenumber::bigint - 1 as idx from lineitem),
      p as (select l_orderkey, idx as src, lead(idx) over (partition by l_orderkey order by idx) as dst from n)
      select l_orderkey, src, dst, clique from e
      union all select l_orderkey, src, dst, null from p where dst is not null
      union all select l_orderkey, dst, src, null from p where dst is not null""",
)
def adjacency(t: Tables):
    members = _line_members(t)
    cliques = gr.clique_edges(members, ["l_orderkey"], "shared", gr.SYMMETRY_WEIGHT, "symmetry")
    paths = gr.path_edges(members.select("l_orderkey", (F.col("idx") - 1).alias("idx")).distinct(), ["l_orderkey"])
    wide = paths.select("l_orderkey", "kind", F.lit(None).cast("string").alias("shared"), "src", "dst", "weight", F.lit(None).cast("long").alias("members"))
    return gr.adjacency(cliques.unionByName(wide), ["l_orderkey"])


@query(
    "path_edges",
    "GR5 WN2",
    DAYS_SQL
    + """select user_id, idx as src, idx + 1 as dst, round(1 / (1 + abs(nxt - mean)), 6) as weight
         from (select *, lead(mean) over (partition by user_id order by idx) as nxt from n) where nxt is not null""",
)
def path_edges(t: Tables):
    nodes = _nodes(t).withColumn("mean", F.col("features")[0])
    edges = gr.path_edges(nodes, ["user_id"], "mean")
    return edges.select("user_id", "src", "dst", F.round("weight", 6).alias("weight"))


@query(
    "chain_edges",
    "WN2",
    """
    select l_suppkey, k as src, nxt as dst from (
      select l_suppkey, k, lead(k) over (partition by l_suppkey order by k) as nxt from (
        select distinct l_suppkey, l_partkey as k from lineitem)) where nxt is not null
    """,
)
def chain_edges(t: Tables):
    from ..operators.ranking import next_value

    keys = t.lineitem.select("l_suppkey", F.col("l_partkey").alias("src")).distinct()
    linked = next_value(keys, ["l_suppkey"], F.floor(F.col("src") / 1024), [F.col("src")], "src", "dst")
    return linked.where(F.col("dst").isNotNull())


@query(
    "chain_fallback",
    "GR6 GR14",
    """
    with n as (select distinct l_orderkey, l_linenumber as k from lineitem),
    m as (select distinct l_orderkey, l_suppkey, l_linenumber as k from lineitem),
    e as (select distinct a.l_orderkey from m a join m b on a.l_orderkey = b.l_orderkey and a.l_suppkey = b.l_suppkey and a.k < b.k),
    i as (select l_orderkey, (row_number() over (partition by l_orderkey order by k) - 1)::bigint as idx,
                 count(*) over (partition by l_orderkey) as c from n where l_orderkey not in (select l_orderkey from e))
    select l_orderkey, idx as src, idx + 1 as dst, 1.0::double as weight from i where idx < c - 1
    union all select o_orderkey, i, i + 1, 1.0 from orders, (values (0), (1), (2)) v(i)
    where o_orderkey not in (select l_orderkey from lineitem)
    """,
)
def chain_fallback(t: Tables):
    lines = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("string").alias("k_point"), "l_suppkey")
    nodes = gr.node_index(lines, ["l_orderkey"], "k_point")
    linked = gr.linked_graphs(lines, ["l_orderkey"], "l_suppkey", "k_point")
    chains = gr.chain_fallback(nodes, linked, ["l_orderkey"])
    empty = t.orders.select(F.col("o_orderkey").alias("l_orderkey")).join(lines.select("l_orderkey").distinct(), "l_orderkey", "left_anti")
    _, fallback = gr.fallback_graphs(empty, ["l_orderkey"])
    return chains.unionByName(fallback).select("l_orderkey", "src", "dst", "weight")


@query(
    "attr_graph",
    "GR8",
    """
    with g as (select o_orderkey, i, case when r = 1 then 'GM' when (o_custkey + i) % 2 = 0 then 'X' else 'M' end as k,
                      (o_custkey + i * r) % 9 as label
               from (select *, unnest(generate_series(1, o_custkey % 3 + 1)) as i from orders), (values (1), (2)) v(r)),
    n as (select o_orderkey, k, count(*) as entries, string_agg((i - 1) || ':' || label, ',' order by i) as listed from g group by all),
    s as (select *, lead(k) over (partition by o_orderkey order by k) as nxt from n)
    select o_orderkey, k as k_point, entries::int as num_entries, listed, k || '-' || nxt as edge from s
    """,
)
def attr_graph(t: Tables):
    cust = F.col("o_custkey")
    groups = F.transform(
        F.sequence(F.lit(1), (cust % 3 + 1).cast("int")),
        lambda i: F.struct(
            i.alias("num_bands"), F.lit("NLC").alias("subclass"),
            F.array(
                *[
                    F.struct(
                        (F.lit("GM") if r == 1 else F.when((cust + i) % 2 == 0, "X").otherwise("M")).alias("k_point"),
                        ((cust + i * r) % 9).cast("string").alias("irrep_label"), F.lit(1).alias("degeneracy"),
                    )
                    for r in (1, 2)
                ]
            ).alias("reps"),
        ),
    )
    nodes = gr.band_graph_nodes(t.orders.select("o_orderkey", groups.alias("band_groups")), "o_orderkey")
    edges = gr.band_graph_edges(nodes, "o_orderkey").select("o_orderkey", F.col("src").alias("idx"), F.col("label").alias("edge"))
    listed = F.transform("entries", lambda e: F.concat_ws(":", e["band_group"].cast("string"), e["irrep_label"]))
    return nodes.join(edges, ["o_orderkey", "idx"], "left").select(
        "o_orderkey", "k_point", "num_entries", F.array_join(listed, ",").alias("listed"), "edge"
    )


@query(
    "bidirectional",
    "GR9",
    DAYS_SQL
    + """, c as (select user_id, idx, max(idx) over (partition by user_id) as last from n)
      select user_id, idx as src, idx + 1 as dst from c where idx < last
      union all select user_id, idx + 1, idx from c where idx < last""",
)
def bidirectional(t: Tables):
    nodes = gr.node_index(user_days(t), ["user_id"], "k_point")
    return gr.both_ways(gr.path_edges(nodes, ["user_id"])).select("user_id", "src", "dst")


@query(
    "line_graph",
    "GR13",
    """
    with e as (select distinct c_nationkey as g, o_custkey % 40 as src, o_orderkey % 40 as dst from orders join customer on o_custkey = c_custkey
               where o_custkey % 40 <> o_orderkey % 40)
    select g, src as a, dst as via, null::bigint as b, 'in' as role from e where (g, dst) in (select (g, src) from e)
    union all select g, null, src, dst, 'out' from e where (g, src) in (select (g, dst) from e)
    """,
)
def line_graph(t: Tables):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    edges = joined.select(
        F.col("c_nationkey").alias("g"), (F.col("o_custkey") % 40).alias("src"), (F.col("o_orderkey") % 40).alias("dst")
    ).where("src <> dst").distinct()
    return gr.line_graph(edges, ["g"])


PLANE_SQL = """
    with p as (select p_size as x, p_retailprice as y, min(p_partkey) as id, count(*) as copies from part group by all),
    e as (select a.id as src, b.id as dst, a.copies as src_copies, b.copies as dst_copies,
                 sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d
          from p a join p b on a.id < b.id and abs(a.x - b.x) <= 1.05 and abs(a.y - b.y) <= 1.05)
"""


def _plane(t: Tables):
    points = t.part.select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return gr.near_pairs(points, [], "p_partkey", ["x", "y"], 1.05)


@query(
    "range_neighbours",
    "GR11",
    PLANE_SQL + "select src, dst, src_copies, dst_copies, round(d, 6) as distance from e where d <= 1.05",
)
def range_neighbours(t: Tables):
    return _plane(t).withColumn("distance", F.round("distance", 6))


@query(
    "knn_edges",
    "GR12",
    """
    with p as (select p_partkey as id, p_size as x, p_retailprice as y from part),
    e as (select a.id as src, b.id as dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d
          from p a join p b on a.id <> b.id and abs(a.x - b.x) <= 1.05 and abs(a.y - b.y) <= 1.05),
    r as (select *, row_number() over (partition by src order by d, dst)::int as rank, min(d) over (partition by src) as low
          from e where d <= 1.05)
    select src, dst, rank, round(d, 6) as distance, round(case when d > 0 then low / d else 1.0 end, 6) as weight from r where rank <= 3
    """,
)
def knn_edges(t: Tables):
    points = t.part.select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    edges = gr.nearest_edges(points, [], "p_partkey", ["x", "y"], 1.05, 3)
    return edges.withColumn("distance", F.round("distance", 6)).withColumn("weight", F.round("weight", 6))


@query(
    "periodic_neighbours",
    "GR11",
    """
    with s as (select s_suppkey, 3.0 + s_suppkey % 3 as a, i - 1 as site, (i - 1) * 1.5 as x, ((s_suppkey + i) % 4) * 0.5 as y
               from supplier, (values (1), (2)) v(i)),
    n as (select unnest(generate_series(-2, 2)) as n)
    select p.s_suppkey, p.site::int as src, q.site::int as dst, n1.n::int as n0, n2.n::int as n1, n3.n::int as n2,
           round(sqrt((q.x + n1.n * p.a - p.x)**2 + (q.y + n2.n * 4 - p.y)**2 + (n3.n * 5)**2), 6) as distance
    from s p join s q on p.s_suppkey = q.s_suppkey, n n1, n n2, n n3
    where sqrt((q.x + n1.n * p.a - p.x)**2 + (q.y + n2.n * 4 - p.y)**2 + (n3.n * 5)**2) <= 5.2
      and not (p.site = q.site and n1.n = 0 and n2.n = 0 and n3.n = 0)
    """,
)
def periodic_neighbours(t: Tables):
    key = F.col("s_suppkey")
    zero = F.lit(0.0)
    lattice = F.array(
        F.array((3.0 + key % 3).cast("double"), zero, zero), F.array(zero, F.lit(4.0), zero), F.array(zero, zero, F.lit(5.0))
    )
    sites = t.supplier.select("s_suppkey", lattice.alias("lattice"), F.explode(F.array(F.lit(0), F.lit(1))).alias("site_idx"))
    cart = F.array(F.col("site_idx") * 1.5, ((key + F.col("site_idx") + 1) % 4) * 0.5, zero)
    edges = gr.periodic_neighbours(sites.withColumn("cart", cart), ["s_suppkey"], 5.2)
    image = F.col("image")
    return edges.select(
        "s_suppkey", "src", "dst", image[0].alias("n0"), image[1].alias("n1"), image[2].alias("n2"),
        F.round("distance", 6).alias("distance"),
    )
