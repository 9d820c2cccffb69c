"""Projection, clustering and component-curve queries."""

from pyspark.sql import functions as F

from ..functions import topology as topo
from ..operators import clustering as cl
from .registry import Tables, query


@query("pca2", "CL1")
def pca2(t: Tables):
    out = cl.projected(t.embeddings, "vec_id", "embedding")
    return out.select("vec_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(
    "dbscan",
    "CL2 FL15",
    """
    with recursive pts as (select p_partkey as id, p_size::double as x, p_retailprice as y, p_name, p_type from part),
    e as materialized (
      select a.id as a, b.id as b from pts a join pts b on abs(a.x - b.x) <= 1.25 and abs(a.y - b.y) <= 1.25
      where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.2::double * 1.2::double),
    core as materialized (select a as id from e group by a having count(*) >= 5),
    ce as materialized (select a, b from e where a in (select id from core) and b in (select id from core)),
    r(id, label) using key (id) as (
      select id, id from core
      union
      select n.id, n.label from (select ce.b as id, min(r.label) as label from r join ce on ce.a = r.id group by ce.b) n
      join recurring.r o on o.id = n.id where n.label < o.label),
    border as (select e.a as id, min(r.label) as label from e join r on r.id = e.b where e.a not in (select id from core) group by e.a)
    select p.id as p_partkey, x, y, p_name as formula, p_type as colour, coalesce(r.label, border.label, -1)::varchar as cluster
    from pts p left join r on r.id = p.id left join border on border.id = p.id
    """,
)
def dbscan(t: Tables):
    points = t.part.select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    labels = cl.density_clusters(points, "p_partkey", ["x", "y"], eps=1.2, min_points=5)
    named = t.part.select("p_partkey", topo.category_text("p_name").alias("formula"), topo.category_text("p_type").alias("colour"))
    return labels.join(named, "p_partkey")


@query(
    "betti0",
    "FV18",
    """
    with recursive p as (select g, x, y, row_number() over (partition by g order by x, y) as id from (
       select distinct l_orderkey as g, l_quantity / 5 as x, l_linenumber::double as y from lineitem)),
     e as (select a.g, a.id as a, c.id as b, sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)) as w
           from p a join p c on a.g = c.g and a.id <> c.id),
     r(g, s, t, w) using key (g, s, t) as (
       select g, id, id, 0.0::double from p
       union
       select n.g, n.s, n.t, n.w from (
         select r.g, r.s, e.b as t, min(greatest(r.w, e.w)) as w from r join e on r.g = e.g and r.t = e.a group by all) n
       left join recurring.r o on o.g = n.g and o.s = n.s and o.t = n.t where o.w is null or n.w < o.w),
     bars as (select g, s, min(w) as w from r where t < s group by all),
     h as (select g, sum(least(w, 10)) as total, sum(least(w, 10) * log2(least(w, 10))) as logs from bars group by g),
     b as (select unnest(generate_series(0, 19)) as bin)
    select n.g as l_orderkey, b.bin::int as bin, (n.n - count(l.s)) as components,
           round(coalesce(greatest(log2(any_value(h.total)) - any_value(h.logs) / any_value(h.total), 0), 0), 6) as entropy
    from (select g, count(*) as n from p group by g) n cross join b
    left join bars l on l.g = n.g and ceil(l.w / (10.0::double / 19)) <= b.bin left join h on h.g = n.g
    group by n.g, n.n, b.bin
    """,
)
def betti0(t: Tables):
    points = t.lineitem.select("l_orderkey", (F.col("l_quantity") / 5).alias("x"), F.col("l_linenumber").cast("double").alias("y"))
    curves = cl.component_curves(points, "l_orderkey", ["x", "y"])
    return curves.select("l_orderkey", "bin", "components", F.round("entropy", 6).alias("entropy"))


@query(
    "betti0_cloud",
    "FV18",
    """
    with recursive p as (select row_number() over (order by x, y) as id, x, y from (
       select distinct p_size::double as x, p_retailprice::double as y from part)),
     e as materialized (
       select a.id as a, c.id as b, ceil(sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)) / (10.0::double / 19)) as bin
       from p a join p c on abs(a.x - c.x) <= 10 and abs(a.y - c.y) <= 10 and a.id <> c.id),
     b as (select unnest(generate_series(0, 19)) as bin),
     r(bin, id, label) using key (bin, id) as (
       select b.bin, p.id, p.id from p cross join b
       union
       select n.bin, n.id, n.label from (
         select r.bin, e.b as id, min(r.label) as label from r join e on e.a = r.id and e.bin <= r.bin group by all) n
       join recurring.r o on o.bin = n.bin and o.id = n.id where n.label < o.label)
    select bin::int as bin, count(distinct label) as components from r group by bin
    """,
)
def betti0_cloud(t: Tables):
    """All parts as one cloud."""
    points = t.part.select(F.lit(0).alias("cloud"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    return cl.component_curves(points, "cloud", ["x", "y"]).select("bin", "components")
