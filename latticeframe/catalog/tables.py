"""Table maintenance queries."""

from pyspark.sql import functions as F

from ..operators import maintenance as mt
from ..operators import ranking
from ..session import scratch_path
from ..sources import sinks
from .registry import Tables, query


@query(
    "insert_if_absent",
    "TB1",
    """
    select c_custkey as number, 'stored' as origin from customer where c_nationkey < 20
    union all
    select distinct o_custkey, 'new' from orders
    where o_custkey not in (select c_custkey from customer where c_nationkey < 20)
    """,
)
def insert_if_absent(t: Tables):
    old = t.customer.where("c_nationkey < 20").select(F.col("c_custkey").alias("number"), F.lit("stored").alias("origin"))
    new = t.orders.select(F.col("o_custkey").alias("number"), F.lit("new").alias("origin"))
    return mt.insert_if_absent(old, new, ["number"])


@query(
    "replace_group",
    "TB2",
    """
    with touched as (select c_custkey from customer where c_mktsegment = 'BUILDING')
    select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey not in (select c_custkey from touched)
    union all
    select o_orderkey, o_custkey, 'X' from orders where o_custkey in (select c_custkey from touched) and o_orderstatus = 'O'
    """,
)
def replace_group(t: Tables):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    touched = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    fresh = orders.join(touched, "o_custkey", "left_semi").where("o_orderstatus = 'O'")
    fresh = fresh.withColumn("o_orderstatus", F.lit("X")).select(*orders.columns)
    # Customers whose every order vanished are still touched, as in delete-then-insert.
    cleared = mt.delete_keys(orders, touched, ["o_custkey"])
    return mt.replace_group(cleared, fresh, ["o_custkey"])


@query(
    "upsert_latest",
    "TB3 TB5 WN1",
    """
    with v as (select user_id, event_type, event_id, value, event_id % 2 as is_new from events)
    select user_id, event_type, event_id, value,
           case when is_new = 1 then 'run' else 'old' end as updated_at
    from v qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1
    """,
)
def upsert_latest(t: Tables):
    events = t.events.select("user_id", "event_type", "event_id", "value", F.lit("old").alias("updated_at"))
    old, new = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    return mt.upsert_latest(old, new, ["user_id", "event_type"], F.col("event_id"), "updated_at", F.lit("run"))


@query(
    "cascade_delete",
    "TB4",
    """
    with kept as (select o_orderkey from orders where o_orderstatus <> 'F')
    select l_returnflag, count(*) as rows_left, round(sum(l_quantity), 2) as quantity from lineitem
    where l_orderkey in (select o_orderkey from kept) group by l_returnflag
    """,
)
def cascade_delete(t: Tables):
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    kept = mt.delete_keys(orders, orders.where("o_orderstatus = 'F'"), ["o_orderkey"])
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_quantity")
    left = mt.children_of(lines, kept, ["o_orderkey"])
    return left.groupBy("l_returnflag").agg(
        F.count("*").alias("rows_left"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    "parent_child_split",
    "TB6",
    """
    select o_orderkey, 'GM' as k_point, o_orderstatus as cell from orders
    union all select o_orderkey, 'X', o_orderpriority from orders
    union all select o_orderkey, 'R', null from orders
    """,
)
def parent_child_split(t: Tables):
    cells = F.create_map(
        F.lit("GM"), F.col("o_orderstatus"), F.lit("X"), F.col("o_orderpriority"), F.lit("R"), F.lit(None).cast("string")
    )
    parsed = t.orders.select("o_orderkey", cells.alias("kpoints"))
    parents, children = mt.parents_and_children(parsed, ["o_orderkey"], "kpoints")
    return parents.join(children, "ebr_id").select("o_orderkey", "k_point", "cell")


@query(
    "nested_posexplode",
    "TB7",
    r"""
    select doc_id, i as decomposition_index, count(*) as branches, max(len(w)) as longest, sum(j)::bigint as index_sum from (
      select doc_id, i, unnest(regexp_extract_all(line, '\S+')) as w,
             unnest(generate_series(1, len(regexp_extract_all(line, '\S+')))) as j from (
        select doc_id, unnest(string_split(text, chr(10))) as line,
               unnest(generate_series(1, len(string_split(text, chr(10))))) as i from documents))
    group by doc_id, i
    """,
)
def nested_posexplode(t: Tables):
    words = F.transform(F.split("text", "\n"), lambda s: F.regexp_extract_all(s, F.lit(r"\S+"), F.lit(0)))
    items = mt.decomposition_items(t.documents.select("doc_id", words.alias("nested")), ["doc_id"], "nested")
    return items.groupBy("doc_id", "decomposition_index").agg(
        F.count("*").alias("branches"), F.max(F.length("irreps_string")).alias("longest"),
        F.sum("branch_index").alias("index_sum"),
    )


@query(
    "bulk_status",
    "TB8",
    """
    with s as (
      select case when doc_id % 5 = 0 then 'Bad Format' when doc_id % 5 = 1 then 'Bad Index'
                  when exists (select 1 from labels l where l.doc_id = d.doc_id and quality = 1) then 'updated'
                  else 'added' end as status, length(text) as chars from documents d)
    select status, count(*) as n, sum(chars)::bigint as chars from s group by status
    """,
)
def bulk_status(t: Tables):
    doc = F.col("doc_id")
    text = (
        F.when(doc % 5 == 0, F.concat(doc.cast("string"), F.lit("  A1")))
        .when(doc % 5 == 1, F.concat(F.lit("n"), doc.cast("string"), F.lit(" A1 B1")))
        .otherwise(F.concat(F.lit(" "), doc.cast("string"), F.lit(" A1(1)\tB1(1), B2(1) ")))
    )
    status, index, first, second = mt.branch_line(F.col("line"))
    lines = t.documents.select(text.alias("line"), F.length("text").alias("chars"))
    parsed = lines.select(status.alias("status"), index.cast("long").alias("doc_id"), first.alias("b1"), second.alias("b2"), "chars")
    known = t.labels.where("quality = 1").select("doc_id", F.lit(True).alias("known")).distinct()
    joined = parsed.join(known, "doc_id", "left")
    outcome = F.when(F.col("status") != "ok", F.col("status")).when(F.col("known"), "updated").otherwise("added")
    return joined.groupBy(outcome.alias("status")).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query(
    "unprocessed",
    "TB9",
    "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'N' and l_quantity > 25)",
)
def unprocessed(t: Tables):
    done = t.lineitem.where("l_returnflag = 'N' and l_quantity > 25").select(F.col("l_partkey").alias("p_partkey"))
    return mt.unprocessed(t.part, done.distinct(), ["p_partkey"])


@query(
    "next_number",
    "TB10",
    """select n_regionkey, case when max(n_nationkey) < 22 then max(n_nationkey) + 1 end::int as next_number
       from nation join customer on n_nationkey = c_nationkey group by n_regionkey
       union all select -1, case when max(c_nationkey) < 230 then max(c_nationkey) + 1 end::int from customer""",
)
def next_number(t: Tables):
    joined = t.nation.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey"))
    top = joined.groupBy("n_regionkey").agg(F.max("n_nationkey").alias("top"))
    per_region = top.select("n_regionkey", F.when(F.col("top") < 22, F.col("top") + 1).alias("next_number"))
    overall = mt.next_number(t.customer, "c_nationkey")
    return per_region.unionByName(overall.select(F.lit(-1).alias("n_regionkey"), "next_number"))


@query(
    "fk_orphans",
    "TB11",
    """
    select l_orderkey, count(*) as n from lineitem
    where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P') group by l_orderkey
    """,
)
def fk_orphans(t: Tables):
    parents = t.orders.where("o_orderstatus <> 'P'")
    lost = mt.orphans(t.lineitem.select("l_orderkey"), parents, "l_orderkey", "o_orderkey")
    return lost.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    "duplicate_keys",
    "TB11",
    "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1",
)
def duplicate_keys(t: Tables):
    return mt.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "dedupe",
    "SO2",
    """select text, first_id from (
         select md5(text) as text, min(doc_id) as first_id from documents group by md5(text))""",
)
def dedupe(t: Tables):
    keyed = t.documents.select(F.md5(F.encode("text", "UTF-8")).alias("text"), "doc_id")
    return ranking.first_per_key(keyed, ["text"], [F.col("doc_id")]).withColumnRenamed("doc_id", "first_id")


@query(
    "stratified_split",
    "SP1 SK4 AG17",
    """
    with s as (select quality, count(*) as size from labels group by quality),
    c as (select *, round(0.8 * size)::bigint as n_train from s),
    d as (select *, round((size - n_train) * 0.5)::bigint as n_val from c)
    select quality, 'train' as split, n_train as n from d
    union all select quality, 'val', n_val from d
    union all select quality, 'test', size - n_train - n_val from d
    """,
)
def stratified_split(t: Tables):
    path = scratch_path(t.spark, "splits")
    sinks.write_splits(ranking.stratified_split(t.labels, "doc_id", "quality", 0.8, 0.1, 42), path)
    return t.spark.read.parquet(path).groupBy("quality", "split").agg(F.count("*").alias("n"))


@query(
    "next_unprocessed",
    "TB9",
    """
    select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49)
    order by p_retailprice, p_partkey limit 1
    """,
)
def next_unprocessed(t: Tables):
    done = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    position = F.struct("p_retailprice", "p_partkey")
    return mt.next_unprocessed(t.part, done, ["p_partkey"], position).select("p_partkey", "p_name")
