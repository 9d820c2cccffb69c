"""Source and sink queries: what is written is read back and compared."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path
from ..operators import graphs as gr
from ..plans import ingest
from ..sources import catalogue, sinks, tables
from .registry import Tables, query


def catalogue_rows(t: Tables):
    """Parts as catalogue rows: a two-element formula, a space group and a class text."""
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = key % 4
    return t.spread("part", "p_partkey", "p_size", "p_name").select(
        F.concat(F.lit("Na"), size.cast("string"), F.lit(" Cl"), (key % 300 + 1).cast("string")).alias("Formula"),
        F.when(key % 10 > 0, F.concat((size * 4).cast("string"), F.lit(" (P"), (key % 7).cast("string"), F.lit("/m)"))).alias("Space Group"),
        F.when(kind == 0, "TI (NLC)").when(kind == 1, "SM (ES)").when(kind == 2, "trivial (LCEBR)").otherwise(F.col("p_name")).alias("Property"),
        key.alias("ICSD_ID"), F.concat(F.lit("http://x/POSCAR/"), key.cast("string")).alias("POSCAR_link"),
        F.lit(None).cast("string").alias("MatProject_link"),
    )


@query(
    "scan_catalogue",
    "SC1",
    """
    select p_partkey as "ICSD_ID", 'Na' || p_size || ' Cl' || (p_partkey % 300 + 1) as "Formula",
           case when p_partkey % 10 > 0 then (p_size * 4) || ' (P' || (p_partkey % 7) || '/m)' end as "Space Group",
           case p_partkey % 4 when 0 then 'TI (NLC)' when 1 then 'SM (ES)' when 2 then 'trivial (LCEBR)' else p_name end as "Property",
           'http://x/POSCAR/' || p_partkey as "POSCAR_link" from part
    """,
)
def scan_catalogue(t: Tables):
    path = scratch_path(t.spark, "catalogue")
    rows = catalogue_rows(t)
    # Header names with blanks around them, as in the source files.
    rows.toDF(*[f" {c}  " for c in rows.columns]).write.option("header", True).csv(path)
    return catalogue.read_catalogue(t.spark, path).drop("MatProject_link")


@query(
    "json_props_scan",
    "SC5",
    r"select event_id, regexp_extract(props, '(\d+)', 1)::int as k, event_id % 7 = 0 as nan_gap, value from events",
)
def json_props_scan(t: Tables):
    path = scratch_path(t.spark, "records")
    gap = F.when(F.col("event_id") % 7 == 0, "NaN").otherwise(F.col("value").cast("string"))
    text = F.concat(
        F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "props": '), "props", F.lit(', "gap": '), gap,
        F.lit(', "value": '), F.col("value").cast("string"), F.lit("}"),
    )
    t.events.select(text.alias("value")).write.text(path)
    schema = StructType.fromDDL("event_id BIGINT, props STRUCT<k: INT>, gap DOUBLE, value DOUBLE")
    rows = t.spark.read.schema(schema).json(path)
    return rows.select("event_id", "props.k", F.isnan("gap").alias("nan_gap"), "value")


@query(
    "metadata_round_trip",
    "SK1",
    """
    select o_orderkey, o_custkey % 230 + 1 as space_group_number, o_totalprice as band_gap, o_totalprice < 50000 as is_metal,
           case when o_orderkey % 3 = 0 then o_totalprice / 2 end as vrh, o_orderpriority as property from orders
    """,
)
def metadata_round_trip(t: Tables):
    price = F.col("o_totalprice")
    modulus = F.struct(price.alias("voigt"), price.alias("reuss"), (price / 2).alias("vrh"))
    records = t.orders.select(
        "o_orderkey", (F.col("o_custkey") % 230 + 1).alias("space_group_number"),
        F.struct(price.alias("band_gap"), (price < 50000).alias("is_metal")).alias("electronic_structure"),
        F.struct(F.when(F.col("o_orderkey") % 3 == 0, modulus).alias("bulk_modulus")).alias("mechanical_properties"),
        F.create_map(F.lit("Property"), "o_orderpriority").alias("local_database_props"),
    )
    path = scratch_path(t.spark, "metadata")
    sinks.write_metadata(records, path, "space_group_number")
    stored = sinks.read_metadata(t.spark, path, records.schema)
    return stored.select(
        "o_orderkey", "space_group_number", "electronic_structure.band_gap", "electronic_structure.is_metal",
        F.col("mechanical_properties.bulk_modulus.vrh").alias("vrh"), F.col("local_database_props")["Property"].alias("property"),
    )


@query(
    "master_index",
    "SK2 SK7",
    """
    select event_id, '{"user":' || user_id || ',"kind":"' || event_type || '"}' as origin, '["' || event_type || '"]' as tags,
           value from events
    """,
)
def master_index(t: Tables):
    records = t.events.select(
        "event_id", F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("origin"),
        F.array("event_type").alias("tags"), "value", F.lit("live").alias("graph_object"),
    )
    path = scratch_path(t.spark, "index")
    sinks.write_master_index(sinks.serializable(records, ["graph_object"]), path)
    schema = "event_id BIGINT, origin STRING, tags STRING, value DOUBLE"
    return t.spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{path}/csv")


@query(
    "bulk_properties",
    "SC12",
    """
    select 'J-' || p_partkey as jid, p_name as formula, p_size::int as spg_number, p_retailprice as formation_energy_peratom,
           p_partkey % 7 = 0 as nan_gap, case when p_partkey % 3 > 0 then p_size / 2 end::double as density from part
    """,
)
def bulk_properties(t: Tables):
    path = scratch_path(t.spark, "bulk")
    key, size = F.col("p_partkey"), F.col("p_size")
    # A key is left out of every third line; a gap of every seventh is not a number.
    text = F.concat(
        F.lit('{"jid": "J-'), key.cast("string"), F.lit('", "formula": '), F.to_json(F.struct("p_name")).substr(F.lit(11), F.length("p_name") + 2),
        F.lit(', "spg_number": '), size.cast("string"), F.lit(', "optb88vdw_bandgap": '), F.when(key % 7 == 0, "NaN").otherwise("0.5"),
        F.when(key % 3 > 0, F.concat(F.lit(', "density": '), (size / 2).cast("string"))).otherwise(""),
        F.lit(', "formation_energy_peratom": '), F.col("p_retailprice").cast("string"), F.lit("}"),
    )
    t.part.select(text.alias("value")).write.text(path)
    rows = tables.read_properties(t.spark, path)
    return rows.select("jid", "formula", "spg_number", "formation_energy_peratom", F.isnan("optb88vdw_bandgap").alias("nan_gap"), "density")


@query(
    "vector_store",
    "SK6",
    "select vec_id::varchar as material_id, label % 2 as method, round(list_sum(embedding::double[]), 3) as total, 64::int as width from embeddings",
)
def vector_store(t: Tables):
    path = scratch_path(t.spark, "vectors")
    vectors = t.embeddings.select(
        F.col("vec_id").cast("string").alias("material_id"), (F.col("label") % 2).alias("method"), F.col("embedding").cast("array<double>").alias("v")
    )
    sinks.write_vectors(vectors, path)
    stored = t.spark.read.schema("material_id STRING, v STRING, method BIGINT").option("header", True).csv(path)
    values = F.transform(F.split("v", " "), lambda x: x.cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return stored.select("material_id", "method", F.round(total, 3).alias("total"), F.size(values).alias("width"))


@query(
    "result_rows",
    "SK8",
    """
    select fmt, c_custkey, c_name, c_acctbal from customer, (values ('csv'), ('json')) v(fmt)
    """,
)
def result_rows(t: Tables):
    path = scratch_path(t.spark, "results")
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    # An empty result writes nothing, and what is there already stays.
    assert sinks.write_rows(rows, path) and not sinks.write_rows(rows.where("false"), path)
    csv = t.spark.read.schema(rows.schema).option("header", True).csv(f"{path}/csv")
    json = t.spark.read.schema(rows.schema).json(f"{path}/json")
    return csv.select(F.lit("csv").alias("fmt"), "*").unionByName(json.select(F.lit("json").alias("fmt"), "*"))


@query(
    "graph_store",
    "SK9 GR10",
    """
    with m as (select distinct l_orderkey % 100 as g, l_partkey as shared, l_suppkey as idx from lineitem),
    s as (select g, shared, count(*) as k from m group by all having count(*) > 1)
    select n.g, n.nodes as num_nodes, coalesce(e.edges, 0)::bigint as num_edges, coalesce(e.members, 0)::bigint as member_rows,
           coalesce(e.total, 0)::bigint as idx_total
    from (select g, count(distinct idx) as nodes from m group by g) n
    left join (select s.g, sum(idx) as total, count(*) as members, (sum(k - 1) // 2) as edges
               from s join m on m.g = s.g and m.shared = s.shared group by s.g) e on e.g = n.g
    """,
)
def graph_store(t: Tables):
    path = scratch_path(t.spark, "graphs")
    members = t.lineitem.select((F.col("l_orderkey") % 100).alias("g"), F.col("l_partkey").alias("shared"), F.col("l_suppkey").alias("idx"))
    nodes = members.select("g", "idx").distinct()
    edges = gr.clique_edges(members, ["g"], "shared", gr.DECOMPOSITION_WEIGHT, "decomposition")
    sinks.write_graphs(nodes, edges, gr.graph_meta(nodes, edges, ["g"]), path, "g")
    stored = t.spark.read.parquet(f"{path}/edges").groupBy("g").agg(F.count("*").alias("member_rows"), F.sum("src").alias("idx_total"))
    sizes = tables.shared_graph_sizes(t.spark, path).join(stored, "g", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sizes.select(F.col("g").cast("long").alias("g"), "num_nodes", "num_edges", zero("member_rows"), zero("idx_total"))


@query(
    "group_tables",
    "PL3 TB2",
    """
    select c_custkey, case when c_nationkey % 3 = 0 then 'new' else 'old' end as origin, c_nationkey from customer
    where c_nationkey % 3 > 0 or c_acctbal > 0
    """,
)
def group_tables(t: Tables):
    path = scratch_path(t.spark, "groups")
    rows = t.customer.select("c_custkey", F.lit("old").alias("origin"), "c_nationkey", "c_acctbal")
    ingest.write_group_tables(rows, path, "c_nationkey")
    # The second run replaces the groups it holds and leaves the others.
    again = rows.where("c_nationkey % 3 = 0 and c_acctbal > 0").withColumn("origin", F.lit("new"))
    ingest.write_group_tables(again, path, "c_nationkey")
    return t.spark.read.parquet(path).select("c_custkey", "origin", F.col("c_nationkey").cast("long").alias("c_nationkey"))
