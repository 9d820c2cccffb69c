"""Queries over the composed jobs: material records, k-space graphs, structure datasets."""

from pyspark.sql import functions as F

from ..functions import formulas
from ..operators import graphs
from ..operators import joins as jn
from ..plans import kspace, records
from ..session import cut_lineage
from ..sources import poscar
from .registry import Tables, query
from .storage import catalogue_rows
from .structures import structure_text


@query(
    "record_build",
    "PL1 FV16 FL8",
    """
    with norm as (select p_partkey, p_size, p_partkey % 300 + 1 as m, gcd(p_size, p_partkey % 300 + 1) as d from part),
    cat as (select 'Cl' || case when m = d then '' else (m // d)::varchar end || 'Na' || case when p_size = d then '' else (p_size // d)::varchar end as f,
                   p_partkey, case when p_partkey % 10 > 0 then p_size * 4 end as g,
                   case p_partkey % 4 when 0 then 'TI (NLC)' when 1 then 'SM (ES)' when 2 then 'trivial (LCEBR)' else p.p_name end as prop
            from norm join (select p_partkey as k, p_name from part) p on p.k = p_partkey),
    last as (select * from cat qualify row_number() over (partition by f order by p_partkey desc) = 1),
    cand as (select l_partkey, count(*) as nsites, round(sum(l_quantity), 2) as volume, max(l_suppkey) % 60 as s, max(l_linenumber) as b
             from lineitem group by l_partkey),
    c as (select l_partkey, nsites, volume, gcd(s + 1, b) as d, s + 1 as na, b as cl, l_partkey % 230 + 1 as sg from cand),
    r as (select l_partkey, nsites, volume, sg,
                 'Cl' || case when cl = d then '' else (cl // d)::varchar end || 'Na' || case when na = d then '' else (na // d)::varchar end as f from c)
    select 'mp-' || l_partkey as jid, r.f as normalized_formula, sg as space_group_number, nsites::int as nsites, volume,
           case when last.f is null then 'Unknown' when contains(upper(prop), 'TI') then 'Topological Insulator'
                when contains(upper(prop), 'SM') then 'Semimetal' when contains(upper(prop), 'WEYL') then 'Weyl Semimetal'
                when contains(upper(prop), 'DIRAC') then 'Dirac Semimetal' else 'Trivial' end as topological_class,
           case when sg <= 200 then 'SG_' || sg else 'fallback' end as graph_path, 76::int as combined_width
    from r left join last on r.f = last.f join embeddings e on e.vec_id = l_partkey % (select count(*) from embeddings)
    """,
)
def record_build(t: Tables):
    # Three tables come from the candidates: lineitem is read once, into a staged row per part.
    built = cut_lineage(t.lineitem.groupBy("l_partkey").agg(
        F.count("*").cast("int").alias("nsites"), F.round(F.sum("l_quantity"), 2).alias("volume"),
        (F.max("l_suppkey") % 60).alias("s"), F.max("l_linenumber").alias("b"),
    ))
    none = F.lit(None)
    modulus = none.cast("struct<voigt:double,reuss:double,vrh:double>")
    candidates = built.select(
        F.concat(F.lit("mp-"), "l_partkey").alias("material_id"), "l_partkey",
        F.concat(F.lit("Na"), (F.col("s") + 1).cast("string"), F.lit("Cl"), F.col("b").cast("string")).alias("formula_pretty"),
        F.struct(none.cast("int").alias("number")).alias("symmetry"), (F.col("l_partkey") % 230 + 1).cast("int").alias("space_group_number"),
        F.lit(0.0).alias("band_gap"), F.lit(-1.0).alias("formation_energy_per_atom"), F.lit(0.01).alias("energy_above_hull"),
        none.cast("double").alias("density"), "volume", "nsites", none.cast("double").alias("total_magnetization"),
        none.cast("string").alias("ordering"), none.cast("boolean").alias("theoretical"), none.cast("boolean").alias("is_gap_direct"),
        none.cast("double").alias("cbm"), none.cast("double").alias("vbm"), modulus.alias("bulk_modulus"), modulus.alias("shear_modulus"),
    )
    graphs = t.spark.range(1, 201).select(
        F.col("id").cast("int").alias("space_group_number"), F.concat(F.lit("SG_"), "id").alias("graph_path")
    )
    made = records.material_records(
        jn.candidates_with_group(candidates), catalogue_rows(t), graphs, "ICSD_ID"
    )
    vectors = candidates.select(F.col("material_id").alias("jid"), (F.col("l_partkey") % t.embeddings.agg(F.count("*")).scalar()).alias("vec_id")).join(
        t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id"
    )
    band_rep = candidates.select(F.col("material_id").alias("jid"), F.array(*[F.lit(1.0)] * 4).alias("v"))
    full = records.with_vectors(made, vectors, band_rep).where(F.size("asph_features") > 0)
    return full.select(
        "jid", "normalized_formula", F.col("space_group_number").cast("long"), "nsites", "volume", "topological_class",
        F.col("file_locations")["kspace_graph"].alias("graph_path"),
        F.col("vectorized_feature_sizes")["combined_features"].alias("combined_width"),
    )


@query(
    "kspace_graphs",
    "PL2 GR1 GR2 GR3 GR5 AG11",
    """
    with f as (select c_nationkey + 1 as g, 'M' || lpad(month(o_orderdate)::varchar, 2, '0') as k, l_returnflag || l_linestatus as irrep,
                      l_linenumber as d from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
    n as (select g, count(distinct k) as nodes from f group by g),
    i as (select g, sum(c * (c - 1) // 2) as e from (select g, irrep, count(distinct k) as c from f group by all) group by g),
    d as (select g, sum(c * (c - 1) // 2) as e from (select g, d, count(distinct k) as c from f group by all) group by g)
    select n.g::int as space_group_number, nodes as num_nodes, (nodes - 1 + i.e + d.e)::bigint as num_edges, 10::int as feature_dim
    from n join i on n.g = i.g join d on n.g = d.g
    """,
)
def kspace_graphs(t: Tables):
    return kspace.kspace_graphs(_kspace_facts(t)).meta


def _kspace_facts(t: Tables):
    # k-points are months and irreps are flags: both domains stay small at any scale.
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("l_orderkey"), (F.col("c_nationkey") + 1).cast("int").alias("space_group_number"),
        F.format_string("M%02d", F.month("o_orderdate")).alias("k_point"), F.col("o_orderpriority").alias("ebr_label"),
    )
    return t.lineitem.join(orders, "l_orderkey").select(
        "space_group_number", "k_point", "ebr_label", F.concat("l_returnflag", "l_linestatus").alias("irrep_label"),
        F.col("l_linenumber").cast("string").alias("decomposition_index"), F.lit("A1").alias("branch1_irreps"),
        F.sqrt("l_extendedprice").alias("energy"), F.col("l_linenumber").alias("band_index"),
    )


@query(
    "physics_vectors",
    "AG11",
    """
    select c_nationkey + 1 as g, count(distinct o_orderpriority)::double as ebrs, count(distinct l_returnflag || l_linestatus)::double as irreps,
           count(distinct l_linenumber)::double as decompositions, count(distinct l_linenumber)::double as bands, 0.0::double as rest, 11::int as width
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by c_nationkey
    """,
)
def physics_vectors(t: Tables):
    rows = kspace.physics_vectors(_kspace_facts(t), ["space_group_number"])
    v = F.col("physics")
    rest = F.aggregate(F.slice(v, 3, 7), F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        F.col("space_group_number").cast("long").alias("g"), v[0].alias("ebrs"), v[1].alias("irreps"), v[9].alias("decompositions"),
        v[10].alias("bands"), rest.alias("rest"), F.size(v).alias("width"),
    )


@query(
    "poscar_dataset",
    "PL7",
    """
    with p as (select p_size, min_by(p_retailprice, p_partkey) as band_gap, min(p_partkey) as k from part group by p_size),
    s as (select o_orderkey, i, 2 * (((o_orderkey + i) % 8) / 8 * (o_custkey % 5 + 2) + ((o_custkey + i) % 4) / 4 * 0.5) as x, 8 * (((o_custkey + i) % 4) / 4) as y, i::double as z
          from (select *, unnest(generate_series(1, o_custkey % 4 + 1)) as i from orders)),
    e as (select a.o_orderkey as k, count(*) as m from s a join s b on a.o_orderkey = b.o_orderkey and a.i < b.i
          where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 5.3 group by a.o_orderkey)
    select o_orderkey as source_id, e.m as num_edges, (o_custkey % 4 + 1) as num_nodes, case when o_custkey % 4 = 0 then 1 else 2 end::bigint as num_elements,
           p.band_gap, p.k is not null as matched, case when p.k is null then 0.0 else p.band_gap end::double as gap_feature
    from orders left join p on p.p_size = case when o_custkey % 4 = 0 then 0 else o_custkey % 4 end left join e on e.k = o_orderkey
    """,
)
def poscar_dataset(t: Tables):
    texts = t.spread("orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("source_id"), structure_text().alias("value"))
    # Graph sizes and edges come from the parsed rows: they are staged, narrow.
    structures = cut_lineage(poscar.sizes_and_places(poscar.parse_structures(texts), ["source_id", "formula"]))
    properties = t.part.select(
        formulas.reduced_formula(formulas.element_counts(F.concat(F.lit("Na1Cl"), F.col("p_size").cast("string")))).alias("normalized_formula"),
        F.col("p_retailprice").alias("band_gap"), F.lit(None).cast("double").alias("density"), F.col("p_partkey").alias("ordinal"),
    )
    # Bonds join sites at most 5.3 apart inside the cell.
    edges = graphs.near_pairs_in_rows(structures, ["source_id"], "places", 5.3)
    dataset = records.structure_dataset(structures.drop("places"), edges, properties)
    return dataset.select(
        "source_id", "num_nodes", "num_edges", "num_elements", "band_gap", "matched", F.col("features")[0].alias("gap_feature")
    )
