"""Detail-text queries: pages rendered from parts, parsed to nested rows; line blocks of conversations."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import detail
from ..functions.arrays import whole
from ..operators import ranking
from .registry import Tables, query


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def detail_texts(t: Tables):
    """One detail page per part; every field follows from the part's own columns."""
    key, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    status = F.when(size % 2 == 0, "TI (NLC)").otherwise("SM (ESFD)")
    gap = F.when(size % 4 == 0, "").otherwise(_text("\nSmallest Computed Gap 0.", size + 100))
    rows = F.transform(
        F.sequence(F.lit(1), size % 3 + 1),
        lambda i: _text("\n", i * 2, "   ", F.when(i % 2 == 0, "NLC").otherwise("LCEBR"), "  ", key % 9, "(1) ", i, "(2) - ", i,
                        " 7(1)   8(", size % 5 + 1, ")"),
    )
    text = _text(
        "\n***", F.col("p_name"), "***\nSymmetry Group: ", size, " (P", key % 7, "/m)\nTopological Status (Type): ", status,
        "\nTopological indices: Z2w,1 = ", size % 2, ", Z2w,2 = 1, Z4 = ", size % 4, ", Z2 = ", key % 2, ", Z4π = 3, Z8 = ", size % 8,
        "\nICSD: ", key, "\nCell Length A ", price, " Cell Length B 2.5 Cell Length C ", size, ".25 Cell Angle α 90 Cell Angle β 80.5",
        " Cell Angle γ 120 Cell Volume ", size * 2, ".5\nNr of valence electrons: ", size * 3, ".\nGaps at high-symmetry points (eV):",
        " Γ: 0.1", size, ", M 0.25", gap, "\nWith SOC: ", F.when(size % 3 == 0, "No").otherwise("Yes"), "\nNr Fragile Bands ", size % 6,
        "\nEBR equivalence class ", key % 50, "\n\nBand representations and their degeneracies\nNr. Bands Subclass Γ   M   Z   R   X   A",
        F.array_join(rows, ""), "\n         continued 5(2)\n\nTransitions upon symmetry lowering\nSymmetry Group   Topological Indices\n",
        "1 (P1)\n", size, " (P-1)   Z2w,1 = 1, Z4 = ", size % 4, "\n  Z8 = 2\n83 (P4/m)\n some note\n other note\n\n",
        "Minimal subgroups are highlighted\n",
    )
    return t.spread("part").select("p_partkey", text.alias("text"))


def _parsed(t: Tables):
    return detail.parse_details(detail_texts(t), "p_partkey", "text")


@query(
    "regex_fields",
    "FN12 FN14",
    """
    select p_partkey::varchar as material_id, p_name as formula, p_partkey::varchar as icsd_id, p_size as space_group,
           'P' || (p_partkey % 7) || '/m' as space_group_symbol, case when p_size % 2 = 0 then 'TI' else 'SM' end as topological_type,
           case when p_size % 2 = 0 then 'NLC' else 'ESFD' end as topological_subtype, p_retailprice as a, 2.5::double as b,
           p_size + 0.25::double as c, 90.0::double as alpha, 80.5::double as beta, 120.0::double as gamma,
           p_size * 2 + 0.5::double as volume, p_size * 3 as valence_electrons
    from part
    """,
)
def regex_fields(t: Tables):
    cell = [F.col("lattice_params")[n].alias(n) for n in ("a", "b", "c", "alpha", "beta", "gamma")]
    return _parsed(t).select(
        "material_id", "formula", "icsd_id", "space_group", "space_group_symbol", "topological_type", "topological_subtype",
        *cell, "volume", "valence_electrons",
    )


@query(
    "kv_pairs",
    "FN13 FN15",
    """
    select p_partkey::varchar as material_id, 'Z2=' || (p_partkey % 2) || ',Z2w_1=' || (p_size % 2) || ',Z2w_2=1' as z2,
           'Z4=' || (p_size % 4) || ',Z4pi=3,Z8=' || (p_size % 8) as higher, ('0.1' || p_size)::double as gap_gamma,
           0.25::double as gap_m, case when p_size % 4 > 0 then ('0.' || (p_size + 100))::double end as smallest_gap,
           p_size % 3 <> 0 as soc_enabled, p_size % 6 as fragile_bands, (p_partkey % 50)::int as ebr_class
    from part
    """,
)
def kv_pairs(t: Tables):
    flat = lambda m: F.array_join(
        F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )
    return _parsed(t).select(
        "material_id", flat("z2_invariants").alias("z2"), flat("higher_order_invariants").alias("higher"),
        F.col("band_gaps")["Γ"].alias("gap_gamma"), F.col("band_gaps")["M"].alias("gap_m"), "smallest_gap", "soc_enabled",
        "fragile_bands", "ebr_class",
    )


@query(
    "page_attributes",
    "FN13",
    """
    select page_id, name, value, count(*) as n from (
      select page_id, unnest(regexp_extract_all(html, '([a-z]+)="([^"]*)"', 1)) as name,
             unnest(regexp_extract_all(html, '([a-z]+)="([^"]*)"', 2)) as value from pages) group by all
    """,
)
def page_attributes(t: Tables):
    pattern = F.lit('([a-z]+)="([^"]*)"')
    pairs = F.arrays_zip(
        F.regexp_extract_all("html", pattern, F.lit(1)).alias("name"),
        F.regexp_extract_all("html", pattern, F.lit(2)).alias("value"),
    )
    found = t.pages.select("page_id", F.explode(pairs).alias("p"))
    return found.groupBy("page_id", F.col("p.name").alias("name"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"))


@query(
    "band_table_text",
    "FN16",
    """
    with g as (select *, unnest(generate_series(1, p_size % 3 + 1)) as i from part),
    r as (
      select p_partkey, i, 'Γ' as k_point, (p_partkey % 9)::varchar as irrep_label, 1 as degeneracy from g
      union all select p_partkey, i, 'M', i::varchar, 2 from g
      union all select p_partkey, i, 'R', i::varchar, null from g
      union all select p_partkey, i, 'X', '7', 1 from g
      union all select p_partkey, i, 'A', '8', p_size % 5 + 1 from g)
    select p_partkey::varchar as material_id, (i * 2)::int as num_bands, case when i % 2 = 0 then 'NLC' else 'LCEBR' end as subclass,
           k_point, irrep_label, degeneracy::int as degeneracy from r
    """,
)
def band_table_text(t: Tables):
    groups = _parsed(t).select("material_id", F.explode(whole("band_groups")).alias("g"))
    reps = groups.select("material_id", "g.num_bands", "g.subclass", F.explode(whole(F.col("g.reps"))).alias("r"))
    return reps.select("material_id", "num_bands", "subclass", "r.*")


@query(
    "transition_rows",
    "FN17 SM3",
    """
    select p_partkey::varchar as material_id, 1 as target_number, 'P1' as target_symbol, '' as indices, 'N/A' as notes from part
    union all select p_partkey::varchar, p_size, 'P-1', 'Z2w_1=1,Z4=' || (p_size % 4) || ',Z8=2', 'N/A' from part
    union all select p_partkey::varchar, 83, 'P4/m', '', 'some note' from part
    """,
)
def transition_rows(t: Tables):
    rows = _parsed(t).select("material_id", F.explode(whole("transitions")).alias("t"))
    entries = F.transform(F.array_sort(F.map_entries("t.indices")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select(
        "material_id", "t.target_number", "t.target_symbol", F.array_join(entries, ",").alias("indices"),
        F.coalesce("t.info", F.lit("N/A")).alias("notes"),
    )


@query(
    "detail_ingest",
    "PL5",
    """
    select p_partkey::varchar as material_id, p_name as formula, p_size as space_group, (p_size % 3 + 1)::int as band_groups,
           (5 * (p_size % 3 + 1))::bigint as reps, 3::int as transitions, 3::int as z2_count, 3::int as higher_count from part
    """,
)
def detail_ingest(t: Tables):
    reps = F.aggregate(F.transform("band_groups", lambda g: F.size(g["reps"])), F.lit(0), lambda a, x: a + x)
    return _parsed(t).select(
        "material_id", "formula", "space_group", F.size("band_groups").alias("band_groups"), reps.cast("long").alias("reps"),
        F.size("transitions").alias("transitions"), F.size("z2_invariants").alias("z2_count"),
        F.size("higher_order_invariants").alias("higher_count"),
    )


@query(
    "sessionize_lines",
    "FN17",
    """
    with s as (select *, case when lag(role) over (partition by conv_id order by turn) is distinct from role then 1 else 0 end as start
               from conversations),
    b as (select *, sum(start) over (partition by conv_id order by turn)::bigint as block from s)
    select conv_id, block, min(role) as role, count(*) as lines, min(turn) as first_turn, sum(length(text))::bigint as chars
    from b group by conv_id, block
    """,
)
def sessionize_lines(t: Tables):
    # The previous turn comes by an equi join on (conversation, turn), which spreads a long conversation over all tasks.
    turns = t.conversations.select("conv_id", "turn", "role", F.length("text").alias("chars"))
    ranked = ranking.row_numbers(turns, ["conv_id"], F.floor(F.col("turn") / 4096), [F.col("turn")], "position")
    previous = ranked.select("conv_id", (F.col("position") + 1).alias("position"), F.col("role").alias("previous"))
    started = ranked.join(previous, ["conv_id", "position"], "left").withColumn(
        "start", (~F.col("role").eqNullSafe(F.col("previous"))).cast("long")
    )
    blocks = ranking.running_sum(
        started, ["conv_id"], F.floor(F.col("position") / 4096), [F.col("position")], F.col("start"), "block"
    )
    return blocks.groupBy("conv_id", "block").agg(
        F.min("role").alias("role"), F.count("*").alias("lines"), F.min("turn").alias("first_turn"), F.sum("chars").alias("chars")
    )


@query(
    "coalesce_sources",
    "SC15",
    r"""
    with e as (select event_id, user_id, regexp_extract(props, '\d+')::int as k, value from events)
    select event_id, case event_id % 4 when 0 then 'atoms' when 1 then 'text' when 2 then 'raw' end as source,
           case event_id % 4 when 0 then k when 1 then user_id when 2 then value end::double as x
    from e
    """,
)
def coalesce_sources(t: Tables):
    from ..sources.structures import STRUCTURE_ENCODINGS, decode_structure

    kind, k = F.col("event_id") % 4, F.get_json_object("props", "$.k")
    cell = "[[1.0,0.0,0.0],[0.0,1.0,0.0],[0.0,0.0,1.0]]"
    atoms = _text('{"lattice":', cell, ',"coords":[[', k, ',0.0,0.0]],"elements":["Na"],"cartesian":false}')
    poscar_text = _text("c\n1.0\n1 0 0\n0 1 0\n0 0 1\nNa\n1\nDirect\n", F.col("user_id"), " 0 0\n")
    raw = F.struct(
        F.from_json(F.lit(cell), "array<array<double>>").alias("lattice"),
        F.array(F.array(F.col("value"), F.lit(0.0), F.lit(0.0))).alias("coords"),
        F.array(F.lit("Na")).alias("elements"), F.lit(True).alias("cartesian"),
    )
    rows = t.events.select(
        "event_id", F.when(kind == 0, atoms).alias("atoms"), F.lit(None).cast("string").alias("structure"),
        F.when(kind == 1, poscar_text).alias("final_str"), F.lit(None).cast("string").alias("initial_structure"),
        F.when(kind == 2, raw).alias("raw"),
    )
    decoded = decode_structure(rows, STRUCTURE_ENCODINGS, "raw")
    return decoded.select("event_id", "source", F.col("structure_data.frac")[0][0].alias("x"))


@query(
    "summary_vector",
    "FV13",
    """
    select p_partkey::varchar as material_id, (p_partkey % 2)::double as z2, (p_size % 4)::double as z4, p_size::double as space_group,
           (p_size % 6)::double as fragile, case when p_size % 4 > 0 then ('0.' || (p_size + 100))::double else -1.0 end::double as gap,
           p_retailprice as a, (p_size * 2 + 0.5)::double as volume, (p_size % 3 + 1)::double as band_groups, 3.0::double as transitions,
           0.0::double as filled, 128::int as width
    from part
    """,
)
def summary_vector(t: Tables):
    from ..operators import vectors as vec

    material = _parsed(t)
    rows = material.select("material_id", vec.summary_vector(material).alias("v"))
    places = {"z2": 0, "z4": 4, "space_group": 7, "fragile": 9, "gap": 10, "a": 12, "volume": 15, "band_groups": 16, "transitions": 17, "filled": 18}
    return rows.select("material_id", *[F.col("v")[i].alias(n) for n, i in places.items()], F.size("v").alias("width"))
