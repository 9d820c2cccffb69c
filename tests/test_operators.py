"""Hand-worked fixtures, brute force and invariants for what SQL does not check."""

import os
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeframe import session
from latticeframe.functions import detail, formulas, html, labels
from latticeframe.functions import sections as sec
from latticeframe.operators import aggregates as agg
from latticeframe.operators import clustering as cl
from latticeframe.operators import filters as flt
from latticeframe.operators import graphs as gr
from latticeframe.operators import joins as jn
from latticeframe.operators import maintenance as mt
from latticeframe.operators import ranking
from latticeframe.operators import similarity as sim
from latticeframe.operators import vectors as vec
from latticeframe.sources import pages as pg
from latticeframe.sources import poscar, sinks


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "s string").select(expression(F.col("s")).alias("r")).first().r


@pytest.mark.parametrize(
    "text,cells",
    [
        ("A1(2) 2 G3G4(2)", ["A1(2)", "2 G3G4(2)"]),
        ("D3D3(2) ⊕ D4D4(2)  -", ["D3D3(2) ⊕ D4D4(2)", "-"]),
        ("Γ1(1) ⊕ Γ2(1) odd X1(1)", ["Γ1(1) ⊕ Γ2(1)", "odd", "X1(1)"]),
        ("", []),
    ],
)
def test_kpoint_cells(spark, text, cells):
    assert one(spark, text, labels.kpoint_cells) == cells


@pytest.mark.parametrize(
    "text,value", [("2 A1(1), B2(2)", 4), ("A1", 1), ("", 0), (None, 0), ("3 E(4)", 12)]
)
def test_irrep_dimension(spark, text, value):
    assert one(spark, text, labels.irrep_dimension) == value


def test_wyckoff_and_orbital_without_match(spark):
    assert tuple(one(spark, "bad", labels.wyckoff)) == ("bad", "")
    assert tuple(one(spark, "A1↑G", labels.orbital)) == ("A1↑G", 1)


@pytest.mark.parametrize(
    "text,reduced,full",
    [("Fe2 O4", "FeO2", "Fe2O4"), ("UFeS3", "FeS3U", "Fe1S3U1"), ("H2 Cu1 H4", "CuH6", "Cu1H6"), ("Na120 Cl84", "Cl7Na10", "Cl84Na120")],
)
def test_formulas(spark, text, reduced, full):
    assert one(spark, text, lambda c: formulas.reduced_formula(formulas.element_counts(c))) == reduced
    assert one(spark, text, lambda c: formulas.full_formula(formulas.element_counts(c))) == full


def test_kpoint_coordinates(spark):
    assert one(spark, "(0.5,0.25,0)", labels.kpoint_coordinates) == [0.5, 0.25, 0.0]
    assert one(spark, "0.5 1", labels.kpoint_coordinates) == [0.5, 1.0, 0.0]
    assert one(spark, "u,v,w", labels.kpoint_coordinates) is None


SELECTIVE = """first
2.0
1 0 0
0 2 0
0 0 4
Na Cl
1 2
Selective dynamics
Cartesian
0 0 0 T T F ! fixed
1 1 1 T F T
0.5 0 2 F F F

second
1
3 0 0
0 3 0
0 0 3
Xx
1
direct
0.5 0.5 0.5 Xx
"""


def test_concatenated_structures(spark):
    parts = poscar.split_structures(spark.createDataFrame([("f", SELECTIVE)], "path string, value string"))
    rows = {r.structure_idx: r for r in parts.collect()}
    assert len(rows) == 2 and rows[0].formula == "NaCl2" and rows[1].natoms == 1
    sites = sorted(poscar.sites(parts, ["structure_idx"]).collect(), key=lambda r: (r.structure_idx, r.site_idx))
    assert [s.z for s in sites] == [11, 17, 17, 0]
    assert sites[1].cart == [2.0, 2.0, 2.0] and sites[1].frac == [1.0, 0.5, 0.25]
    assert sites[0].selective == [True, True, False] and sites[3].selective is None
    assert sites[3].cart == [1.5, 1.5, 1.5]


def test_rendered_structure_groups_species(spark):
    df = spark.range(1).select(
        poscar.render(
            F.lit("c"), F.expr("array(array(2D,0D,0D),array(0D,2D,0D),array(0D,0D,2D))"), F.expr("array('Na','Cl','Na')"),
            F.expr("array(array(0D,0D,0D),array(1D,1D,1D),array(1D,0D,0D))"),
        ).alias("value")
    )
    lines = df.first().value.split("\n")
    assert lines[5] == "Na  Cl" and lines[6] == "2  1" and lines[9].split() == ["0.500000", "0.000000", "0.000000"]


DETAIL = """***Ab3 Xz2***
Symmetry Group: 47 (Pmmm)
Topological Status (Type): TI (SEBR)
Topological indices: Z2w,3 = 1, Z4 = 2, Z2 = 1, Z4π = 1, Z8 = 6
ICSD: 123456
Cell Length A 4.5 Cell Length B 5.25 Cell Length C 9.75 Cell Angle α 90 Cell Angle β 95.5 Cell Angle γ 90 Cell Volume 230.3
With SOC: Yes
EBR equivalence class 7

Nr. Bands Subclass Γ   M   Z   R   X   A
6         LCEBR    3(2) 4(2) - 8 3(2) 4(2)
                             1(1) 1(1) 2(1) 6(2)

Transitions upon symmetry lowering
Symmetry Group      Topological Indices
10 (P2/m)           Z2w,3 = 1
invented remark
16 (P222)

Minimal subgroups are highlighted
"""


def test_detail_page(spark):
    row = detail.parse_details(spark.createDataFrame([("m", DETAIL)], "k string, t string"), "k", "t").first()
    assert (row.formula, row.space_group, row.space_group_symbol) == ("Ab3 Xz2", 47, "Pmmm")
    assert row.z2_invariants == {"Z2w_3": 1, "Z2": 1} and row.higher_order_invariants == {"Z4": 2, "Z4pi": 1, "Z8": 6}
    assert row.smallest_gap is None and row.soc_enabled and row.ebr_class == 7 and row.fragile_bands is None
    assert row.lattice_params["beta"] == 95.5 and row.volume == 230.3
    (group,) = row.band_groups
    reps = [(r.k_point, r.irrep_label, r.degeneracy) for r in group.reps]
    assert reps == [("Γ", "3", 2), ("M", "4", 2), ("R", "8", None), ("X", "3", 2), ("A", "4", 2)]
    assert [(t.target_number, dict(t.indices), t.info) for t in row.transitions] == [
        (10, {"Z2w_3": 1}, "invented remark"), (16, {}, None),
    ]


def test_detail_page_vectors_and_search(spark):
    material = detail.parse_details(spark.createDataFrame([("a", DETAIL), ("b", DETAIL), ("c", "nothing")], "k string, t string"), "k", "t")
    flat = sim.flatten_material(material)
    found = sim.topological_analogues(flat, "material_id", "a", sim.MATERIAL_SPEC, 0.7).collect()
    assert [(r.material_id, r.similarity) for r in found] == [("b", 1.0)]
    vectors = {r.material_id: r.v for r in material.select("material_id", vec.summary_vector(material).alias("v")).collect()}
    assert len(vectors["a"]) == 128 and vectors["a"][:12] == [1, 0, 0, 1, 2, 1, 6, 47, 7, -1, -1, 1]
    assert flt.invariant_pattern(material, {"Z2": 1, "Z4": 2}).count() == 2
    assert flt.invariant_pattern(material, {}).count() == 3 and flt.invariant_pattern(material, {}, False).count() == 0
    assert material.where(flt.has_band_group(F.col("band_groups"), irrep=("R", "8"))).count() == 2
    assert material.where(flt.has_band_group(F.col("band_groups"), irrep=("R", "8"), min_degeneracy=1)).count() == 0
    assert sim.internal_transitions(material, "a").count() == 2


def test_section_layouts_report_errors(spark):
    text = "Wyckoff pos. 1a(m) 1b(m)\nBand-Rep. A1↑G(1) A2↑G(1)\nDecomposable decomposable\nGM: A1(1) B1(1)\nX: A1(1)\n"
    row = sec.parse_layout_c(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert row.status == "cell mismatch" and row.notes == ["decomposable"]
    good = sec.parse_layout_c(spark.createDataFrame([("k", text.replace("X: A1(1)", "X: - A1(1)"))], "k string, t string"), "t")
    rows = sorted(sec.columns_to_rows(good, ["k"]).collect(), key=lambda r: r.ebr_column)
    assert [r.notes for r in rows] == ["decomposable", "indecomposable"] and rows[0].kpoints == {"GM": "A1(1)", "X": "-"}


def test_page_without_table(spark):
    df = spark.createDataFrame([("1", "<p>none</p>"), ("2", "<table frame=box><tr><td>x</td></tr></table>")], "k string, html string")
    assert pg.bandrep_columns(df, "k").count() == 0 and pg.failed_pages(df, "k").count() == 2
    assert pg.decompositions(df, "k").where("kind is not null").count() == 0


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, many of them copies of one value."""
    rng = random.Random(7)
    rows = [("hot", i, 5.0 if i % 2 else rng.random() * 100) for i in range(400)]
    rows += [(f"g{i % 40}", 400 + i, rng.random() * 10) for i in range(800)]
    return spark.createDataFrame(rows, "g string, i long, v double").repartition(6).cache()


def test_bucketed_order_operators(spark, skewed):
    rows = skewed.collect()
    by_group = {}
    for r in sorted(rows, key=lambda r: (r.g, r.i)):
        by_group.setdefault(r.g, []).append(r)
    bucket, order = F.floor(F.col("i") / 16), [F.col("i")]
    numbered = ranking.row_numbers(skewed, ["g"], bucket, order, "n").collect()
    assert {(r.g, r.i): r.n for r in numbered} == {(r.g, r.i): n + 1 for rs in by_group.values() for n, r in enumerate(rs)}
    linked = ranking.next_value(skewed, ["g"], bucket, order, "i", "after").collect()
    expected = {(a.g, a.i): (b.i if b else None) for rs in by_group.values() for a, b in zip(rs, rs[1:] + [None])}
    assert {(r.g, r.i): r.after for r in linked} == expected


@pytest.mark.parametrize("p", [0.0, 0.3, 0.5, 1.0])
def test_exact_quantiles(skewed, p):
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.g, []).append(r.v)
    got = {r.g: r.q for r in ranking.exact_quantiles(skewed, ["g"], "v", {"q": p}, buckets=8).collect()}
    for g, values in groups.items():
        assert got[g] == pytest.approx(np.percentile(values, p * 100))


def test_split_is_exact_per_stratum(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1000)], "id long, label int")
    split = ranking.stratified_split(df, "id", "label", 0.8, 0.1, 1).collect()
    sizes = Counter((r.label, r.split) for r in split)
    assert sizes[(1, "train")] == 267 and sizes[(1, "val")] + sizes[(1, "test")] == 67 and len(split) == 1000


@pytest.mark.parametrize("size", [2, 1000])
def test_cliques_have_one_form(spark, size):
    members = spark.createDataFrame(
        [("g", "one", i) for i in range(size)] + [("g", "two", i) for i in range(4)] + [("g", None, 1), ("g", "lone", 9)],
        "graph string, shared string, idx long",
    )
    edges = gr.clique_edges(members, ["graph"], "shared", 0.8, "symmetry")
    rows = edges.collect()
    assert len(rows) == size + 4 and all(r.dst is None and r.members == (size if r.shared == "one" else 4) for r in rows)
    nodes = members.select("graph", "idx").distinct()
    assert gr.graph_meta(nodes, edges, ["graph"]).first().num_edges == size * (size - 1) // 2 + 6
    assert gr.adjacency(edges, ["graph"]).count() == size + 4
    assert gr.collapsed(edges, ["graph"]).count() == size + 4
    assert gr.linked_graphs(members, ["graph"], "shared", "idx").count() == 1


def test_line_graph_of_a_hub(spark):
    edges = spark.createDataFrame([("g", i, 0) for i in range(1, 6)] + [("g", 0, i) for i in range(6, 10)] + [("g", 9, 11)], "g string, src long, dst long")
    roles = Counter((r.via, r.role) for r in gr.line_graph(edges, ["g"]).collect())
    assert roles == {(0, "in"): 5, (0, "out"): 4, (9, "in"): 1, (9, "out"): 1}


def test_nearest_edges_count_copies_as_points(spark):
    rng = random.Random(3)
    points = [(i, float(rng.randint(0, 4)), float(rng.randint(0, 4))) for i in range(60)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = {}
    for r in gr.nearest_edges(df, [], "id", ["x", "y"], 1.5, 3).collect():
        got.setdefault(r.src, []).append((r.rank, r.dst, round(r.distance, 6)))
    for i, x, y in points:
        near = sorted((math.dist((x, y), (u, v)), j) for j, u, v in points if j != i and math.dist((x, y), (u, v)) <= 1.5)[:3]
        assert sorted(got.get(i, [])) == [(k + 1, j, round(d, 6)) for k, (d, j) in enumerate(near)]


@pytest.mark.parametrize("values", [[0.0] + [i / 1000 for i in range(3000)] + [1e12], [float(i) for i in range(3000)]])
def test_ranges_hold_like_numbers(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double").repartition(7)
    sizes = [r["count"] for r in ranking.range_buckets(df, ["g", "v"], 8).groupBy("_bucket").count().collect()]
    assert max(sizes) <= 2 * len(values) / 8
    got = ranking.exact_quantiles(df, ["g"], "v", {"q": 0.37}, 8).first().q
    assert got == pytest.approx(np.percentile(values, 37))


def test_index_of_values_with_one_prefix(spark):
    names = [f"a common prefix of all {i:05d}" for i in range(2000)]
    df = spark.createDataFrame([("g", n) for n in names], "g string, v string").repartition(7)
    sizes = [r["count"] for r in ranking.range_buckets(df, ["g", "v"], 8).groupBy("_bucket").count().collect()]
    assert max(sizes) <= 2 * len(names) / 8
    got = {r.v: r.i for r in ranking.dense_index(df, ["g"], "v", "i", 8).collect()}
    assert [got[n] for n in names] == list(range(2000))


def test_groups_with_equal_keys_stay_apart(spark):
    rng = random.Random(9)
    points = [(g, i, rng.random() * 30, rng.random() * 30) for g in ("a", "b") for i in range(300)]
    df = spark.createDataFrame(points, "g string, id long, x double, y double")
    labels = {(r.g, r.id): r.cluster for r in cl.density_clusters(df, "id", ["x", "y"], 1.5, 4, ["g"]).collect()}
    for g in ("a", "b"):
        one = cl.density_clusters(df.where(F.col("g") == g), "id", ["x", "y"], 1.5, 4).collect()
        assert all(labels[g, r.id] == r.cluster for r in one)


def test_difference_of_a_missing_gap(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "k string, gap double")
    shown = sim.with_query(df, "k", "a").select(sim.key_differences([], gap="gap").alias("d"), "k").where("k = 'b'").first()
    assert shown.d == ["Smallest Gap: 0.500 eV vs N/A"]


def brute_force_clusters(points, eps, min_points):
    ids = list(points)
    near = {a: [b for b in ids if sum((x - y) ** 2 for x, y in zip(points[a], points[b])) <= eps * eps] for a in ids}
    core = {a for a in ids if len(near[a]) >= min_points}
    label = {}
    for a in sorted(core):
        if a not in label:
            stack = [a]
            while stack:
                b = stack.pop()
                if b not in label:
                    label[b] = a
                    stack += [c for c in near[b] if c in core and c not in label]
    result = {}
    for a in ids:
        hits = [label[b] for b in near[a] if b in core]
        result[a] = str(label[a]) if a in core else (str(min(hits)) if hits else "-1")
    return result


@pytest.mark.parametrize("seed,eps,min_points", [(1, 0.6, 4), (2, 0.35, 3), (3, 1.0, 12)])
def test_density_clusters_match_brute_force(spark, seed, eps, min_points):
    rng = random.Random(seed)
    points = {i: (rng.gauss(0, 1.5), rng.gauss(0, 1.5)) for i in range(120)}
    points |= {120 + i: (5 + rng.random() * 0.5, 5 + rng.random() * 0.5) for i in range(60)}
    points |= {180 + i: (5.0 + 0.5 + eps * 0.98, 5.2 + i % 3 * 0.01) for i in range(20)}
    points |= {200 + i: (1.0, 1.0) for i in range(10)}
    df = spark.createDataFrame([(k, *v) for k, v in points.items()], "id long, x double, y double")
    got = {r.id: r.cluster for r in cl.density_clusters(df, "id", ["x", "y"], eps, min_points).collect()}
    assert got == brute_force_clusters(points, eps, min_points)


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(300, 301)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in order + [300, 301, 400]], "node long")
    got = {r.node: r.component for r in cl.connected_components(nodes, edges).collect()}
    assert set(got[i] for i in order) == {0} and got[301] == 300 and got[400] == 400


def bars_by_hand(points):
    """Lengths of the minimum spanning tree, by Prim."""
    x = np.array(points, dtype=float)
    best, left, out = np.linalg.norm(x - x[0], axis=1), set(range(1, len(x))), []
    while left:
        i = min(left, key=lambda j: best[j])
        out.append(best[i])
        left.remove(i)
        best = np.minimum(best, np.linalg.norm(x - x[i], axis=1))
    return sorted(out)


@pytest.mark.parametrize("size,spread,dims", [(40, 12, 2), (150, 40, 2), (700, 25, 3), (60, 400, 2)])
def test_bars_of_clouds_match_a_spanning_tree(spark, size, spread, dims):
    rng = random.Random(size)
    clouds = {c: list({tuple(round(rng.random() * spread, 1) for _ in range(dims)) for _ in range(n)}) for c, n in (("a", size), ("b", size // 2), ("c", 1), ("d", 2))}
    # Two dense heaps far apart.
    clouds["e"] = [(i * 0.01, *[0.0] * (dims - 1)) for i in range(60)] + [(5 + i * 0.01, *[0.0] * (dims - 1)) for i in range(60)]
    names = ["x", "y", "z"][:dims]
    rows = [(c, *p) for c, ps in clouds.items() for p in ps] * 2
    df = spark.createDataFrame(rows, f"m string, {', '.join(f'{n} double' for n in names)}")
    lengths, sizes = cl.bar_lengths(df, "m", names)
    got = {}
    for r in lengths.collect():
        got.setdefault(r.m, []).append(r.length)
    curves = {(r.m, r.bin): r for r in cl.component_curves(df, "m", names, bins=4).collect()}
    for c, points in clouds.items():
        want = bars_by_hand(points)
        assert sorted(got.get(c, [])) == pytest.approx([w for w in want if w <= 10])
        shares = np.minimum(want, 10) / np.minimum(want, 10).sum() if want else np.zeros(0)
        for k in range(4):
            r = curves[c, k]
            assert r.components == len(points) - sum(w <= k * 10 / 3 for w in want)
            assert r.entropy == pytest.approx(-(shares * np.log2(shares)).sum(), abs=1e-9)


def test_components_by_shared_keys(spark):
    rng = random.Random(8)
    members = [(n, k) for k in range(60) for n in rng.sample(range(100), 2)] + [(n, 1000) for n in range(200, 260)]
    got = {r.node: r.component for r in cl.components_by_key(spark.createDataFrame(members, "node long, key long")).collect()}
    label = {n: n for n, _ in members}
    for _ in range(200):
        low = {}
        for n, k in members:
            low[k] = min(low.get(k, n), label[n])
        for n, k in members:
            label[n] = min(label[n], low[k])
    assert got == label


def test_cloud_pca_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 4)) * [1, 2, 3, 4]
    df = spark.createDataFrame([("c", [float(v) for v in row]) for row in x], "c string, v array<double>").repartition(3)
    got = np.array(vec.cloud_pca(df, "c", "v", 4).first().features)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    assert np.allclose(got, np.concatenate([np.zeros(3), np.sqrt(values[:3]), values[:3] / values.sum()]))


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([("c", [2.0])] * 4, "c string, v array<double>")
    rows = vec.cloud_histograms(vec.long_points(df, "c", "v"), "c").where("dim = 0").collect()
    assert sum(r.density for r in rows) == pytest.approx(10.0) and max(r.density for r in rows) == pytest.approx(10.0)


def test_next_number(spark):
    empty = spark.createDataFrame([], "n int")
    full = spark.createDataFrame([(230,)], "n int")
    assert mt.next_number(empty, "n").first()[0] == 1 and mt.next_number(full, "n").first()[0] is None


def test_wide_branches_and_map_join(spark):
    nested = spark.createDataFrame([(1, [["A", "B"], ["C"]]), (2, [])], "ebr_id long, n array<array<string>>")
    wide = mt.wide_branches(mt.decomposition_items(nested, ["ebr_id"], "n"), ["ebr_id"])
    assert sorted(tuple(r) for r in wide.collect()) == [(1, 1, "A", "B"), (1, 2, "C", None)]
    indices = spark.createDataFrame([(1, "Z2"), (2, "Z4")], "id long, index_name string")
    values = spark.createDataFrame([(1, "GM", "0"), (1, "X", "1")], "topo_index_id long, irrep_name string, value string")
    assert {r.id: r.irreps for r in jn.index_with_irreps(indices, values).collect()} == {1: {"GM": "0", "X": "1"}, 2: {}}


def test_mode_takes_the_lowest_on_ties(spark):
    df = spark.createDataFrame([("g", 2), ("g", 1), ("g", 2), ("g", 1), ("g", None)], "g string, z2_0 int")
    assert agg.index_consensus(df, ["g"]).first().z2_0 == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, float("nan")]), (2, None)], "id long, v array<double>")
    assert sinks.write_rows(sinks.flat_index(rows), str(tmp_path / "r")) and os.path.isdir(tmp_path / "r" / "csv")
    assert not sinks.write_rows(rows.where("id > 5"), str(tmp_path / "none")) and not os.path.exists(tmp_path / "none")
    sinks.write_master_index(rows.where("id > 5"), str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty" / "parquet")).count() == 0


def test_incremental_ingest_resumes(spark, tmp_path):
    from latticeframe.streaming.resume import ingest_new_pages

    folder, progress = tmp_path / "pages", str(tmp_path / "progress")
    os.makedirs(folder)
    seen = []

    def write(df, _):
        seen.extend(r.page_key for r in df.collect())

    (folder / "sg_1.html").write_text("<p>one</p>")
    ingest_new_pages(spark, str(folder), progress, write)
    (folder / "sg_2.html").write_text("<p>two</p>")
    ingest_new_pages(spark, str(folder), progress, write)
    assert seen == ["sg_1", "sg_2"]


def test_stored_graphs_replace_only_their_groups(spark, tmp_path):
    from latticeframe.sources import tables

    path = str(tmp_path / "graphs")

    def store(groups):
        nodes = spark.createDataFrame([(g, i) for g in groups for i in range(g)], "space_group_number int, idx long")
        edges = gr.path_edges(nodes, ["space_group_number"])
        sinks.write_graphs(nodes, edges, gr.graph_meta(nodes, edges, ["space_group_number"]), path, "space_group_number")

    store([2, 3])
    store([3, 5])
    sizes = {r.space_group_number: r.num_edges for r in tables.shared_graph_sizes(spark, path).collect()}
    assert sizes == {2: 1, 3: 2, 5: 4}
    one_group = tables.read_group(spark, f"{path}/edges", 5)
    assert one_group.count() == 4
    plan = one_group._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(space_group_number" in plan


def test_property_dump(spark, tmp_path):
    from latticeframe.sources import tables

    (tmp_path / "p.json").write_text('{"jid": "a", "density": NaN}\n{"jid": "b", "kv": 1.5}\n')
    rows = {r.jid: r for r in tables.read_properties(spark, str(tmp_path / "p.json")).collect()}
    assert rows["a"].density != rows["a"].density and rows["a"].kv is None and rows["b"].kv == 1.5


def test_references_of_all_kinds(spark):
    texts = ["A1&uarr;G(2) &#915;&#x3B1; &bogus; &amp;lt; 5 & 6;", "none", None, "&CounterClockwiseContourIntegral;&copy 1&nbsp", "<!-- a -->x<!-- b -->y<script>z</script>"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.texts for r in html.read_pages(df, "k", "t", "texts").collect()}
    assert got == {0: ["A1↑G(2) Γα &bogus; &lt; 5 & 6;"], 1: ["none"], 2: None, 3: ["\u2233© 1"], 4: ["xy"]}


def test_forms_and_links_of_cells(spark):
    page = "<a href='m'>menu</a><table id=t><tr><td>out<form><a href=\"u\">in</a></form></td>lost<td><table><tr><td><a HREF='v'>w</a></table></td></tr><td>no row</table>"
    df = spark.createDataFrame([("k", page)], "k string, html string")
    rows = sorted((r.table_idx, r.row_idx, r.col_idx, r.text, r.has_form, r.href) for r in html.cells(df, "k").collect())
    assert rows == [(0, 0, 0, "outin", True, "u"), (0, 0, 1, "w", False, "v"), (1, 0, 0, "w", False, "v")]
    assert [(r.text, r.href) for r in html.links(df, "k").collect()] == [("menu", "m"), ("in", "u"), ("w", "v")]


def test_nested_tables_keep_their_rows_apart(spark):
    page = "<table><tr><td>o1<table><tr><td>i1<td>i2</tr></table>t<td>o2<tr><td>r2</table><TABLE><TR><TH>z</TABLE>"
    df = spark.createDataFrame([(1, page)], "k int, html string")
    rows = html.read_pages(df, "k").select(html.grids(F.col("tables")).alias("g")).first().g
    assert [[[c.text for c in row] for row in t] for t in rows] == [[["o1i1i2t", "o2"], ["r2"]], [["i1", "i2"]], [["z"]]]


def test_every_page_is_in_one_output(spark):
    boxed = "<table frame=box><tr><td>{}</td><td>1a</td></tr></table>"
    pages = [("a", boxed.format("Wyckoff pos.")), ("b", boxed.format("Wyckoff positions")), ("c", "<table frame=box><tr><td>x</table>"), ("d", None), ("e", "")]
    df = spark.createDataFrame(pages, "k string, html string")
    good = {r.k: r.wyckoff for r in pg.bandrep_columns(df, "k").collect()}
    assert good == {"a": "1a", "b": ""} and {r.k for r in pg.failed_pages(df, "k").collect()} == {"c", "d", "e"}


def test_structures_of_one_text_in_linear_time(spark):
    one = "x\n1.0\n1 0 0\n0 1 0\n0 0 1\nNa\n1\nDirect\n0 0 0\n"
    df = spark.createDataFrame([(n, one * n) for n in (1, 3000)], "n int, value string")
    got = poscar.split_structures(df).groupBy("n").agg(F.count("*").alias("c"), F.max("structure_idx").alias("m")).collect()
    assert {(r.n, r.c, r.m) for r in got} == {(1, 1, 0), (3000, 3000, 2999)}


def test_stages_are_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_root", lambda s: str(tmp_path))
    staged = session.cut_lineage(spark.range(5).toDF("id"))
    assert staged.count() == 5 and os.listdir(tmp_path)
    session.drop_stages(spark)
    assert not os.listdir(tmp_path)
