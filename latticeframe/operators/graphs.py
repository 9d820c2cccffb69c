"""Graphs as vertex and edge tables.

A clique over k members has k(k-1)/2 edges. It is one row per member (``dst`` NULL, ``members`` = k), which says the
same in k rows, whatever k is. Counts, degrees and adjacency follow from it. A line graph is kept the same way: the edges
that come in and go out at each vertex stand for their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, labels
from ..functions.arrays import let, whole
from . import aggregates as agg
from . import ranking
from .vectors import one_hot_sum

SYMMETRY_WEIGHT = 0.8
DECOMPOSITION_WEIGHT = 0.6
NODE_COLUMNS = ("k_point", "irrep_label", "decomposition_index")
# Nodes of a graph without data.
FALLBACK_POINTS = ("Γ", "X", "M", "R")


def node_index(facts: DataFrame, graph: list[str], key: str) -> DataFrame:
    """Position from 0 of each distinct key per graph, in key order."""
    return ranking.dense_index(facts, graph, key, "idx")


def vertices(facts: DataFrame, graph: list[str]) -> DataFrame:
    """Nodes are k-points; without that column irreps, then decomposition indices, then one default node."""
    for name, features in zip(NODE_COLUMNS, (agg.kpoint_features, agg.irrep_features, agg.decomposition_features)):
        if name in facts.columns:
            index = node_index(facts, graph, name)
            rows = features(facts.where(F.col(name).isNotNull()), [*graph, name])
            return index.join(rows, [*graph, name]).withColumnRenamed(name, "key")
    zeros = F.array(*[F.lit(0.0)] * agg.FEATURE_WIDTH)
    return facts.select(*graph).distinct().select(*graph, F.lit("default").alias("key"), F.lit(0).cast("long").alias("idx"), zeros.alias("features"))


def clique_edges(members: DataFrame, graph: list[str], shared: str, weight: float, kind: str) -> DataFrame:
    """Cliques of all vertices ``idx`` of a graph that hold the same ``shared`` value, one row per member.

    One clique per shared value, so the result stands for a multigraph.
    """
    rows = members.where(F.col(shared).isNotNull()).select(*graph, F.col(shared).cast("string").alias("shared"), "idx").distinct()
    sizes = rows.groupBy(*graph, "shared").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return rows.join(sizes, [*graph, "shared"]).select(
        *graph, F.lit(kind).alias("kind"), "shared", F.col("idx").alias("src"), F.lit(None).cast("long").alias("dst"),
        F.lit(weight).alias("weight"), "members",
    )


def linked_graphs(facts: DataFrame, graph: list[str], shared: str, key: str) -> DataFrame:
    """Graphs with an edge: some shared value is held by two distinct vertices."""
    held = facts.where(F.col(shared).isNotNull()).groupBy(*graph, shared).agg(F.min(key).alias("_a"), F.max(key).alias("_b"))
    return held.where("_a <> _b").select(*graph).distinct()


def collapsed(edges: DataFrame, graph: list[str]) -> DataFrame:
    """Parallel edges summed to one edge with their number; member rows of cliques stay apart by ``shared``."""
    apart = F.when(F.col("dst").isNull(), F.col("shared"))
    return edges.groupBy(*graph, "src", "dst", apart.alias("clique")).agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("parallel")
    )


def path_edges(nodes: DataFrame, graph: list[str], mean: str | None = None, kind: str = "band") -> DataFrame:
    """Consecutive vertices, weight 1/(1+|difference of means|), 1.0 without means."""
    order = [F.col("idx")]
    bucket = F.floor(F.col("idx") / 4096)
    carried = nodes.withColumn("_item", F.struct("idx", (F.col(mean) if mean else F.lit(0.0)).alias("mean")))
    linked = ranking.next_value(carried.select(*graph, "idx", "_item"), graph, bucket, order, "_item", "_next")
    linked = linked.where(F.col("_next").isNotNull())
    weight = 1 / (1 + F.abs(F.col("_next.mean") - F.col("_item.mean")))
    return linked.select(
        *graph, F.lit(kind).alias("kind"), F.col("idx").alias("src"), F.col("_next.idx").alias("dst"),
        F.coalesce(weight, F.lit(1.0)).alias("weight"),
    )


def chain_fallback(nodes: DataFrame, linked: DataFrame, graph: list[str]) -> DataFrame:
    """A chain with weight 1 for each graph of several vertices that isn't among ``linked`` ones (edges will do)."""
    lonely = nodes.join(linked.select(*graph).distinct(), graph, "left_anti")
    return path_edges(lonely, graph, kind="chain")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse."""
    swapped = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(swapped)


def adjacency(edges: DataFrame, graph: list[str]) -> DataFrame:
    """Symmetric 0/1 matrix: its ones along paths, and cliques as (src, clique) entries with NULL ``dst``."""
    has_stars = "members" in edges.columns
    clique = F.when(F.col("dst").isNull(), F.concat_ws("|", "kind", "shared")) if has_stars else F.lit(None).cast("string")
    rows = edges.select(*graph, "src", "dst", clique.alias("clique"))
    reverse = rows.where(F.col("dst").isNotNull()).select(*graph, F.col("dst").alias("src"), F.col("src").alias("dst"), "clique")
    return rows.unionByName(reverse).distinct()


def graph_meta(nodes: DataFrame, edges: DataFrame, graph: list[str], width: int = agg.FEATURE_WIDTH) -> DataFrame:
    """Vertices, edges and feature width per graph; the member rows of a clique count as its edges."""
    counted = nodes.groupBy(*graph).agg(F.count(F.lit(1)).alias("num_nodes"))
    one = F.when(F.col("dst").isNull(), (F.col("members") - 1) / 2).otherwise(1.0) if "members" in edges.columns else F.lit(1.0)
    sizes = edges.groupBy(*graph).agg(F.sum(one).cast("long").alias("num_edges"))
    joined = counted.join(sizes, graph, "left")
    return joined.select(*graph, "num_nodes", F.coalesce("num_edges", F.lit(0)).alias("num_edges"), F.lit(width).alias("feature_dim"))


def band_graph_nodes(material: DataFrame, key: str, groups: str = "band_groups") -> DataFrame:
    """Per material and k-point: its (group, bands, subclass, irrep, degeneracy) entries, in k-point order.

    The nested rows of a material are regrouped inside its own row.
    """
    entries = F.flatten(
        F.transform(
            groups,
            lambda g, i: F.transform(
                g["reps"],
                lambda r: F.struct(
                    r["k_point"].alias("k_point"),
                    F.struct(
                        i.alias("band_group"), g["num_bands"].alias("num_bands"), g["subclass"].alias("subclass"),
                        r["irrep_label"].alias("irrep_label"), r["degeneracy"].alias("degeneracy"),
                    ).alias("entry"),
                ),
            ),
        )
    )
    listed = material.select(key, entries.alias("_e"))
    names = F.array_sort(F.array_distinct(F.transform("_e", lambda e: e["k_point"])))
    nodes = listed.select(key, "_e", F.posexplode(names).alias("idx", "k_point"))
    mine = F.transform(F.filter("_e", lambda e: e["k_point"] == F.col("k_point")), lambda e: e["entry"])
    return nodes.select(key, "idx", "k_point", mine.alias("entries"), F.size(mine).alias("num_entries"))


def band_graph_edges(nodes: DataFrame, key: str) -> DataFrame:
    """Edges along the sorted k-points, labelled ``a-b``; positions are dense, so the next node is an equi join."""
    after = nodes.select(key, (F.col("idx") - 1).alias("idx"), F.col("k_point").alias("_next"))
    joined = nodes.select(key, "idx", "k_point").join(after, [key, "idx"])
    return joined.select(
        key, F.col("idx").alias("src"), (F.col("idx") + 1).alias("dst"), F.concat_ws("-", "k_point", "_next").alias("label")
    )


def fallback_graphs(groups: DataFrame, graph: list[str]) -> tuple[DataFrame, DataFrame]:
    """Four fixed points at the origin in a chain, for groups without a graph."""
    points = F.array(*[F.struct(F.lit(p).alias("key"), F.lit(i).alias("idx")) for i, p in enumerate(FALLBACK_POINTS)])
    nodes = groups.select(*graph, F.explode(points).alias("p")).select(
        *graph, "p.key", F.col("p.idx").cast("long").alias("idx"), F.array(*[F.lit(0.0)] * 3).alias("features")
    )
    return nodes, path_edges(nodes, graph, kind="chain")


def line_graph(edges: DataFrame, graph: list[str]) -> DataFrame:
    """Links from each edge to the edges that start where it ends, as the rows of the turning vertex ``via``.

    One row per incoming edge (role in, from ``a``) and per outgoing edge (role out, to ``b``) of each vertex that has
    both; every in row of a vertex is linked with every out row of it.
    """
    at_dst, at_src = (edges.select(*graph, F.col(c).alias("via")).distinct() for c in ("dst", "src"))
    turns = at_dst.join(at_src, [*graph, "via"])
    none = F.lit(None).cast("long")
    ends = F.explode(F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("via"), none.alias("b"), F.lit("in").alias("role")),
        F.struct(none.alias("a"), F.col("src").alias("via"), F.col("dst").alias("b"), F.lit("out").alias("role")),
    )).alias("e")
    return edges.select(*graph, ends).select(*graph, "e.*").join(turns, [*graph, "via"], "left_semi").select(*graph, "a", "via", "b", "role")


def _around(n: int) -> Column:
    """All offsets -1, 0, 1 in n dimensions as an array of structs."""
    offsets = [[]]
    for _ in range(n):
        offsets = [o + [d] for o in offsets for d in (-1, 0, 1)]
    return F.array(*[F.struct(*[F.lit(d).alias(f"o{i}") for i, d in enumerate(o)]) for o in offsets])


# Positions of one cell that one task compares; fuller cells are split into salted parts.
CELL_PART = 20_000


def _cell_joined(left: DataFrame, right: DataFrame, group: list[str], coords: list[str], cutoff: float, key: str) -> DataFrame:
    """Rows of ``left`` (coordinates ``_a_*``) with those of ``right`` (``_b_*``) at most ``cutoff`` apart, as ``distance``."""
    cells = [f"_c{i}" for i in range(len(coords))]
    right = right.select("*", *[F.floor(F.col(f"_b_{c}") / cutoff).alias(n) for n, c in zip(cells, coords)])
    sizes = right.groupBy(*group, *cells).agg(F.ceil(F.count(F.lit(1)) / CELL_PART).cast("int").alias("_parts"))
    right = right.join(sizes, [*group, *cells]).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).drop("_parts")
    left = left.select("*", F.explode(_around(len(coords))).alias("_o"))
    left = left.select("*", *[(F.floor(F.col(f"_a_{c}") / cutoff) + F.col(f"_o.o{i}")).alias(cells[i]) for i, c in enumerate(coords)]).drop("_o")
    left = left.join(sizes, [*group, *cells]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    squares = [(F.col(f"_a_{c}") - F.col(f"_b_{c}")) * (F.col(f"_a_{c}") - F.col(f"_b_{c}")) for c in coords]
    pairs = left.join(right, [*group, *cells, "_part"]).withColumn("distance", F.sqrt(sum(squares[1:], squares[0])))
    return pairs.where(F.col("distance") <= cutoff)


def near_pairs(points: DataFrame, group: list[str], key: str, coords: list[str], cutoff: float) -> DataFrame:
    """Pairs of positions of one group at most ``cutoff`` apart, each pair once.

    Points on the same position count as one position with ``copies``, named by
    their smallest key, so a pile of copies gives no pairs among itself. Positions
    meet through grid cells of the cutoff's size: an equi join on (group, cell, part of a full cell).
    """
    positions = points.groupBy(*group, *coords).agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("copies"))
    left = positions.select(*group, F.col("id").alias("src"), F.col("copies").alias("src_copies"), *[F.col(c).alias(f"_a_{c}") for c in coords])
    right = positions.select(*group, F.col("id").alias("dst"), F.col("copies").alias("dst_copies"), *[F.col(c).alias(f"_b_{c}") for c in coords])
    pairs = _cell_joined(left, right, group, coords, cutoff, "dst").where("src < dst")
    return pairs.select(*group, "src", "dst", "src_copies", "dst_copies", "distance")


# Positions of a group that meet each other inside their row; larger groups go through cells.
ROW_PLACES = 64


def near_pairs_in_rows(rows: DataFrame, group: list[str], places: str, cutoff: float) -> DataFrame:
    """``near_pairs`` of groups that are one row each, with an array of 3-dimensional positions whose indexes are the keys.

    Groups of up to ``ROW_PLACES`` positions are paired inside their row, without a shuffle; only larger ones go through
    cells. The rows are read twice, so they should be staged.
    """
    coords = ["x", "y", "z"]

    def distance(a: Column, b: Column) -> Column:
        squares = [(a["p"][i] - b["p"][i]) * (a["p"][i] - b["p"][i]) for i in range(3)]
        return F.sqrt(squares[0] + squares[1] + squares[2])

    def paired(p: Column) -> Column:
        kept = F.transform(p, lambda v, i: F.struct(i.alias("id"), F.size(F.filter(p, lambda q: q == v)).cast("long").alias("copies"), v.alias("p"), F.array_position(p, v).alias("first")))
        positions = F.filter(kept, lambda v: v["first"] == v["id"] + 1)
        pair = lambda a, b: F.struct(
            a["id"].alias("src"), b["id"].alias("dst"), a["copies"].alias("src_copies"), b["copies"].alias("dst_copies"), distance(a, b).alias("distance")
        )
        of = lambda all_, a: F.transform(F.filter(all_, lambda b: (b["id"] > a["id"]) & (distance(a, b) <= cutoff)), lambda b: pair(a, b))
        return let(positions, lambda all_: F.flatten(F.transform(all_, lambda a: of(all_, a))))

    small = rows.where(F.size(places) <= ROW_PLACES).select(*group, F.explode(whole(paired(F.col(places)))).alias("_e")).select(*group, "_e.*")
    large = rows.where(F.size(places) > ROW_PLACES).select(*group, F.posexplode(places).alias("_id", "_p"))
    large = large.select(*group, "_id", *[F.col("_p")[i].alias(c) for i, c in enumerate(coords)])
    return small.unionByName(near_pairs(large, group, "_id", coords, cutoff))


def periodic_neighbours(sites: DataFrame, keys: list[str], cutoff: float = 8.0, image_distance: bool = True) -> DataFrame:
    """Atom neighbours within the cutoff over periodic images: one edge per site pair and image.

    ``sites`` holds the lattice, ``site_idx`` and ``cart``. The images per axis follow from the
    height of the cell, so flat cells get more of them. Structures of up to ``ROW_PLACES`` sites are compared
    in full, one task each; larger ones meet through grid cells. ``image_distance`` False gives the distance
    inside the cell instead, as the older convention does.
    """
    heights = geometry.cell_heights(F.col("lattice"))
    reach = F.transform(heights, lambda h: F.ceil(F.lit(cutoff) / h).cast("int"))
    present = sites.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)) if keys else sites
    framed = present.select(*keys, "site_idx", "lattice", "cart", reach.alias("_r"))
    if keys:
        # Sites are few bytes for what follows from them, so they are dealt out by hand.
        spark = sites.sparkSession
        framed = framed.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
        # A bounded frame: all sites of a small structure, a part of a large one's, which goes through cells.
        own = Window.partitionBy(*keys)
        frame = own.orderBy("site_idx").rowsBetween(1 - ROW_PLACES, ROW_PLACES - 1)
        counted = framed.withColumn("_n", F.count(F.lit(1)).over(own))
        small = counted.withColumn("_all", F.collect_list(F.struct("site_idx", "lattice", "cart", "_r")).over(frame)).where(F.col("_n") <= ROW_PLACES)
        place = [F.col("cart")[j].alias(f"_a{j}") for j in range(3)]
        met = small.select(*keys, F.col("site_idx").alias("src"), *place, F.explode(whole("_all")).alias("_s"))
        met = met.select(*keys, "src", "_a0", "_a1", "_a2", "_s.site_idx", "_s.lattice", "_s.cart", "_s._r")
        inside = _image_rows(met, [*keys, "src", "_a0", "_a1", "_a2"])
        framed = counted.where(F.col("_n") > ROW_PLACES).drop("_n")
    images = _image_rows(framed, keys)
    images = images.select("*", *[F.floor(F.col(f"_b{j}") / cutoff).alias(f"_c{j}") for j in range(3)])
    centre = framed.select(*keys, F.col("site_idx").alias("src"), *[F.col("cart")[j].alias(f"_a{j}") for j in range(3)], F.explode(_around(3)).alias("_o"))
    centre = centre.select(
        *keys, "src", "_a0", "_a1", "_a2", *[(F.floor(F.col(f"_a{j}") / cutoff) + F.col(f"_o.o{j}")).alias(f"_c{j}") for j in range(3)]
    )
    pairs = centre.join(images, [*keys, "_c0", "_c1", "_c2"]).drop("_c0", "_c1", "_c2")
    square = lambda a, b: (a - b) * (a - b)
    image_d, cell_d = (
        F.sqrt(sum((square(F.col(f"_a{j}"), F.col(f"{to}{j}")) for j in (1, 2)), square(F.col("_a0"), F.col(f"{to}0")))) for to in ("_b", "_h")
    )

    def near(pairs: DataFrame) -> DataFrame:
        found = pairs.withColumn("_d", image_d).where((F.col("_d") <= cutoff) & (F.col("_d") > 1e-8))
        image = F.array("_n0", "_n1", "_n2").alias("image")
        return found.select(*keys, "src", "dst", image, (F.col("_d") if image_distance else cell_d).alias("distance"))

    return near(inside).unionByName(near(pairs)) if keys else near(pairs)


def _image_rows(sites: DataFrame, kept: list[str]) -> DataFrame:
    """One row per site and periodic image within its reach ``_r``, with its position ``_b*``."""
    # Plain numbers keep the generated code small enough to be compiled.
    numbers = [F.col("lattice")[i][j].alias(f"_l{i}{j}") for i in range(3) for j in range(3)] + [F.col("cart")[j].alias(f"_h{j}") for j in range(3)]
    images = sites.select(*kept, F.col("site_idx").alias("dst"), *numbers, *[F.sequence(-F.col("_r")[i], F.col("_r")[i]).alias(f"_s{i}") for i in range(3)])
    for i in range(3):
        images = images.withColumn(f"_n{i}", F.explode(whole(f"_s{i}"))).drop(f"_s{i}")
    moved = [
        F.col(f"_h{j}") + sum((F.col(f"_n{i}") * F.col(f"_l{i}{j}") for i in (1, 2)), F.col("_n0") * F.col(f"_l0{j}"))
        for j in range(3)
    ]
    return images.select(*kept, "dst", "_n0", "_n1", "_n2", *[f"_h{j}" for j in range(3)], *[m.alias(f"_b{j}") for j, m in enumerate(moved)])


def nearest_edges(points: DataFrame, group: list[str], key: str, coords: list[str], cutoff: float, k: int) -> DataFrame:
    """The k nearest other points of each point within ``cutoff``, ties by key, with weight d_min / d (1 at distance 0).

    Points on one position share their neighbours: a position offers its k + 1 smallest keys, each position keeps the
    best k + 1 offers, and every point then drops itself. So a pile of copies costs k + 1 keys, not its square.
    """
    place = [*group, *coords]
    offers = points.select(*place, F.col(key).alias("dst"))
    own = Window.partitionBy(*place).orderBy("dst")
    offers = offers.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= k + 1)
    right = offers.groupBy(*place).agg(F.collect_list("dst").alias("_ids"), F.min("dst").alias("_first"))
    right = right.select(*group, "_ids", "_first", *[F.col(c).alias(f"_b_{c}") for c in coords])
    left = points.select(*place).distinct().select(*group, *[F.col(c).alias(f"_a_{c}") for c in coords])
    near = _cell_joined(left, right, group, coords, cutoff, "_first")
    home = [*group, *[f"_a_{c}" for c in coords]]
    each = near.select(*home, "distance", F.explode("_ids").alias("dst"))
    best = each.withColumn("_r", F.row_number().over(Window.partitionBy(*home).orderBy("distance", "dst"))).where(F.col("_r") <= k + 1)
    sources = points.select(*group, F.col(key).alias("src"), *[F.col(c).alias(f"_a_{c}") for c in coords])
    met = sources.join(best.drop("_r"), home).where("src <> dst")
    order = Window.partitionBy(*group, "src").orderBy("distance", "dst")
    # At most k + 1 rows per point.
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    least = F.min("distance").over(Window.partitionBy(*group, "src"))
    weight = F.when(F.col("distance") > 0, least / F.col("distance")).otherwise(1.0)
    return ranked.select(*group, "src", "dst", "rank", "distance", weight.alias("weight"))


def kpoint_node_vectors(
    facts: DataFrame, graph: list[str], irreps: list[str], branches: list[str], decompositions: list[str]
) -> DataFrame:
    """Per k-point: coordinates | irrep one-hot sum | branch multi-hot | code of the first decomposition index.

    A k-point whose text is no coordinate is skipped. The last slot of the decomposition code
    stands for a missing index.
    """
    names = F.concat(
        F.split(F.coalesce("branch1_irreps", F.lit("")), ","), F.split(F.coalesce("branch2_irreps", F.lit("")), ",")
    )
    rows = facts.select(*graph, "k_point", "irrep_label", "decomposition_index", F.explode(names).alias("_b"))
    # The sets hold vocabulary labels only.
    grouped = rows.groupBy(*graph, "k_point").agg(
        F.collect_set(F.when(F.col("irrep_label").isin(irreps), F.col("irrep_label"))).alias("_i"),
        F.collect_set(F.when(F.trim("_b").isin(branches), F.trim("_b"))).alias("_branches"),
        F.min("decomposition_index").alias("_d"),
    )
    placed = grouped.withColumn("_k", labels.kpoint_coordinates("k_point")).where(F.col("_k").isNotNull())
    code = F.array(*[(F.col("_d").eqNullSafe(F.lit(d))).cast("double") for d in [*decompositions, None]])
    vector = F.concat("_k", one_hot_sum(F.col("_i"), irreps), one_hot_sum(F.col("_branches"), branches), code)
    return placed.select(*graph, "k_point", vector.alias("features"))
