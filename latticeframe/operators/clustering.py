"""Density clustering, connected components, component curves and 2-D projection.

Points meet through grid cells. The cell's diagonal is the search radius, so all points
of one cell are neighbours without any comparison: a cell with enough points
is core as a whole, however many points it holds.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import cut_lineage
from .vectors import cloud_covariance

NOISE = "-1"
# Positions of one cell that one task compares; fuller cells are split into salted parts.
CELL_PART = 20_000


def _rooted(hooks: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, parent), by pointer doubling; roots themselves have no row.

    Each round is a written table, so both sides of the join are plain scans and a parent with many children is split.
    """
    state = cut_lineage(hooks.select("node", "parent"))
    while True:
        above = state.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        watch = Observation()
        moved = state.join(above, "parent", "left").observe(watch, F.count("_up").alias("moved"))
        state = cut_lineage(moved.select("node", F.coalesce("_up", "parent").alias("parent")))
        if not watch.get["moved"]:
            return state.withColumnRenamed("parent", "root")


def _relabelled(rows: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    named = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return rows.join(named, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")


def _flat(maps: list[DataFrame], nodes: DataFrame) -> DataFrame:
    """(node, component) from the rounds' maps: a node is hooked in one round at most, so they are one forest."""
    if not maps:
        return nodes.select("node", F.col("node").alias("component"))
    forest = maps[0]
    for m in maps[1:]:
        forest = forest.unionByName(m)
    roots = _rooted(forest.withColumnRenamed("root", "parent")) if len(maps) > 1 else forest
    return _relabelled(nodes.select("node", F.col("node").alias("component")), "component", roots)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node as the component's name.

    In each round every component hooks to its smallest neighbour, if that is smaller; the trees that result
    are contracted, and only distinct edges between different components go on. Components that have a smaller
    neighbour disappear, so the rounds are about the logarithm of the size.
    """
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    live = cut_lineage(edges.select("src", "dst").unionByName(flipped).where(F.col("src") != F.col("dst")).distinct())
    maps = []
    while True:
        least = live.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("parent"))
        hooks = cut_lineage(least.where(F.col("parent") < F.col("node")))
        if hooks.isEmpty():
            return _flat(maps, nodes)
        maps.append(_rooted(hooks))
        moved = _relabelled(_relabelled(live, "src", maps[-1]), "dst", maps[-1])
        live = cut_lineage(moved.where(F.col("src") != F.col("dst")).distinct())


def components_by_key(members: DataFrame) -> DataFrame:
    """(node, component) of nodes that hang together by shared keys (node, key), without a table of edges.

    Rounds as in ``connected_components``: a component hooks to the smallest one that any of its keys holds. Keys whose
    members are in one component are done and leave; members are one row per component and open key.
    """
    nodes = members.select("node").distinct()
    live = cut_lineage(members.select("node", "key").distinct())
    maps = []
    while True:
        heads = live.groupBy("key").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi"))
        heads = cut_lineage(heads.where(F.col("_lo") < F.col("_hi")).select("key", "_lo"))
        if heads.isEmpty():
            return _flat(maps, nodes)
        open_ = cut_lineage(live.join(heads, "key"))
        least = open_.groupBy("node").agg(F.min("_lo").alias("parent"))
        maps.append(_rooted(least.where(F.col("parent") < F.col("node"))))
        live = cut_lineage(_relabelled(open_.select("node", "key"), "node", maps[-1]).distinct())


def _cells(coords: list[str], side: float) -> Column:
    return F.array(*[F.floor(F.col(c) / side) for c in coords])


def _offsets(n: int, reach: int) -> list[tuple[int, ...]]:
    """Cell offsets that can hold a point within the radius."""
    limit = n  # radius squared in units of the cell side squared

    def gap(d: int) -> int:
        return max(abs(d) - 1, 0)

    return [o for o in itertools.product(range(-reach, reach + 1), repeat=n) if sum(gap(d) ** 2 for d in o) <= limit]


def _shifted(offsets) -> Column:
    """The neighbouring cells of ``cell`` as an array."""
    moved = [F.array(*[F.col("cell")[i] + F.lit(d) for i, d in enumerate(o)]) for o in offsets]
    return F.array(*moved)


def _distance2(left: str, right: str, coords: list[str]) -> Column:
    terms = [(F.col(f"{left}{c}") - F.col(f"{right}{c}")) * (F.col(f"{left}{c}") - F.col(f"{right}{c}")) for c in coords]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _boxes(rows: DataFrame, keys: list[str], coords: list[str]) -> DataFrame:
    bounds = [f(c).alias(f"{p}_{c}") for c in coords for p, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy(*keys).agg(*bounds)


def _box_tests(coords: list[str], eps2: float) -> tuple[Column, Column]:
    """(all points within the radius, some point may be) for box pairs with prefixes ``a_`` and ``b_``."""
    far, near = F.lit(0.0), F.lit(0.0)
    for c in coords:
        reach = F.greatest(F.col(f"a_hi_{c}") - F.col(f"b_lo_{c}"), F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}"))
        gap = F.greatest(F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}"), F.lit(0.0))
        far, near = far + reach * reach, near + gap * gap
    return far <= eps2, near <= eps2


def _dense_links(positions: DataFrame, dense: DataFrame, group: list[str], coords: list[str], side: float, eps: float, offsets) -> DataFrame:
    """Links between neighbouring dense cells that hold two points within the radius.

    Boxes of ever finer sub-cells decide almost every cell pair; only boxes that stay
    undecided at the finest level are compared point by point.
    """
    half = [o for o in offsets if o > tuple([0] * len(coords))]
    eps2 = eps * eps
    mine = dense.select(*group, "cell")
    open_pairs = mine.select(*group, F.col("cell").alias("src"), F.explode(_shifted(half)).alias("dst")).join(
        mine.withColumnRenamed("cell", "dst"), [*group, "dst"]
    )
    rows = positions.join(mine, [*group, "cell"], "left_semi")
    links = None
    # (src, dst, sub-cell of each side) still open; level 1 is the whole cell.
    state = open_pairs.select(*group, "src", "dst", F.array().cast("array<bigint>").alias("_sa"), F.array().cast("array<bigint>").alias("_sb"))
    for level in (1, 8, 64):
        sub = _cells(coords, side / level) if level > 1 else F.array().cast("array<bigint>")
        boxes = _boxes(rows.select(*group, "cell", *coords, sub.alias("sub")), [*group, "cell", "sub"], coords)
        if level > 1:
            coarse = level // 8
            parent = F.transform("sub", lambda s: F.floor(s / 8)) if coarse > 1 else F.array().cast("array<bigint>")
            boxes = boxes.withColumn("up", parent)
        else:
            boxes = boxes.withColumn("up", F.col("sub"))
        bound = [f"{p}_{c}" for c in coords for p in ("lo", "hi")]
        a = boxes.select(*group, F.col("cell").alias("src"), F.col("up").alias("_sa"), F.col("sub").alias("_na"), *[F.col(b).alias(f"a_{b}") for b in bound])
        b = boxes.select(*group, F.col("cell").alias("dst"), F.col("up").alias("_sb"), F.col("sub").alias("_nb"), *[F.col(x).alias(f"b_{x}") for x in bound])
        surely, maybe = _box_tests(coords, eps2)
        tested = state.join(a, [*group, "src", "_sa"]).join(b, [*group, "dst", "_sb"]).where(maybe).withColumn("_sure", surely)
        tested = cut_lineage(tested.select(*group, "src", "dst", F.col("_na").alias("_sa"), F.col("_nb").alias("_sb"), "_sure"))
        found = tested.where("_sure").select(*group, "src", "dst").distinct()
        links = found if links is None else links.unionByName(found)
        state = tested.join(found, [*group, "src", "dst"], "left_anti").drop("_sure")
        if state.isEmpty():
            return links
    fine = rows.select(*group, "cell", *coords, _cells(coords, side / 64).alias("sub"))
    a = fine.select(*group, F.col("cell").alias("src"), F.col("sub").alias("_sa"), *[F.col(c).alias(f"a_{c}") for c in coords])
    b = fine.select(*group, F.col("cell").alias("dst"), F.col("sub").alias("_sb"), *[F.col(c).alias(f"b_{c}") for c in coords])
    close = state.join(a, [*group, "src", "_sa"]).join(b, [*group, "dst", "_sb"]).where(_distance2("a_", "b_", coords) <= eps2)
    return links.unionByName(close.select(*group, "src", "dst").distinct())


def _neighbour_rows(sparse: DataFrame, positions: DataFrame, group: list[str], coords: list[str], eps: float, offsets) -> DataFrame:
    """Pairs of a position in a sparse cell with every position within the radius.

    A sparse cell holds few positions, so a full cell meets a bounded number of them;
    full cells are salted into parts so that no task reads one whole.
    """
    key = [*group, "cell"]
    sizes = positions.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / CELL_PART).cast("int").alias("_parts"))
    right = positions.join(sizes, key).withColumn("_part", F.pmod(F.xxhash64("pid"), F.col("_parts")).cast("int")).drop("_parts")
    right = right.select(*key, "_part", F.col("pid").alias("other"), F.col("weight").alias("other_weight"), *[F.col(c).alias(f"b_{c}") for c in coords])
    left = sparse.select(*group, F.col("pid"), F.col("cell").alias("home"), F.explode(_shifted(offsets)).alias("cell"), *[F.col(c).alias(f"a_{c}") for c in coords])
    left = left.join(sizes, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    pairs = left.join(right, [*key, "_part"]).where(_distance2("a_", "b_", coords) <= eps * eps)
    return pairs.select(*group, "pid", "home", "other", F.col("cell").alias("other_cell"), "other_weight")


def density_clusters(
    points: DataFrame, key: str, coords: list[str], eps: float = 0.5, min_points: int = 5, group: list[str] | None = None
) -> DataFrame:
    """DBSCAN labels as text: the smallest key among the cluster's core points, ``-1`` for noise.

    A point counts itself. A border point takes the lowest label among its core neighbours.
    """
    group = group or []
    n = len(coords)
    side = eps / math.sqrt(n) * (1 - 1e-9)
    offsets = _offsets(n, math.ceil(eps / side))
    positions = points.groupBy(*group, *coords).agg(F.min(key).alias("pid"), F.count(F.lit(1)).alias("weight"))
    positions = cut_lineage(positions.withColumn("cell", _cells(coords, side)))
    cells = positions.groupBy(*group, "cell").agg(F.sum("weight").alias("_w"))
    dense = cells.where(F.col("_w") >= min_points).select(*group, "cell")
    sparse = positions.join(dense, [*group, "cell"], "left_anti")
    near = cut_lineage(_neighbour_rows(sparse, positions, group, coords, eps, offsets))
    counted = near.groupBy(*group, "pid").agg(F.sum("other_weight").alias("_n"))
    sparse_core = sparse.join(counted.where(F.col("_n") >= min_points), [*group, "pid"], "left_semi")
    core = cut_lineage(positions.join(dense, [*group, "cell"], "left_semi").unionByName(sparse_core.select(*positions.columns)))
    core_ids = core.select(*group, "pid")
    core_cells = core.groupBy(*group, "cell").agg(F.min("pid").alias("first"))
    sparse_links = (
        near.join(core_ids, [*group, "pid"], "left_semi")
        .join(core_ids.withColumnRenamed("pid", "other"), [*group, "other"], "left_semi")
        .where(F.col("home") != F.col("other_cell"))
        .select(*group, F.col("home").alias("src"), F.col("other_cell").alias("dst"))
    )
    links = sparse_links.unionByName(_dense_links(positions, dense, group, coords, side, eps, offsets)).distinct()
    names = core_cells.select(*group, F.col("cell").alias("src"), F.col("first").alias("_a"))
    ends = links.join(names, [*group, "src"]).join(
        core_cells.select(*group, F.col("cell").alias("dst"), F.col("first").alias("_b")), [*group, "dst"]
    )
    # Keys may repeat from group to group, so a node is a key with its group.
    node = lambda c: F.struct(*group, F.col(c).alias("first"))
    components = connected_components(
        core_cells.select(node("first").alias("node")), ends.select(node("_a").alias("src"), node("_b").alias("dst"))
    ).select("node.*", F.col("component.first").alias("component"))
    labelled = core_cells.join(components, [*group, "first"]).select(*group, "cell", "component")
    core_labels = core.join(labelled, [*group, "cell"]).select(*group, "pid", "component")
    border = (
        near.join(core_ids, [*group, "pid"], "left_anti")
        .join(core_ids.withColumnRenamed("pid", "other"), [*group, "other"], "left_semi")
        .join(labelled.withColumnRenamed("cell", "other_cell"), [*group, "other_cell"])
        .groupBy(*group, "pid").agg(F.min("component").alias("component"))
    )
    found = positions.join(core_labels.unionByName(border), [*group, "pid"], "left")
    label = F.coalesce(F.col("component").cast("string"), F.lit(NOISE))
    return points.join(found.select(*group, *coords, label.alias("cluster")), [*group, *coords]).select(key, *group, *coords, "cluster")


CURVE_POINTS = 20
CURVE_REACH = 10.0
# Factor from one search radius to the next.
GROWTH = 4.0


# Edges that one task spans at once; a cloud of more is dealt into blocks.
BLOCK_EDGES = 100_000


def _span(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning forest of a block: places of its edges, and (node, root) of all nodes; all graphs of the block at once."""
    order = np.lexsort((b, a, w))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)][order], ends[len(a) :][order]
    comp, place, taken = np.arange(len(nodes)), order, []
    while True:
        x, y = comp[left], comp[right]
        apart = x != y
        left, right, place, x, y = left[apart], right[apart], place[apart], x[apart], y[apart]
        if not len(x):
            break
        # Edges are in order, so the first one of a component is its least.
        both = np.stack([x, y], 1).ravel()
        who, first = np.unique(both, return_index=True)
        parent = np.arange(len(nodes))
        parent[who] = np.stack([y, x], 1).ravel()[first]
        mutual = who[(parent[parent[who]] == who) & (who < parent[who])]
        parent[mutual] = mutual
        taken.append(np.unique(place[first // 2]))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        comp = parent[comp]
    edges = np.unique(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, comp, nodes)
    return edges, nodes, least[comp]


def _span_blocks(table: pa.Table) -> pa.Table:
    """Of whole clouds one row per node that is no root (node, root, length of one edge); of other blocks the edges that may stay."""
    table = table.combine_chunks()
    out = []
    for whole in (True, False):
        part = table.filter(pc.equal(table.column("whole"), whole))
        if not part.num_rows:
            continue
        a, b, w = (part.column(c).to_numpy() for c in ("a", "b", "w"))
        edges, nodes, roots = _span(a, b, w)
        if not whole:
            out.append(part.take(pa.array(edges)).select(["cloud", "a", "b", "w", "whole"]))
            continue
        # A tree has one edge less than nodes: its edges stand beside its nodes but the root.
        inner = np.flatnonzero(nodes != roots)
        root_of = dict(zip(nodes.tolist(), roots.tolist()))
        tree = np.fromiter((root_of[n] for n in a[edges].tolist()), np.int64, len(edges))
        edges = edges[np.argsort(tree, kind="stable")]
        inner = inner[np.argsort(roots[inner], kind="stable")]
        cloud = part.column("cloud").take(pa.array(edges))
        out.append(pa.table({"cloud": cloud, "a": pa.array(nodes[inner]), "b": pa.array(roots[inner]), "w": pa.array(w[edges]), "whole": pa.array(np.ones(len(edges), bool))}))
    return pa.concat_tables(out)


def _forest(edges: DataFrame, group: str) -> tuple[DataFrame, DataFrame] | None:
    """Minimum spanning forest of edges (group, a, b, w) with a < b: ((group, w) of its edges, (node, root) of its trees).

    Blocks of edges are spanned in tasks first, as an edge that closes a circle inside a block is no part of the forest. A
    cloud of one block is done then. In each of the rounds that follow every component takes its least outgoing edge (ties by its
    two ends, so no circle but of two that choose each other); the trees are contracted and only the least edge between each
    two components goes on.
    """
    live = cut_lineage(edges.groupBy(group, "a", "b").agg(F.min("w").alias("w")))
    sizes = live.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / BLOCK_EDGES).cast("int").alias("_k"))
    total = live.count()
    if not total:
        return None
    baskets = max(1, -(-total // BLOCK_EDGES), live.sparkSession.sparkContext.defaultParallelism)
    basket = F.when(F.col("_k") == 1, F.pmod(F.xxhash64(group), F.lit(baskets))).otherwise(F.xxhash64(group, F.pmod(F.xxhash64("a", "b"), F.col("_k"))))
    dealt = live.join(sizes, group).select(F.col(group).alias("cloud"), "a", "b", "w", (F.col("_k") == 1).alias("whole"), basket.alias("basket"))
    fields = [StructField("cloud", edges.schema[group].dataType), *StructType.fromDDL("a long, b long, w double, whole boolean").fields]
    spanned = cut_lineage(dealt.groupBy("basket").applyInArrow(_span_blocks, StructType(fields)).withColumnRenamed("cloud", group))
    done = spanned.where("whole")
    live = spanned.where("not whole").drop("whole")
    taken, maps = [done.select(group, "w")], [done.select(F.col("a").alias("node"), F.col("b").alias("root"))]
    while not live.isEmpty():
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("parent")), F.struct(F.col("b").alias("node"), F.col("a").alias("parent")))).alias("e")
        order = F.struct("w", F.least("node", "parent").alias("lo"), F.greatest("node", "parent").alias("hi"), "parent", group)
        pick = live.select(group, "w", ends).select(group, "w", "e.*").groupBy("node").agg(F.min(order).alias("m"))
        pick = cut_lineage(pick.select("node", "m.parent", "m.w", f"m.{group}"))
        back = pick.select(F.col("node").alias("parent"), F.col("parent").alias("_back"))
        mutual = (F.col("_back") == F.col("node")) & (F.col("node") < F.col("parent"))
        hooks = cut_lineage(pick.join(back, "parent").where(~mutual).select("node", "parent", "w", group))
        taken.append(hooks.select(group, "w"))
        maps.append(_rooted(hooks))
        moved = _relabelled(_relabelled(live, "a", maps[-1]), "b", maps[-1]).where(F.col("a") != F.col("b"))
        moved = moved.select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
        live = cut_lineage(moved.groupBy(group, "a", "b").agg(F.min("w").alias("w")))
    forest, lengths = maps[0], taken[0]
    for m, t in zip(maps[1:], taken[1:]):
        forest, lengths = forest.unionByName(m), lengths.unionByName(t)
    # Later rounds hook the roots of earlier ones; whole clouds have no later round.
    return lengths, _rooted(forest.withColumnRenamed("root", "parent")) if len(maps) > 2 else forest


def _between(open_: DataFrame, cloud: str, coords: list[str]) -> DataFrame:
    """Edges (cloud, a, b, w) within the radius ``_r`` of each cloud, between points of different components.

    Points whose neighbouring cells hold their own component only meet nobody.
    """
    placed = open_.withColumn("cell", F.array(*[F.floor(F.col(c) / F.col("_r")) for c in coords]))
    around = list(itertools.product((-1, 0, 1), repeat=len(coords)))
    spans = placed.groupBy(cloud, "cell").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
    seen = spans.select(cloud, F.explode(_shifted(around)).alias("cell"), "_lo", "_hi").groupBy(cloud, "cell").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    mixed = cut_lineage(seen.where(F.col("_lo") != F.col("_hi")).select(cloud, "cell"))
    live = cut_lineage(placed.join(mixed, [cloud, "cell"], "left_semi"))
    half = [o for o in around if o >= tuple([0] * len(coords))]
    left = live.select(cloud, "_r", F.col("pid").alias("p"), F.col("comp").alias("_c"), F.col("cell").alias("home"), F.explode(_shifted(half)).alias("cell"), *[F.col(c).alias(f"a_{c}") for c in coords])
    right = live.select(cloud, "cell", F.col("pid").alias("q"), F.col("comp").alias("_d"), *[F.col(c).alias(f"b_{c}") for c in coords])
    length = F.sqrt(_distance2("a_", "b_", coords)).alias("w")
    # Pairs inside a cell once, by their numbers.
    once = (F.col("home") != F.col("cell")) | (F.col("p") < F.col("q"))
    pairs = left.join(right, [cloud, "cell"]).where(once & (F.col("_c") != F.col("_d"))).select(cloud, F.least("_c", "_d").alias("a"), F.greatest("_c", "_d").alias("b"), length, "_r")
    return pairs.where(F.col("w") <= F.col("_r")).drop("_r")


# Positions of a cloud whose tree is spanned at once; larger ones go through radii and forests.
SMALL_CLOUD = 64
FAR = np.finfo(float).max


def _tree_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths of the minimum spanning trees of whole small clouds (cloud, flat coordinates, n), by Prim's rule for all clouds of a size at once."""
    for batch in batches:
        clouds, sizes, flat = batch.column(0), batch.column(2).to_numpy(), batch.column(1)
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            x = flat.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n, -1)
            at, every = np.zeros(len(rows), np.int64), np.arange(len(rows))
            open_, near = np.ones((len(rows), n), bool), np.full((len(rows), n), FAR)
            lengths = []
            for _ in range(n - 1):
                open_[every, at] = False
                gap = x - x[every, at][:, None]
                square = gap[:, :, 0] * gap[:, :, 0]
                for i in range(1, x.shape[2]):
                    square = square + gap[:, :, i] * gap[:, :, i]
                # A position without a number stays apart.
                near = np.fmin(near, np.sqrt(square))
                left = np.where(open_, near, np.inf)
                at = left.argmin(1)
                lengths.append(left[every, at])
            names = clouds.take(pa.array(np.repeat(rows, n - 1)))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.stack(lengths, 1).ravel())], ["_cloud", "w"])


def bar_lengths(points: DataFrame, cloud: str, coords: list[str], reach: float = CURVE_REACH) -> tuple[DataFrame, DataFrame]:
    """((cloud, length) of the bars of dimension 0 that end within ``reach``, (cloud, n) positions of each cloud).

    The bars' lengths are those of the minimum spanning tree. Trees of up to ``SMALL_CLOUD`` positions are spanned at once, many
    clouds a task. Edges of larger ones are found by length: pairs within a radius that follows from the cloud's density, then within a
    ``GROWTH`` times larger one among what is still apart.
    """
    name, cloud = cloud, "_cloud"
    distinct = points.select(F.col(name).alias(cloud), *[F.col(c).cast("double").alias(c) for c in coords]).distinct()
    positions = cut_lineage(distinct.withColumn("pid", F.monotonically_increasing_id()))
    extent = F.greatest(*[F.max(c) - F.min(c) for c in coords]) if len(coords) > 1 else F.max(coords[0]) - F.min(coords[0])
    sizes = cut_lineage(positions.groupBy(cloud).agg(F.count(F.lit(1)).alias("n"), extent.alias("_extent")))
    start = F.least(F.lit(reach), 2 * F.col("_extent") / F.pow("n", F.lit(1 / len(coords))))
    lists = positions.join(sizes.where(F.col("n").between(2, SMALL_CLOUD)).select(cloud, "n"), cloud).groupBy(cloud, "n")
    lists = lists.agg(F.flatten(F.collect_list(F.array(*coords))).alias("_x")).select(cloud, "_x", F.col("n").cast("int").alias("n"))
    fields = [StructField(cloud, positions.schema[cloud].dataType), *StructType.fromDDL("w double").fields]
    small = lists.mapInArrow(_tree_lengths, StructType(fields)).where(F.col("w") <= reach)
    if not sizes.where(F.col("n") > SMALL_CLOUD).limit(1).count():
        return small.select(F.col(cloud).alias(name), F.col("w").alias("length")), sizes.select(F.col(cloud).alias(name), "n")
    state = cut_lineage(positions.join(sizes.where(F.col("n") > SMALL_CLOUD).select(cloud, start.alias("_r")), cloud).withColumn("comp", F.col("pid")))
    bars = small
    while True:
        made = _forest(_between(state, cloud, coords), cloud)
        if made is not None:
            lengths, roots = made
            bars = bars.unionByName(lengths)
            state = _relabelled(state, "comp", roots)
        apart = state.groupBy(cloud).agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.first("_r").alias("_was"))
        apart = apart.where((F.col("_lo") != F.col("_hi")) & (F.col("_was") < reach))
        apart = cut_lineage(apart.select(cloud, F.least(F.lit(reach), F.col("_was") * GROWTH).alias("_r")))
        if apart.isEmpty():
            return bars.select(F.col(cloud).alias(name), F.col("w").alias("length")), sizes.select(F.col(cloud).alias(name), "n")
        state = cut_lineage(state.drop("_r").join(apart, cloud))


def component_curves(points: DataFrame, cloud: str, coords: list[str], bins: int = CURVE_POINTS, reach: float = CURVE_REACH) -> DataFrame:
    """Per cloud the number of connected components when points up to each threshold are joined, and the entropy of the bars.

    Thresholds run evenly from 0 to ``reach``. Entropy is that of the lengths' shares, in bits; a bar that outlives
    ``reach`` counts as that long, and the one that never ends is left out. A cloud of one position has entropy 0.
    """
    step = reach / (bins - 1)
    lengths, sizes = (df.withColumnRenamed(cloud, "_cloud") for df in bar_lengths(points, cloud, coords, reach))
    length = F.col("length")
    per = lengths.groupBy("_cloud", F.ceil(length / F.lit(step)).cast("int").alias("_bin")).agg(
        F.count(F.lit(1)).alias("_m"), F.sum(length).alias("_s"), F.sum(length * F.log2(length)).alias("_logs")
    )
    ended = F.map_from_entries(F.collect_list(F.struct("_bin", "_m"))).alias("_ended")
    every = per.groupBy("_cloud").agg(F.sum("_m").alias("_all"), F.sum("_s").alias("_sum"), F.sum("_logs").alias("_logs"), ended)
    met = sizes.join(every, "_cloud", "left")
    left = F.col("n") - 1 - F.coalesce("_all", F.lit(0))
    total = F.coalesce("_sum", F.lit(0.0)) + left * reach
    logs = F.coalesce("_logs", F.lit(0.0)) + left * (reach * math.log2(reach))
    entropy = F.when(total > 0, F.greatest(F.log2(total) - logs / total, F.lit(0.0))).otherwise(0.0)
    gone = F.aggregate(F.sequence(F.lit(0), F.col("bin")), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.try_element_at("_ended", i), F.lit(0)))
    out = met.select("_cloud", "n", "_ended", entropy.alias("entropy"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    components = F.col("n") - F.when(F.col("_ended").isNull(), 0).otherwise(gone)
    return out.select(F.col("_cloud").alias(cloud), "bin", (F.col("bin") * F.lit(step)).alias("threshold"), components.alias("components"), "entropy")


def projected(df: DataFrame, key: str, vector: str, rounds: int = 200) -> DataFrame:
    """Each vector on the two principal axes (x, y); one pass gives the covariance, one the projection.

    Axes come from the covariance matrix by block power iteration; an axis points to where its largest element is positive.
    """
    width = df.select(F.max(F.size(vector))).first()[0] or 0
    sums = cloud_covariance(df.select(F.lit(0).alias("_all"), F.col(vector).cast("array<double>").alias("_v")), "_all", "_v", width)
    # One number per element of the matrix.
    total = np.zeros(1 + width + width * width)
    for r in sums.select("pos", "total").collect():
        total[r["pos"]] = r["total"]
    axes = principal_axes(total, width, 2, rounds)
    point = F.col(vector).cast("array<double>")
    along = [F.aggregate(F.zip_with(point, F.lit(axis), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for axis in axes.tolist()]
    return df.select(key, along[0].alias("x"), along[1].alias("y"))


def principal_axes(total: np.ndarray, width: int, count: int, rounds: int) -> np.ndarray:
    """Leading eigenvectors of the covariance of summed (rows, vectors, outer products), by block power iteration."""
    n = max(total[0], 1)
    mean = total[1 : width + 1] / n
    covariance = total[width + 1 :].reshape(width, width) / n - np.outer(mean, mean)
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(width, min(width, count + 6))))[0]
    for _ in range(rounds):
        moved = np.linalg.qr(covariance @ block)[0]
        done = np.allclose(np.abs((moved * block).sum(0)[:count]), 1, atol=1e-15)
        block = moved
        if done:
            break
    # Inside the block the axes follow exactly.
    values, turn = np.linalg.eigh(block.T @ covariance @ block)
    axes = (block @ turn[:, np.argsort(values)[::-1]]).T[:count]
    axes = np.vstack([axes, np.zeros((count - len(axes), width))]) if len(axes) < count else axes
    return axes * np.sign(np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1)) if width else axes


