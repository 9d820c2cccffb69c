"""Merkle manifest of a dataset by a tree of SHA-256 midstates.

Rows are leaves; per group (source) leaves stand in the order of their key, and every three consecutive nodes become one parent
until one node, the subroot, remains. Subroots, in the order of their groups, become the root likewise. A parent retains a copy
of its hash state before each child slot. To fold a replaced child, the state before its slot is resumed with the replacement
and the siblings to the right of it; siblings to the left are not hashed again. Proofs are running states as well, so a leaf
carries 32 bytes from tier to tier, not its list of siblings.

A tier folds ``LEVELS`` levels: blocks of 3 ** LEVELS consecutive nodes, some blocks a task, so a group of any size is spread and
a tree of n leaves takes log(n) / log(3 ** LEVELS) tiers. Leaves meet the path of their block, not the rest of the tree.

Defined results: NULL fields count as ``-``, a NULL group is one group before all others; leaves of equal keys stand in the order
of their digests, NULL keys first; equal rows are leaves of their own; one leaf alone is its subroot and one subroot alone the root, with the
proof of no siblings; a NULL ``changed`` digest means an untouched row, whose leaf is folded; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import range_buckets
from ..session import cut_lineage
from .sha256 import compress, finish, fresh, hex_block, resume, to_bytes, to_words
from .text import keyed

FANOUT, LEVELS = 3, 6
BLOCK = FANOUT**LEVELS
# Rows of one task's group of blocks, about.
BASKET = 4096
# One level of a path: slot, siblings and self, state before the slot, siblings from left to right (two places).
STEP = 2 + 32 + 64


def hashed_fields(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, each ``-`` if NULL, else its UTF-8 length, ``:`` and its text."""
    text = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (grp, ...) with idx, the position from 0 in the group, and n, the group's rows."""
    dealt = range_buckets(rows, ["grp", *order])
    totals = dealt.groupBy("grp", "_bucket").agg(F.count(F.lit(1)).alias("_m"))
    upto = Window.partitionBy("grp").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = totals.select("grp", "_bucket", (F.sum("_m").over(upto) - F.col("_m")).alias("_start"), F.sum("_m").over(Window.partitionBy("grp")).alias("n"))
    inside = Window.partitionBy("grp", "_bucket").orderBy(*order)
    ranked = dealt.withColumn("idx", F.row_number().over(inside) - 1).join(starts, ["grp", "_bucket"])
    return ranked.withColumn("idx", F.col("idx") + F.col("_start")).drop("_bucket", "_start")


def _depth(n: np.ndarray) -> np.ndarray:
    """Levels from n nodes to one."""
    out, left = np.zeros(len(n), np.int64), n.copy()
    while (left > 1).any():
        out += left > 1
        left = -(-left // FANOUT)
    return out


class _Level:
    """The runs of one level's nodes, and the states that their parents retain."""

    def __init__(self, digests: np.ndarray, block: np.ndarray, pos: np.ndarray, active: np.ndarray):
        n = len(pos)
        fresh_run = np.ones(n, bool)
        fresh_run[1:] = (block[1:] != block[:-1]) | (pos[1:] // FANOUT != pos[:-1] // FANOUT) | ~active[1:]
        self.begin = np.flatnonzero(fresh_run)
        self.parent = np.cumsum(fresh_run) - 1
        self.count = np.diff(np.append(self.begin, n))
        self.slot = np.arange(n) - self.begin[self.parent]
        self.active = active
        self.digests = digests
        state = fresh(len(self.begin))
        self.before = []
        for k in range(FANOUT):
            self.before.append(state)
            on = self.count > k
            state = resume(state, digests[:, self.begin[on] + k], on)
        made = finish(state, self.count)
        self.above = np.where(active[self.begin], made, digests[:, self.begin])

    def siblings(self, node: np.ndarray):
        """For each place of a run: which of the nodes have a sibling there, and its digests."""
        parent = self.parent[node]
        for k in range(FANOUT):
            on = self.active[node] & (self.slot[node] != k) & (self.count[parent] > k)
            yield k, on, self.digests[:, self.begin[parent[on]] + k]

    def refold(self, node: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The parents' digests if the nodes had these values: the state before the slot, the value, the right siblings."""
        parent, slot = self.parent[node], self.slot[node]
        state = np.stack(self.before)[slot, :, parent].T
        state = compress(state, hex_block(value)) if len(node) else state
        for k, on, digests in self.siblings(node):
            right = on & (k > slot)
            state = resume(state, digests[:, right[on]], right)
        return np.where(self.active[node], finish(state, self.count[parent]), value)

    def steps(self, node: np.ndarray) -> np.ndarray:
        """The level as bytes of a path, one row per node."""
        parent, slot = self.parent[node], self.slot[node]
        out = np.zeros((len(node), STEP), np.uint8)
        out[:, 0], out[:, 1] = slot, self.count[parent]
        out[:, 2:34] = _rows(np.stack(self.before)[slot, :, parent].T)
        for k, on, digests in self.siblings(node):
            place = np.flatnonzero(on)
            later = (k > slot[on]).astype(np.int64)
            for part in (0, 1):
                here = (k - later) == part
                out[place[here], 34 + 32 * part : 66 + 32 * part] = _rows(digests[:, here])
        return out


def _rows(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(words.T).astype(">u4").view(np.uint8).reshape(-1, 32)


def _levels(table: pa.Table):
    """(depth in this tier, block, level after level) of a sorted table of whole blocks."""
    code = table.column("grp").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    idx, n = table.column("idx").to_numpy(), table.column("n").to_numpy()
    cut = np.ones(len(idx), bool)
    cut[1:] = (code[1:] != code[:-1]) | (idx[1:] // BLOCK != idx[:-1] // BLOCK)
    block = np.cumsum(cut) - 1
    depth = np.minimum(_depth(n), LEVELS)
    digests, pos, at = to_words(table.column("digest").to_pylist()), idx.copy(), depth
    for level in range(int(depth.max(initial=0))):
        here = _Level(digests, block, pos, at > level)
        yield here
        digests, block, pos, at = here.above, block[here.begin], np.where(at > level, pos // FANOUT, pos)[here.begin], at[here.begin]


def _sorted(table: pa.Table) -> pa.Table:
    return table.combine_chunks().sort_by([("grp", "ascending"), ("idx", "ascending")])


def _prove(table: pa.Table) -> pa.Table:
    """Leaves to their block's node: the running proof, the leaf as found folded, the node itself."""
    table = _sorted(table)
    m = table.num_rows
    at, proof, parts = np.arange(m), fresh(m), np.zeros(m, np.int64)
    # The nodes on the leaves' paths as the found leaves make them; no node's own digest is taken for one.
    value = to_words(table.column("changed").to_pylist())
    top = to_words(table.column("digest").to_pylist())
    for level in _levels(table):
        value = level.refold(at, value)
        for _, on, digests in level.siblings(at):
            proof = resume(proof, digests, on)
            parts += on
        at, top = level.parent[at], level.above
    columns = {c: table.column(c) for c in ("key", "grp", "idx", "n", "digest")}
    columns["idx"] = pa.array(table.column("idx").to_numpy() // BLOCK)
    columns["n"] = pa.array(-(-table.column("n").to_numpy() // BLOCK))
    columns |= {"top": pa.array(to_bytes(top[:, at]), pa.binary()), "folded": pa.array(to_bytes(value), pa.binary())}
    return pa.table(columns | {"proof": pa.array(to_bytes(proof), pa.binary()), "parts": pa.array(parts)})


def _path(table: pa.Table) -> pa.Table:
    """Nodes to the node of their block: the steps of their path, and that node."""
    table = _sorted(table)
    at, top = np.arange(table.num_rows), to_words(table.column("digest").to_pylist())
    steps: list[bytes] = [b""] * table.num_rows
    for level in _levels(table):
        made = level.steps(at)
        for i in np.flatnonzero(level.active[at]):
            steps[i] += made[i].tobytes()
        at, top = level.parent[at], level.above
    columns = {"grp": table.column("grp"), "idx": table.column("idx"), "steps": pa.array(steps, pa.binary())}
    columns |= {"block": pa.array(table.column("idx").to_numpy() // BLOCK), "m": pa.array(-(-table.column("n").to_numpy() // BLOCK))}
    return pa.table(columns | {"top": pa.array(to_bytes(top[:, at]), pa.binary())})


def _in_blocks(nodes: DataFrame, run, schema: str, total: int) -> DataFrame:
    baskets = max(1, -(-total // BASKET))
    basket = F.pmod(F.xxhash64("grp", F.floor(F.col("idx") / BLOCK)), F.lit(baskets))
    return cut_lineage(nodes.withColumn("basket", basket).groupBy("basket").applyInArrow(run, schema))


def _climb(nodes: DataFrame) -> DataFrame:
    """(grp, idx, steps, root) of nodes (grp, idx, n, digest): the whole path to the last node of the group."""
    size = nodes.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("most")).first()
    made = _in_blocks(nodes, _path, "grp string, idx long, steps binary, block long, m long, top binary", size["rows"])
    if (size["most"] or 0) <= BLOCK:
        return made.select("grp", "idx", "steps", F.col("top").alias("root"))
    heads = made.groupBy("grp", F.col("block").alias("idx")).agg(F.max("m").alias("n"), F.max("top").alias("digest"))
    above = _climb(heads).select("grp", F.col("idx").alias("block"), F.col("steps").alias("_more"), "root")
    return made.join(above, ["grp", "block"]).select("grp", "idx", F.concat("steps", "_more").alias("steps"), "root")


def _finish(batches):
    """Leaves along the path of their block to the root."""
    for batch in batches:
        m = batch.num_rows
        steps = batch.column("steps").to_pylist()
        depth = np.array([len(s) // STEP for s in steps], np.int64)
        path = np.zeros((m, int(depth.max(initial=0)) * STEP), np.uint8)
        for i, s in enumerate(steps):
            path[i, : len(s)] = np.frombuffer(s, np.uint8)
        proof, parts = to_words(batch.column("proof").to_pylist()), batch.column("parts").to_numpy().copy()
        value = to_words(batch.column("folded").to_pylist())
        for level in range(int(depth.max(initial=0))):
            step = path[:, level * STEP : (level + 1) * STEP]
            slot, count = step[:, 0].astype(np.int64), step[:, 1].astype(np.int64)
            words = [np.ascontiguousarray(step[:, a : a + 32]).view(">u4").T.astype(np.uint32) for a in (2, 34, 66)]
            for part in (0, 1):
                on = (depth > level) & (count > part + 1)
                proof = resume(proof, words[1 + part][:, on], on)
                parts += on
            state = compress(words[0], hex_block(value)) if m else words[0]
            for part in (0, 1):
                on = (count > part + 1) & (slot <= part)
                state = resume(state, words[1 + part][:, on], on)
            value = np.where(depth > level, finish(state, count), value)
        done = {"proof": pa.array(to_bytes(finish(proof, parts)), pa.binary()), "folded": pa.array(to_bytes(value), pa.binary())}
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("key", "digest", "subroot", "root")} | done)


def dataset_manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", leaf: Column | None = None, changed: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: key, leaf, subroot, root, proof_sha256, folded_root (lowercase hex), verified boolean.

    ``leaf``: the hex digest of a row; ``changed``: that of the row as it is found later (NULL: untouched, the leaf itself). Every
    row's digest is folded along the retained states, an untouched one's too; ``verified`` tells whether the root came out.
    """
    leaf = hashed_fields(*[F.col(f"`{c}`") for c in docs.columns]) if leaf is None else leaf
    changed = F.lit(None).cast("string") if changed is None else changed
    grp = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n"))
    rows = docs.select(F.col(key).alias("key"), grp.alias("grp"), leaf.alias("_l"), changed.alias("_c"))
    found = F.unhex(F.coalesce("_c", "_l"))
    rows = rows.select("key", "grp", F.unhex("_l").alias("digest"), found.alias("changed"), F.monotonically_increasing_id().alias("uid"))
    leaves = _numbered(cut_lineage(rows), ["key", "digest", "uid"])
    kind = docs.schema[key].dataType
    total = docs.count()
    schema = keyed("grp string, idx long, n long, digest binary, top binary, folded binary, proof binary, parts long", key=kind)
    proved = _in_blocks(leaves.select("key", "grp", "idx", "n", "digest", "changed"), _prove, schema, total)
    heads = proved.groupBy("grp", "idx").agg(F.max("n").alias("n"), F.max("top").alias("digest"))
    inner = cut_lineage(_climb(cut_lineage(heads)).withColumnRenamed("root", "subroot"))
    subroots = inner.groupBy("grp").agg(F.max("subroot").alias("digest"))
    tops = _numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"])
    tops = cut_lineage(tops)
    upper = tops.select("idx", "name").join(_climb(tops.select("grp", "idx", "n", "digest")).drop("grp"), "idx")
    upper = upper.select(F.col("name").alias("grp"), F.col("steps").alias("_more"), "root")
    paths = inner.join(upper, "grp").select("grp", "idx", F.concat("steps", "_more").alias("steps"), "subroot", "root")
    met = proved.join(paths, ["grp", "idx"]).select("key", "digest", "subroot", "root", "steps", "folded", "proof", "parts")
    done = met.mapInArrow(_finish, keyed("digest binary, subroot binary, root binary, proof binary, folded binary", key=kind))
    names = {"digest": "leaf", "subroot": "subroot", "root": "root", "proof": "proof_sha256", "folded": "folded_root"}
    shown = [F.lower(F.hex(c)).alias(out) for c, out in names.items()]
    return done.select("key", *shown, (F.col("folded") == F.col("root")).alias("verified"))
