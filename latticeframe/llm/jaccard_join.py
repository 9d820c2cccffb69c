"""Near duplicates by Jaccard similarity of word shingles, with Bayesian candidate pruning.

Texts of equal words form one class first. Classes that share a band of their MinHash signature are candidates; candidates
that hang together form a group, and large groups are cut into blocks that meet pairwise. Inside a pair of blocks signatures
are compared step by step: a pair goes when, by the matches seen so far and a uniform prior, the probability that its
similarity reaches the threshold is below the tolerance. What is left is verified on the whole shingle sets. No table of
pairs is made: each block pair yields per class the number of its partners and one link into its local component.

A pair at the threshold shares no band with probability (1 - threshold ** BAND) ** BANDS, below 1e-7 for 0.8.

Defined results: words lie between white space and count without case in A-Z; a text of fewer words than a shingle is one
shingle; NULL and empty texts are one class (no words); repeated rows and equal texts are in one class; NULL identifiers are the
last choice for a name; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clustering import components_by_key, connected_components
from ..session import cut_lineage
from .exact_dedup import addressed, located, readdressed, without
from .text import broadcast_if_small, frugal, hashes, keyed, release, slices, small_batches, token_codes

HASHES, BAND = 128, 4
BANDS = HASHES // BAND
STEPS = (16, 32, 48, 64, 96, 128)
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
_random = np.random.default_rng(1)
FACTORS = _random.integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
SHIFTS = _random.integers(0, 2**32, HASHES, dtype=np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles text after text, where each text begins (n + 1 places), and the word hashes' row ends."""
    codes, rows, words = token_codes(texts)
    word = hashes(words)[codes]
    n = len(texts)
    per = np.bincount(rows, minlength=n)
    ends = np.cumsum(per)
    count = np.where(per >= width, per - width + 1, np.minimum(per, 1))
    first = np.repeat(ends - per, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(np.repeat(per, count), width)
    out = np.zeros(len(first), np.uint64)
    for k in range(width):
        on = length > k
        at = np.minimum(first + k, max(len(word) - 1, 0))
        out = np.where(on, (out ^ word[at]) * MIX + np.uint64(k + 1) if len(word) else out, out)
        out ^= out >> np.uint64(29)
    return out, np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], ends]), word


def signatures(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """MinHash signatures (16 bits each) of the sets between the places ``begin``; all ones for an empty set."""
    n = len(begin) - 1
    out = np.full((n, HASHES), 0xFFFF, np.uint16)
    full = np.flatnonzero(begin[1:] > begin[:-1])
    if len(full):
        low = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
        for k in range(HASHES):
            mixed = low * FACTORS[k] + SHIFTS[k]
            out[full, k] = (np.minimum.reduceat(mixed, begin[full]) >> np.uint32(8)).astype(np.uint16)
    return out


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, begin, ends, word = shingles(part.column("text"), width)
                signed = signatures(values, begin)
                digest = [xxhash.xxh3_128_digest(word[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
                columns = [part.column(c) for c in ("id", "file", "row")]
                columns += [pa.array(digest, pa.binary()), pa.array([s.tobytes() for s in signed], pa.binary())]
                columns.append(pa.array(pc.fill_null(pc.binary_length(part.column("text")), 0)).cast(pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "file", "row", "digest", "sig", "bytes"])

    return run


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """By hashes compared, the fewest matches that leave P(similarity >= threshold) at the tolerance or above.

    With a uniform prior the posterior is a beta distribution; its upper tail is a binomial sum.
    """
    out = {}
    for n in STEPS:
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def surviving_pairs(sig_a, sig_b, same: bool, need: dict[int, int], fits=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of the pairs of two blocks that no step drops, piece by piece; within one block each pair once."""
    first = STEPS[0]
    for lo in range(0, len(sig_a), 64):
        chunk = sig_a[lo : lo + 64]
        matches = (chunk[:, None, :first] == sig_b[None, :, :first]).sum(-1)
        on = matches >= need[first]
        a, b = np.nonzero(on if fits is None else on & fits(lo, lo + 64))
        if same:
            up = b > a + lo
            a, b = a[up], b[up]
        seen = matches[a, b]
        for start, stop in zip(STEPS, STEPS[1:]):
            seen = seen + (chunk[a, start:stop] == sig_b[b, start:stop]).sum(-1)
            on = seen >= need[stop]
            a, b, seen = a[on], b[on], seen[on]
        yield a + lo, b


def linked_pairs(sig_a, sig_b, sets_a, sets_b, same: bool, threshold: float, need: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of all pairs of the two blocks at ``threshold`` or above; within one block each pair once."""
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def fits(lo: int, hi: int) -> np.ndarray:
        """No pair whose sizes differ too much can reach the threshold."""
        return np.minimum.outer(size_a[lo:hi], size_b) >= threshold * np.maximum.outer(size_a[lo:hi], size_b)

    for a, b in surviving_pairs(sig_a, sig_b, same, need, fits):
        for x in np.unique(a):
            partners = b[a == x]
            own = sets_a[x]
            if not len(own):
                continue
            for i in range(0, len(partners), 256):
                some = partners[i : i + 256]
                joined = np.concatenate([sets_b[y] for y in some])
                begin = np.concatenate([[0], np.cumsum(size_b[some])[:-1]])
                at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
                both = np.add.reduceat((own[at] == joined).astype(np.int64), begin)
                on = both >= threshold * (len(own) + size_b[some] - both) - 1e-9
                out_a.append(np.full(on.sum(), x))
                out_b.append(some[on])
    return np.concatenate(out_a), np.concatenate(out_b)


def _local_roots(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each node the smallest node it hangs together with by the links (a, b)."""
    root = nodes.copy()
    while len(a):
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        if (root == before).all():
            break
    return root


def _compare(width: int, threshold: float, tolerance: float):
    need = least_matches(threshold, tolerance)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("comp", "ascending"), ("i", "ascending"), ("j", "ascending")])
        values, begin, _, _ = shingles(pa.concat_arrays(table.column("text").chunks) if table.num_rows else pa.array([], pa.string()), width)
        sets = [np.unique(values[a:b]) for a, b in zip(begin, begin[1:])]
        column = {c: table.column(c).to_numpy() for c in ("comp", "i", "j", "slot", "node", "n")}
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        keys = np.stack([column["comp"], column["i"], column["j"]])
        cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0), [True]]))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in zip(cuts, cuts[1:]):
            i, j, slot = column["i"][lo], column["j"][lo], column["slot"][lo:hi]
            here = np.arange(lo, hi)
            left, right = here[slot == i], here[slot == j]
            a, b = linked_pairs(sig[left], sig[right], [sets[x] for x in left], [sets[x] for x in right], i == j, threshold, need)
            if not len(a):
                continue
            a, b = left[a] - lo, right[b] - lo
            nodes, n = column["node"][lo:hi], column["n"][lo:hi]
            links = np.bincount(a, n[b], minlength=hi - lo) + np.bincount(b, n[a], minlength=hi - lo)
            on = links > 0
            found.append((nodes[on], links[on].astype(np.int64), _local_roots(nodes, a, b)[on]))
        parts = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [()] * 3)]
        del sets, values, sig, table
        release()
        return pa.table({"node": pa.array(parts[0], pa.int64()), "links": pa.array(parts[1], pa.int64()), "root": pa.array(parts[2], pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 5, tolerance: float = 1e-6,
    rows: DataFrame | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, file, row (its locator), class_id, class_size, n_links, group_id, stays.

    class_id: the smallest identifier among the texts of the same words; n_links long: the other rows at the threshold or
    above, copies included; group_id: the smallest identifier that is reached by links; stays: true on one row of each group.
    """
    rows = located(docs, key, text) if rows is None else rows
    small_batches(docs.sparkSession)
    schema = keyed("file string, row long, digest binary, sig binary, bytes long", id=docs.schema[key].dataType)
    signed = rows.mapInArrow(frugal(_sign(width)), schema)
    signed = cut_lineage(signed)
    name = F.struct(F.col("id").isNull().alias("no"), "id", "file", "row", "sig", "bytes")
    classes = signed.groupBy("digest").agg(F.min(name).alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = cut_lineage(classes.select("digest", "rep.id", "rep.file", "rep.row", "rep.sig", "rep.bytes", "n", F.monotonically_increasing_id().alias("node")))
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.col("sig").substr(b * (2 * BAND) + 1, F.lit(2 * BAND)))))
    bands = classes.select("node", band.alias("key"))
    heads = bands.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    groups = cut_lineage(components_by_key(bands.join(cut_lineage(heads), "key")))
    groups = _refined(classes, groups, threshold, tolerance)
    linked = _verified(rows, classes, groups, width, threshold, tolerance)
    per = linked.groupBy("node").agg(F.sum("links").alias("links"))
    touching = linked.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")).distinct()
    final = connected_components(per.select("node"), touching)
    whole = classes.join(per, "node", "left").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "node")).alias("first")
    named = whole.groupBy("component").agg(first).select("component", F.col("first.id").alias("group_id"), F.col("first.node").alias("best"))
    whole = cut_lineage(whole.join(named, "component").select(
        "digest", F.col("id").alias("class_id"), F.col("n").alias("class_size"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        "group_id", F.when(F.col("best") == F.col("node"), F.struct("file", "row")).alias("place"),
    ))
    met = signed.select("id", "file", "row", "digest").join(whole, "digest")
    stays = F.coalesce((F.col("place.file") == F.col("file")) & (F.col("place.row") == F.col("row")), F.lit(False))
    return met.select("id", "file", "row", "class_id", "class_size", "n_links", "group_id", stays.alias("stays"))


def _survivors(threshold: float, tolerance: float):
    """Per block pair of one band, each class with the smallest one that it hangs together with by surviving pairs."""
    need = least_matches(threshold, tolerance)

    def run(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_numpy() for c in ("node", "slot", "i", "j", "band")}
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        i, j, band = column["i"][0], column["j"][0], column["band"][0]
        left, right = np.flatnonzero(column["slot"] == i), np.flatnonzero(column["slot"] == j)
        ends_a, ends_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in surviving_pairs(sig[left], sig[right], i == j, need):
            a, b = left[a], right[b]
            # The first band that a pair shares is the one that counts it.
            shared = (sig[a].reshape(-1, BANDS, BAND) == sig[b].reshape(-1, BANDS, BAND)).all(-1)
            on = shared.argmax(1) == band
            ends_a.append(a[on])
            ends_b.append(b[on])
        roots = _local_roots(column["node"], np.concatenate(ends_a), np.concatenate(ends_b))
        on = roots != column["node"]
        return pa.table({"src": pa.array(column["node"][on], pa.int64()), "dst": pa.array(roots[on], pa.int64())})

    return run


def _refined(classes: DataFrame, groups: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Groups of more than a block cut down to what hangs together by pairs that outlive the comparison of signatures.

    A common passage can chain a large part of a corpus. Only classes of one band meet here, by their signatures alone;
    a group of one block is compared whole later on.
    """
    size = groups.groupBy("component").agg(F.count(F.lit(1)).alias("rows"))
    large = cut_lineage(size.where(F.col("rows") > BLOCK_ROWS).select("component"))
    if large.isEmpty():
        return groups
    inside = groups.join(large, "component", "left_semi").select("node")
    sig = classes.join(inside, "node").select("node", "sig")
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.col("sig").substr(b * (2 * BAND) + 1, F.lit(2 * BAND))))).alias("band", "key")
    bands = cut_lineage(sig.select("node", band))
    full = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    full = cut_lineage(full.withColumn("k", F.ceil(F.col("m") / BLOCK_ROWS).cast("long")).drop("m"))
    placed = bands.join(full, ["band", "key"]).withColumn("slot", F.pmod(F.xxhash64("node"), F.col("k")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    placed = placed.select("node", "band", "key", "slot", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"))
    held = cut_lineage(placed).join(sig, "node")
    found = cut_lineage(held.groupBy("band", "key", "i", "j").applyInArrow(_survivors(threshold, tolerance), "src long, dst long").distinct())
    cut = connected_components(inside, found)
    return cut_lineage(groups.join(large, "component", "left_anti").select("node", "component").unionByName(cut.select("node", "component")))


def _verified(rows: DataFrame, classes: DataFrame, groups: DataFrame, width: int, threshold: float, tolerance: float) -> DataFrame:
    """(node, links, root) of every block pair, written."""
    active = cut_lineage(classes.join(groups, "node").select("node", "component", "file", "row", "sig", "bytes", "n"))
    size = active.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("sum"))
    blocks = F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("sum") / BLOCK_BYTES)).cast("long").alias("k")
    size = size.select("component", blocks)
    total = active.agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    # Small groups share tasks: so many baskets that each holds about one block.
    baskets = max(1, -(-(total["b"] or 0) // BLOCK_BYTES), -(-total["n"] // BLOCK_ROWS))
    placed = active.join(size, "component").withColumn("slot", F.pmod(F.xxhash64("node"), F.col("k")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    placed = placed.withColumn("i", F.least("slot", "other")).withColumn("j", F.greatest("slot", "other"))
    basket = F.when(F.col("k") == 1, F.pmod(F.xxhash64("component"), F.lit(baskets))).otherwise(F.xxhash64("component", "i", "j"))
    plan = placed.select("node", F.col("component").alias("comp"), "slot", "i", "j", "n", "sig", "file", "row", basket.alias("basket"))
    texts = rows.select("file", "row", "text").join(broadcast_if_small(active.select("node", "file", "row"), total["n"]), ["file", "row"]).select("node", "text")
    held = plan.drop("file", "row").join(texts, "node")
    pairs = held.groupBy("basket").applyInArrow(_compare(width, threshold, tolerance), "node long, links long, root long")
    return cut_lineage(pairs)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the one with the smallest identifier; columns as given."""
    rows = addressed(docs)
    groups = near_duplicates(docs, key, text, rows=readdressed(rows, docs.columns, key, text), **options)
    return without(rows, groups.where(~F.col("stays")), docs.columns)
