"""Removal of repeated passages by suffix automata of reference shards.

A window is ``width`` consecutive words; a word goes when it lies in a window whose words also start in a document of smaller
identifier. Documents of the same words are settled first, as a class with its smallest identifier. All else is about windows of
class representatives that may occur twice. Each window belongs to its anchor, the least hash among its runs of ``ANCHOR`` words, so
equal windows have equal anchors; consecutive windows of one anchor form a segment. Anchors of one document only are left out.
Segments of equal words have one content, which only its smallest identifier need look up.

Contents that share an anchor with other contents are the reference. They are dealt into shards by anchor; an anchor with more than
``CROWD`` contents is cut into single windows that are dealt by their words. In a shard contents come by ascending identifier: each
one is streamed over the suffix automaton of all smaller ones, whose matching statistics tell the longest match that ends
at each word, and then joins it. Where the statistic reaches ``width``, the window is a repeat; maximal spans of them are removed.

No word is compared by hash alone where contents differ; two contents are taken for equal by 128 bits (anchor and content hash).
Shards hold ``SHARD_ROWS`` contents, about, however large the corpus is. Equal contents are counted before they are shuffled.

Defined results: NULL text counts as empty; fewer words than a window are never removed; repeats inside one document stay;
rows of one identifier don't remove each other's words; a NULL identifier is larger than all others; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .exact_dedup import LOCATOR, addressed, located, readdressed
from .text import filled, frugal, hashes, keyed, slices, small_batches

ANCHOR = 7
CROWD = 4096
SHARD_ROWS = 4096
BROADCAST_VALUES = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of each text, unchanged."""
    parts = pc.ascii_split_whitespace(filled(texts))
    tokens = parts.flatten()
    full = pc.greater(pc.binary_length(tokens), 0).to_numpy(zero_copy_only=False)
    if full.all():
        return parts
    per = np.add.reduceat(np.append(full, False).astype(np.int64), np.minimum(parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py(), len(full))) if len(parts) else np.zeros(0, np.int64)
    per = np.where(pc.list_value_length(parts).to_numpy() > 0, per, 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), tokens.filter(pa.array(full)))


class _Words:
    """Words of many texts in one array, with the segments that their windows form."""

    def __init__(self, texts: pa.Array, width: int):
        self.lists = words_of(texts)
        self.ends = self.lists.offsets.to_numpy().astype(np.int64)
        self.ends = self.ends - self.ends[0]
        coded = self.lists.flatten().dictionary_encode()
        self.hash = hashes(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
        self.per = np.diff(self.ends)
        self.width = width

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment: anchor hash, text, first window (place among all words), number of windows."""
        n = len(self.hash) - self.width + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return np.zeros(0, np.uint64), none, none, none
        runs = len(self.hash) - ANCHOR + 1
        gram = np.zeros(runs, np.uint64)
        for t in range(ANCHOR):
            gram = (gram ^ self.hash[t : t + runs]) * MIX
            gram ^= gram >> np.uint64(32)
        least, at = gram[:n].copy(), np.zeros(n, np.int64)
        for t in range(1, self.width - ANCHOR + 1):
            less = gram[t : t + n] < least
            least[less] = gram[t : t + n][less]
            at[less] = t
        at += np.arange(n)
        text = np.repeat(np.arange(len(self.per)), self.per)
        inside = np.flatnonzero(text[:n] == text[self.width - 1 :])
        if not len(inside):
            return np.zeros(0, np.uint64), none, none, none
        new = np.ones(len(inside), bool)
        new[1:] = (at[inside][1:] != at[inside][:-1]) | (text[inside][1:] != text[inside][:-1])
        begin = np.flatnonzero(new)
        first = inside[begin]
        return least[first], text[first], first, np.diff(np.append(begin, len(inside)))

    def content(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Hashes of the words of segments."""
        out, long = np.zeros(len(first), np.uint64), count + self.width - 1
        for t in range(int(long.max(initial=0))):
            on = np.flatnonzero(long > t)
            mixed = (out[on] ^ self.hash[first[on] + t]) * MIX + np.uint64(t + 1)
            out[on] = mixed ^ (mixed >> np.uint64(29))
        return out


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _survey(width: int):
    """Each text's number of words, the digest of its words, and the anchors of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = _Words(part.column("text"), width)
                plain = pc.binary_join(words.lists, " ").to_pylist()
                digest = [hashlib.sha256(p.encode()).digest() for p in plain]
                anchor, text, _, _ = words.segments()
                order = np.lexsort((anchor, text))
                anchor, text = anchor[order], text[order]
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                per = np.bincount(text[new], minlength=part.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), _signed(anchor[new]))
                columns = [part.column(c) for c in ("id", *LOCATOR)] + [pa.array(words.per), pa.array(digest, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["id", *LOCATOR, "n_words", "digest", "anchors"])

    return run


def _occurrences(width: int):
    """The segments of those anchors that a text shares with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = _Words(part.column("text"), width)
                anchor, text, first, count = words.segments()
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
                shared = part.column("anchors").to_pylist()
                on = np.zeros(len(anchor), bool)
                for i, some in enumerate(shared):
                    own = slice(bounds[i], bounds[i + 1])
                    on[own] = np.isin(anchor[own], np.array(some, np.int64).view(np.uint64))
                anchor, text, first, count = anchor[on], text[on], first[on], count[on]
                columns = [part.column("id").take(pa.array(text)), _signed(anchor), _signed(words.content(first, count)), part.column("node").take(pa.array(text))]
                columns += [pa.array((first - words.ends[text]).astype(np.int32)), pa.array(count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "anchor", "content", "node", "start", "count"])

    return run


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after another."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def _texts(width: int):
    """The words of wanted segments, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lists = words_of(part.column("text"))
                begin = lists.offsets.to_numpy().astype(np.int64)
                wanted = part.column("wanted")
                asked = wanted.flatten()
                field = {c: asked.field(i) for i, c in enumerate(("anchor", "content", "start", "count"))}
                text = np.repeat(np.arange(part.num_rows), pc.list_value_length(wanted).to_numpy())
                start = field["start"].to_numpy().astype(np.int64) + begin[text] - begin[0]
                length = field["count"].to_numpy().astype(np.int64) + width - 1
                taken = lists.flatten().take(pa.array(_ranges(start, length)))
                cuts = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
                yield pa.RecordBatch.from_arrays([field["anchor"], field["content"], pc.binary_join(pa.ListArray.from_arrays(cuts, taken), " ")], ["anchor", "content", "words"])

    return run


class SuffixAutomaton:
    """Suffix automaton over words of many sequences, grown online."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        """Take in one more sequence."""
        nexts, link, length, last = self.next, self.link, self.length, 0
        for w in words:
            seen = nexts[last].get(w)
            if seen is not None and length[seen] == length[last] + 1:
                last = seen
                continue
            if seen is not None:
                last = self._clone(last, w, seen)
                continue
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in nexts[p]:
                nexts[p][w] = new
                p = link[p]
            if p != -1:
                q = nexts[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = new

    def _clone(self, p: int, w, q: int) -> int:
        nexts, link = self.next, self.link
        made = len(nexts)
        nexts.append(dict(nexts[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        link[q] = made
        while p != -1 and nexts[p].get(w) == q:
            nexts[p][w] = made
            p = link[p]
        return made

    def statistics(self, words: list) -> Iterator[int]:
        """At each word the length of the longest match that ends there."""
        nexts, link, length, state, matched = self.next, self.link, self.length, 0, 0
        for w in words:
            while state and w not in nexts[state]:
                state = link[state]
                matched = length[state]
            if w in nexts[state]:
                state, matched = nexts[state][w], matched + 1
            yield matched


def _match(width: int):
    """In one shard, the windows of each content that contents of smaller identifiers hold."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("id", "ascending")])
        columns = {c: table.column(c).to_pylist() for c in ("id", "anchor", "content", "offset", "words")}
        automaton, n = SuffixAutomaton(), table.num_rows
        out: list[tuple] = []
        begin = 0
        for end in range(1, n + 1):
            if end < n and columns["id"][end] == columns["id"][begin]:
                continue
            sequences = [columns["words"][i].split(" ") for i in range(begin, end)]
            for i, words in zip(range(begin, end), sequences):
                hits = [columns["offset"][i] + j - width + 1 for j, m in enumerate(automaton.statistics(words)) if m >= width]
                if hits:
                    out.append((columns["anchor"][i], columns["content"][i], hits))
            for words in sequences:
                automaton.add(words)
            begin = end
        a, c, h = zip(*out) if out else ((), (), ())
        return pa.table({"anchor": pa.array(a, pa.int64()), "content": pa.array(c, pa.int64()), "offsets": pa.array(h, pa.list_(pa.int64()))})

    return run


def _covered(width: int):
    """Maximal spans [start, end) of words that windows cover; the number of words in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, removed = [], []
            for windows in batch.column("windows").to_pylist():
                spans: list[list[int]] = []
                for start, end in sorted((x["start"], x["start"] + x["count"] + width - 1) for x in windows):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                lists.append([{"start": a, "end": b} for a, b in spans])
                removed.append(sum(b - a for a, b in spans))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(lists, kind), pa.array(removed, pa.int64())], ["node", "spans", "n_removed"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of what is left of texts without their spans."""
    for batch in batches:
        for part in slices(batch):
            lists = words_of(part.column("text"))
            begin = lists.offsets.to_numpy().astype(np.int64)
            begin = begin - begin[0]
            spans = part.column("spans")
            text = np.repeat(np.arange(part.num_rows), pc.list_value_length(spans).to_numpy())
            start, end = (spans.flatten().field(i).to_numpy() for i in (0, 1))
            kept = np.ones(begin[-1], bool)
            kept[_ranges(begin[text] + start, end - start)] = False
            cuts = pa.array(np.concatenate([[0], np.cumsum(kept)])[begin], pa.int32())
            left = pc.binary_join(pa.ListArray.from_arrays(cuts, lists.flatten().filter(pa.array(kept))), " ")
            digests = [hashlib.sha256(x.encode()).digest() for x in left.to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(digests, pa.binary())], ["node", "kept"])


def _with_text(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """Located texts beside narrow rows."""
    return rows.select(*LOCATOR, "text").join(narrow, LOCATOR).drop(*LOCATOR)


def _later(own: str, first: str) -> Column:
    """The identifier is larger than the first one; NULL is larger than all others."""
    return F.coalesce(F.col(own) > F.col(first), F.col(own).isNull() & F.col(first).isNotNull())


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 13, rows: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: id, file, row (its locator), n_words, n_removed, kept (SHA-256 of the kept words joined by one
    space, binary), spans (array of start and end of removed words)."""
    if width <= ANCHOR:
        raise ValueError(f"a window must have more than {ANCHOR} words")
    rows = located(docs, key, text) if rows is None else rows
    kind = docs.schema[key].dataType
    small_batches(docs.sparkSession)
    surveyed = rows.mapInArrow(frugal(_survey(width)), keyed("file string, row long, n_words long, digest binary, anchors array<long>", id=kind))
    stage = cut_lineage(surveyed.withColumn("node", F.monotonically_increasing_id()))
    order = F.struct(F.col("id").isNull().alias("no"), "id", "node")
    classes = cut_lineage(stage.groupBy("digest").agg(F.min(order).alias("first")).select("digest", F.col("first.id").alias("first_id"), F.col("first.node").alias("node")))
    heads = stage.join(classes.select("node"), "node", "left_semi") if classes.count() < stage.count() else stage
    anchors = heads.select("node", F.explode("anchors").alias("anchor"))
    shared = cut_lineage(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    hits = cut_lineage(anchors.join(shared, "anchor").groupBy("node").agg(F.collect_list("anchor").alias("anchors")))
    hits = hits.join(stage.select("node", "id", *LOCATOR), "node")
    found = _with_text(rows, hits).mapInArrow(frugal(_occurrences(width)), keyed("anchor long, content long, node long, start int, count int", id=kind))
    found = cut_lineage(found)
    sample = F.min(F.struct("node", "start", "count")).alias("at")
    contents = cut_lineage(found.groupBy("anchor", "content").agg(F.min("id").alias("first_id"), sample))
    crowds = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    contested = cut_lineage(contents.join(crowds, "anchor").select("anchor", "content", F.col("first_id").alias("id"), "crowd", "at.*"))
    repeats = _matched(rows, stage, contested, kind, width)
    whole = found.join(contents.select("anchor", "content", "first_id"), ["anchor", "content"])
    later = whole.where(_later("id", "first_id")).select("node", "start", "count")
    first = whole.where(F.col("id").eqNullSafe(F.col("first_id"))).join(repeats, ["anchor", "content"])
    first = first.select("node", F.explode("offsets").alias("offset"), "start").select("node", (F.col("start") + F.col("offset")).cast("int").alias("start"), F.lit(1).alias("count"))
    windows = later.unionByName(first).groupBy("node").agg(F.collect_list(F.struct("start", "count")).alias("windows"))
    spans = "array<struct<start: long, end: long>>"
    gone = cut_lineage(windows.mapInArrow(_covered(width), f"node long, spans {spans}, n_removed long"))
    # Texts are read again only where some words stay and some go.
    partly = gone.join(stage.select("node", "n_words", *LOCATOR), "node").where("n_removed < n_words").select("node", "spans", *LOCATOR)
    few = (gone.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_VALUES
    left = _with_text(rows, F.broadcast(partly) if few else partly).mapInArrow(frugal(_without), "node long, kept binary")
    nothing = F.unhex(F.lit(hashlib.sha256().hexdigest()))
    cut = gone.join(cut_lineage(left), "node", "left").withColumn("kept", F.coalesce("kept", nothing))
    decided = classes.join(cut, "node", "left").drop("node")
    met = stage.drop("anchors", "node").join(decided, "digest")
    copy = _later("id", "first_id") & (F.col("n_words") >= width)
    whole_span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return met.select(
        "id", *LOCATOR, "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, nothing).otherwise(F.coalesce("kept", "digest")).alias("kept"),
        F.when(copy, whole_span).otherwise(F.coalesce("spans", F.array().cast(spans))).alias("spans"),
    )


def _matched(rows: DataFrame, stage: DataFrame, contested: DataFrame, kind, width: int) -> DataFrame:
    """(anchor, content, offsets): the windows of contents that smaller identifiers hold."""
    total = contested.count()
    wanted = contested.groupBy("node").agg(F.collect_list(F.struct("anchor", "content", "start", "count")).alias("wanted")).join(stage.select("node", *LOCATOR), "node")
    texts = _with_text(rows, wanted.drop("node")).mapInArrow(frugal(_texts(width)), "anchor long, content long, words string")
    held = cut_lineage(texts.join(contested.select("anchor", "content", "id", "count", "crowd"), ["anchor", "content"]))
    shards = max(1, -(-total // SHARD_ROWS))
    few = held.where(F.col("crowd") <= CROWD).select("anchor", "content", "id", F.lit(0).alias("offset"), "words", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    split = F.split("words", " ")
    window = F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda i: F.struct(i.alias("offset"), F.array_join(F.slice(split, i + 1, width), " ").alias("words")))
    many = held.where(F.col("crowd") > CROWD).select("anchor", "content", "id", F.inline(window))
    many = many.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards)))
    made = few.unionByName(many).groupBy("shard").applyInArrow(_match(width), "anchor long, content long, offsets array<long>")
    return cut_lineage(made.groupBy("anchor", "content").agg(F.flatten(F.collect_list("offsets")).alias("offsets")))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 13) -> DataFrame:
    """``docs`` with the repeated passages taken out of their texts (kept words joined by one space); columns as given.

    Texts without repeats stay as they are.
    """
    rows = addressed(docs)
    at = docs.columns.index(text)
    gone = repeated_passages(docs, key, text, width, rows=readdressed(rows, docs.columns, key, text)).where("n_removed > 0")
    gone = cut_lineage(gone.select(F.col("file").alias("_file"), F.col("row").alias("_row"), "spans"))
    words = F.filter(F.split(F.col(f"_c{at}"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    kept = F.filter(words, lambda w, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    left = rows.join(gone, ["_file", "_row"], "left")
    columns = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)]
    columns[at] = F.when(F.col("spans").isNull(), F.col(f"_c{at}")).otherwise(F.array_join(kept, " ")).alias(text)
    return left.select(*columns)
