"""Best-two-fit packing of tokenised documents into sequences of one length.

Documents become pieces of at most ``capacity`` tokens. Only the number of pieces per length (at most ``capacity``
numbers, whatever the input) decides the plan: bins are filled greedily, the longest length that fits first; then the bin's
shortest piece gives way to two others that fit the widened gap more tightly. A filled bin is a pattern that is
repeated as often as its lengths last. Pieces then take their places by their rank among those of their length.

Defined results: NULL and empty texts are documents of the end token alone; repeated rows are packed each; an
empty table gives no rows; a piece of full length is a sequence by itself.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import KEPT, filled, keyed, release, slices, small_batches

END_ID = 1
# Words whose ids a worker remembers; the memory starts anew beyond it.
REMEMBER = 400_000
TOKENS_BYTES = 8 << 20
LOOKED_UP = 1 << 17
PARTS = 64


class Encoder:
    """Token ids of texts. Words between white space are encoded once and remembered.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words. Words of
    letters alone are one pre-token each: many are encoded as one line and told apart by the ids that end a word.
    """

    def __init__(self, path: str):
        # Spark runs a worker per core already; threads of its own would only take memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.is_end[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.used = np.zeros(1 << 19, np.int32), np.zeros(1 << 18, np.int64), 0

    def _add(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.known), len(words)
        self.known.update(zip(words, range(n, n + m)))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + m + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[n + 1 : n + m + 1] = self.used + np.cumsum(sizes)
        self.used += len(flat)

    def _learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBER and self.known:
            self._forget()
            new = words
        plain, rest = [], []
        for w in new:
            (plain if w.isalpha() else rest).append(w)
        lines = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        for line in lines:
            # One line at a time: an encoding is many times larger than its ids.
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(line)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(line) and ends[-1] == len(ids):
                self._add(line, ids, np.diff(ends, prepend=0))
            else:
                rest += line
        for i in range(0, len(rest), 1000):
            some = rest[i : i + 1000]
            each = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self._add(some, np.fromiter((i for x in each for i in x), np.int32), np.fromiter(map(len, each), np.int64, len(each)))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text ends."""
        texts = filled(texts)
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            # Lower case now, and closing marks apart from their word, only make for fewer distinct words.
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"(\pL)([.,;:!?]+)(\s|$)", r"\1 \2\3")
        parts = pc.ascii_split_whitespace(texts)
        per_text = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])
        coded = parts.flatten().dictionary_encode()
        del texts, parts
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        self._learn(words)
        known = self.known
        place = np.fromiter((known[w] for w in words), np.int32, len(words))
        del words
        found, last = [np.zeros(0, np.int32)], np.zeros(len(codes) + 1, np.int64)
        # Some words at a time: their places take several times the room of the ids.
        for i in range(0, len(codes), LOOKED_UP):
            at = place[codes[i : i + LOOKED_UP]]
            begin = self.begin[at]
            sizes = self.begin[at + 1] - begin
            ends = np.cumsum(sizes)
            index = np.repeat(begin - ends + sizes, sizes)
            index += np.arange(len(index))
            found.append(self.flat[index])
            last[i + 1 : i + 1 + len(at)] = last[i] + ends
        return np.concatenate(found), last[per_text[1:]]


@lru_cache(maxsize=1)
def kept_encoder(path: str) -> Encoder:
    """A worker's encoder: what it has learned serves its later tasks as well, until one of another operator comes."""
    return Encoder(path)


KEPT.append(kept_encoder.cache_clear)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """(doc_id, piece int, start long, length long, ids_crc32 long) of whole texts with the end token."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, limit=TOKENS_BYTES):
                flat, ends = encoder.ids(part.column("text"))
                flat = flat.astype("<u4")
                rows, piece, start, length, crc = [], [], [], [], []
                last = 0
                for i, end in enumerate(ends):
                    ids = np.append(flat[last:end], np.uint32(END_ID)).astype("<u4")
                    last = end
                    for k in range(0, len(ids), capacity):
                        cut = ids[k : k + capacity]
                        rows.append(i)
                        piece.append(k // capacity)
                        start.append(k)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                columns = [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
            release()

    return docs.select("doc_id", "text").mapInArrow(run, keyed("piece int, start long, length long, ids_crc32 long", doc_id=kind))


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a bin, longest first) and how often each is used, until ``counts`` is used up.

    Each pattern is used until one of its lengths runs out, so there are no more patterns than lengths.
    """
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        free[length] += n
    patterns: list[tuple[tuple[int, ...], int]] = []
    top = capacity
    while True:
        while top > 0 and not free[top]:
            top -= 1
        if not top:
            return patterns
        left = free.copy()
        # Lengths that are left, and for each gap the longest of them that fits.
        bin_, gap = [top], capacity - top
        left[top] -= 1
        while gap > 0:
            fits = np.flatnonzero(left[1 : gap + 1])
            if not len(fits):
                break
            best = int(fits[-1]) + 1
            # The same length again, as often as it fits and lasts, before the next shorter one.
            n = int(min(left[best], gap // best))
            bin_ += [best] * n
            left[best] -= n
            gap -= best * n
        if gap > 0 and len(bin_) > 1:
            _two_for_one(bin_, left, gap)
        used = Counter(bin_)
        times = int(min(free[length] // n for length, n in used.items()))
        for length, n in used.items():
            free[length] -= n * times
        patterns.append((tuple(sorted(bin_, reverse=True)), times))


def _two_for_one(bin_: list[int], left: np.ndarray, gap: int) -> None:
    """Put two unpacked pieces in the place of the bin's shortest one if they fill its gap better."""
    short = bin_[-1]
    room = gap + short
    left[short] += 1
    lengths = np.flatnonzero(left[1:room]) + 1
    if len(lengths):
        # For each first piece the longest second one that still fits beside it; the same length twice needs two.
        second = np.searchsorted(lengths, room - lengths, side="right") - 1
        ok = second >= 0
        first, other = lengths[ok], lengths[second[ok]]
        single = (first == other) & (left[first] < 2)
        if single.any():
            lower = np.searchsorted(lengths, first[single], side="left") - 1
            other = other.copy()
            other[single] = np.where(lower >= 0, lengths[np.maximum(lower, 0)], 0)
        total = np.where(other > 0, first + other, 0)
        if len(total) and total.max() > short:
            k = int(total.argmax())
            bin_[-1:] = sorted((int(first[k]), int(other[k])), reverse=True)
            return
    left[short] -= 1


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` with sequence_id long and offset long; offsets are gapless from 0 in each sequence."""
    spark = pieces.sparkSession
    pieces = cut_lineage(pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(PARTS)).cast("int")))
    tally = pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"))
    tally = cut_lineage(tally)
    # At most ``capacity`` numbers: the only thing the driver sees.
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, base = Counter(), 0
    for lengths, times in best_two_fit(counts, capacity):
        offset = 0
        for length, n in Counter(lengths).items():
            # Ranks from here on: n neighbours per bin, side by side.
            places.setdefault(length, []).append((taken[length], n, base, offset))
            taken[length] += n * times
            offset += length * n
        base += times
    schema = "length long, places array<struct<lo:long,n:long,bin:long,offset:long>>"
    plan = spark.createDataFrame([(k, v) for k, v in places.items()], schema)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tally.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_i", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["length", "_part"])
    # One row per length; each holds the runs of ranks of the patterns that use the length.
    placed = ranked.withColumn("_rank", F.col("_start") + F.col("_i")).join(F.broadcast(plan), "length")
    run = F.element_at(F.filter("places", lambda p: p["lo"] <= F.col("_rank")), -1)
    placed = placed.withColumn("_run", run).withColumn("_k", F.col("_rank") - F.col("_run.lo"))
    sequence = F.col("_run.bin") + F.floor(F.col("_k") / F.col("_run.n"))
    offset = F.col("_run.offset") + F.col("length") * F.pmod("_k", F.col("_run.n"))
    keep = [c for c in pieces.columns if c != "_part"]
    return placed.select(*keep, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
