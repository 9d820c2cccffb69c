"""SimHash fingerprints of 64 bits, and all fingerprints within a Hamming radius of each other.

Terms are neighbouring words (the last word alone too); longer ones, which are rarer, weigh more. Each occurrence votes
with its hash: a bit gets plus or minus the weight. Votes for 1 are counted in two lanes of a long, which hold more
than any text has. Fingerprints close to each other are found by permuted block tables: the bits are cut into more
blocks than the radius, so near fingerprints agree on some choice of blocks, and each choice keys one table.

Defined results: NULL and empty texts have no votes and the fingerprint 0; a bit without majority is 0; equal texts have
equal fingerprints; rows stand in order of falling identifier (NULL last), ties by falling text hash and place; a single row is
its own successor; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .exact_dedup import located
from .text import SPACES, ascii_lower

BITS = 64
HALF = BITS // 2
LANES = 1 << HALF | 1
HEAVIEST = 3
MAX_BUCKETS = 1 << 16


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and fingerprint long of each row (keys must be unique)."""
    words = F.split(F.btrim(ascii_lower(F.col(text)), F.lit(" \t\n\x0b\f\r")), f"[{SPACES}]+")
    split = texts.select(*keys, words.alias("_a")).select(*keys, F.explode(F.arrays_zip("_a", F.slice("_a", F.lit(2), F.size("_a")).alias("_b"))).alias("_t"))
    a, b = F.col("_t._a"), F.coalesce(F.col("_t._b"), F.lit(""))
    weight = F.when(a == "", 0).otherwise(F.least(F.lit(HEAVIEST), 1 + F.floor((F.octet_length(a) + F.octet_length(b)) / 6))).cast("long")
    voted = split.select(*keys, F.xxhash64(a, b).alias("_h"), weight.alias("_w"))
    sums = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(LANES)) * F.col("_w")).alias(f"_s{i}") for i in range(HALF)]
    votes = voted.groupBy(*keys).agg(F.sum("_w").alias("_all"), *sums)

    def bit(i: int) -> Column:
        lane = F.col(f"_s{i % HALF}")
        ones = F.shiftrightunsigned(lane, HALF) if i >= HALF else lane.bitwiseAND(F.lit((1 << HALF) - 1))
        mask = 1 << i if i < BITS - 1 else -(1 << i)
        return F.when(ones * 2 > F.col("_all"), F.lit(mask)).otherwise(F.lit(0).cast("long"))

    whole = reduce(lambda x, y: x.bitwiseOR(y), [bit(i) for i in range(BITS)])
    return votes.select(*keys, whole.alias("fingerprint"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_neighbours(found: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(fingerprint, n_near long): per distinct fingerprint of ``found`` the rows of other fingerprints within ``radius``.

    Each of the C(blocks, radius) tables is keyed by the blocks that are left when ``radius`` of them are let go; any two
    fingerprints within the radius meet in one of them at least, and are counted in the first.
    """
    if not radius < blocks <= BITS:
        raise ValueError("there must be more blocks than bits in the radius")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = []
    for kept in itertools.combinations(range(blocks), blocks - radius):
        mask = sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in kept)
        masks.append(mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask)
    distinct = cut_lineage(found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")))
    table = F.array(*[F.lit(m) for m in masks])
    keyed = distinct.select(F.col("fingerprint").alias("f"), "n", F.posexplode(table).alias("t", "m")).withColumn("key", F.col("f").bitwiseAND(F.col("m")))
    left, right = keyed.alias("l"), keyed.alias("r")
    same = (F.col("l.t") == F.col("r.t")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.f") < F.col("r.f"))
    other = F.col("l.f").bitwiseXOR(F.col("r.f"))
    first = F.array_position(F.transform(table, lambda m: m.bitwiseAND(other) == 0), F.lit(True)) - 1
    near = left.join(right, same & (distance(F.col("l.f"), F.col("r.f")) <= radius)).where(first == F.col("l.t"))
    each = near.select(F.explode(F.array(
        F.struct(F.col("l.f").alias("fingerprint"), F.col("r.n").alias("n")), F.struct(F.col("r.f").alias("fingerprint"), F.col("l.n").alias("n"))
    )).alias("x")).select("x.*")
    return each.groupBy("fingerprint").agg(F.sum("n").alias("n_near"))


def _order(rows: DataFrame) -> DataFrame:
    """Located rows with ``place``: rows in order of falling place are in order of falling id (NULL last)."""
    place = F.struct("id", F.xxhash64("text").alias("tie"), F.xxhash64("file").alias("file"), F.col("row").alias("row"))
    return rows.select("id", "text", place.alias("place"))


def _edges(rows: DataFrame, bucket_bytes: int) -> tuple[Column, int]:
    """The first place of each bucket in falling order, as one constant array, and the number of buckets.

    Buckets are ranges of the order with like numbers of rows, about ``bucket_bytes`` of text each, or more of it where that
    would give more than ``MAX_BUCKETS``; so the array is bounded.
    """
    narrow = cut_lineage(rows.select("place", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")))
    size = narrow.agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    count = max(1, min(-(-(size["bytes"] or 0) // bucket_bytes), size["n"], MAX_BUCKETS))
    dealt = narrow.repartitionByRange(count, F.col("place").desc())
    firsts = cut_lineage(dealt.groupBy(F.spark_partition_id().alias("range")).agg(F.max("place").alias("place")))
    found = firsts.agg(F.to_json(F.sort_array(F.collect_list("place"), asc=False)).alias("edges"), F.count(F.lit(1)).alias("n")).first()
    kind = f"array<{narrow.schema['place'].dataType.simpleString()}>"
    return F.from_json(F.lit(found["edges"] or "[]"), kind), found["n"]


def _bucket(edges: Column, count: int) -> Column:
    """The last of the falling ``edges`` (from 0) that isn't below the row's place, by binary search."""

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"] + 1) / 2).cast("int")
        reached = F.get(edges, middle) >= F.col("place")
        return F.struct(F.when(reached, middle).otherwise(state["lo"]).alias("lo"), F.when(reached, state["hi"]).otherwise(middle - 1).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(max(count - 1, 0)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(count, 1).bit_length())), start, halve, lambda s: s["lo"])


def with_successors(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = 8 << 20) -> DataFrame:
    """Each text with its edited form: (id, at, next_at, n_chars, text, edited), ``at`` being the row's unique place.

    The last third of a text gives way to as much of the beginning of the next one. Texts are shuffled once, into buckets of
    neighbours; the first text of each bucket also goes to the bucket before it, the very first one to the last bucket.
    """
    rows = _order(located(docs, key, text))
    edges, count = _edges(rows, bucket_bytes)
    dealt = rows.withColumn("bucket", _bucket(edges, count))
    first = F.get(edges, F.col("bucket")) == F.col("place")
    twice = F.when(first, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    dealt = dealt.withColumn("guest", F.explode(twice))
    dealt = dealt.withColumn("bucket", F.when(F.col("guest"), F.pmod(F.col("bucket") - 1, F.lit(max(count, 1)))).otherwise(F.col("bucket")))
    near = Window.partitionBy("bucket").orderBy("guest", F.col("place").desc())
    named = dealt.select("id", "bucket", "guest", "place", F.struct("place.file", "place.row").alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    met = named.select("*", F.lead("at").over(near).alias("next_at"), F.lead("text").over(near).alias("next")).where(~F.col("guest"))
    sized = met.withColumn("n_chars", F.length("text").cast("long")).withColumn("third", F.floor(F.col("n_chars") / 3).cast("int"))
    body = F.substring("text", F.lit(1), (F.col("n_chars") - F.col("third")).cast("int"))
    edited = F.concat(body, F.substring("next", F.lit(1), F.col("third")))
    return sized.select("id", "at", "next_at", "n_chars", "text", edited.alias("edited"))


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """Fingerprints of texts and of their edited forms, their likeness, and how many rows have one within ``radius``."""
    both = with_successors(docs, key, text)
    two = F.explode(F.array(
        F.struct(F.lit(0).alias("form"), F.col("text").alias("body"), F.lit(None).cast("string").alias("sha")),
        F.struct(F.lit(1).alias("form"), F.col("edited").alias("body"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha")),
    )).alias("x")
    forms = both.select("id", "at", "next_at", "n_chars", two).select("id", "at", "next_at", "n_chars", "x.*")
    keys = ["id", "at", "next_at", "n_chars", "form", "sha"]
    found = cut_lineage(fingerprints(forms, keys, "body"))
    own = found.where("form = 0").select("id", "at", "next_at", "n_chars", "fingerprint")
    edited = found.where("form = 1").select("at", F.col("sha").alias("edited_sha256"), F.col("fingerprint").alias("edited_fingerprint"))
    after = own.select(F.col("at").alias("next_at"), F.col("fingerprint").alias("next_fingerprint"))
    near = hamming_neighbours(own.select("fingerprint"), radius)
    copies = own.groupBy("fingerprint").agg((F.count(F.lit(1)) - 1).alias("equal"))
    counted = copies.join(near, "fingerprint", "left").select("fingerprint", (F.col("equal") + F.coalesce("n_near", F.lit(0))).alias("n_near"))
    joined = own.join(edited, "at").join(after, "next_at").join(counted, "fingerprint")
    like = lambda a, b: 1 - distance(F.col(a), F.col(b)) / BITS
    return joined.select(
        "id", "n_chars", "edited_sha256", hex_digits(F.col("fingerprint")).alias("fingerprint"),
        hex_digits(F.col("edited_fingerprint")).alias("edited_fingerprint"), like("fingerprint", "edited_fingerprint").alias("near_edited"),
        like("fingerprint", "next_fingerprint").alias("near_next"), "n_near",
    )
