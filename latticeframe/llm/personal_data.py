"""Personal data by fixed forms and by bootstrapped contextual extraction.

Forms give the base spans: email, ip, card, phone. They seed the bootstrapping: the words around a seed make lexical
patterns; tokens that look like identifiers but have no form are instances, tied to the patterns of their surroundings.
On that graph a pattern's confidence for a kind is the belief in its instances, weighed against those of other kinds and those
that don't look like it; an instance is believed by the noisy-or of its patterns. Instances of high belief count like seeds
towards further patterns, round by round until none is new, and are added as spans of their kind where they look like one.
Patterns and instances are Spark tables; hot patterns are counted before they are shuffled.

Defined results: NULL and empty texts have no spans; base spans of a kind don't overlap, those of different kinds may;
added spans overlap no base span; repeated rows have the same spans; an empty table gives no rows. Counts n_* cover base and
added spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import frugal, keyed, slices, small_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive forms and whole runs: every text is passed over once, however long its runs are.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
NOT_DIGIT = re.compile(r"[^0-9]+")
EDGE = ".,;:!?\"'()[]{}<>*#%&$|=~`"
BESIDE = EDGE + " \t\n\x0b\f\r"
# What an unseen identifier of a kind looks like: looser than its form.
SHAPES = {
    "email": re.compile(r"[^\s@]+(?:@|\(at\)|\[at\])[^\s@]+", re.I),
    "ip": re.compile(r"[0-9]{1,3}(?:[.,:_-][0-9]{1,3}){2,5}"),
    "card": re.compile(r"[0-9](?:[-._]?[0-9]){10,20}"),
    "phone": re.compile(r"\(?[0-9](?:[-._/()]?[0-9]){6,14}"),
}

# Numbers written in groups: digits with single separators, spaces and brackets among them. Each step ends with a digit, so no
# text is passed over more than once.
GROUPS = re.compile(r"\+?[(\[]?[0-9](?:[)\]]?[-\x20._/]?[(\[]?[0-9])*+")
GROUPED = {"card": (11, 21), "phone": (7, 15)}


def _emails(text: str) -> list[tuple[int, int]]:
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > pos and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
        pos = m.end() if m else at + 1
        at = text.find("@", pos)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in DOTTED.finditer(text):
        parts, begin = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((begin, end))
            begin = end + 1
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of ``KINDS``."""
    found = [("email", *s) for s in _emails(text)]
    if DIGIT.search(text):
        found += [("ip", *s) for s in _ips(text)] + [("card", *s) for s in _cards(text)] + [("phone", *s) for s in _phones(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _trim(text: str, begin: int, end: int) -> tuple[int, int]:
    while begin < end and text[begin] in EDGE:
        begin += 1
    while end > begin and text[end - 1] in EDGE:
        end -= 1
    return begin, end


def _word(token: str) -> str:
    """A context word: without marks, in lower case, digits made alike."""
    return re.sub(r"[0-9]+", "0", token.strip(EDGE).lower()) or token


def _surroundings(text: str, begin: int, end: int, reach: int = 200) -> list[str]:
    """Patterns around a span: two words before, two after, and one on each side. ``reach``: code points looked at."""
    before = [_word(t) for t in text[max(0, begin - reach) : begin].split()[-2:]]
    after = [_word(t) for t in text[end : end + reach].lstrip(EDGE).split()[:2]]
    out = []
    if len(before) == 2:
        out.append("L:" + " ".join(before))
    if len(after) == 2:
        out.append("R:" + " ".join(after))
    if before and after:
        out.append(f"B:{before[-1]}|{after[0]}")
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans of each text, and its identifier-like tokens, each with form, value and patterns."""
    for batch in batches:
        for part in slices(batch):
            bases, items = [], []
            for text in part.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                found = [{"kind": k, "start": a, "end": b, "value": _digest(text[a:b]), "patterns": _surroundings(text, a, b)} for k, a, b in base]
                if DIGIT.search(text) or "@" in text or "(at)" in text or "[at]" in text:
                    found += _candidates(text, base)
                items.append(found)
            columns = [part.column("doc_id"), part.column("_at"), pa.array(bases, _BASE), pa.array(items, _ITEMS)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_at", "base", "items"])


MARK = re.compile(r"[0-9@]|\(at\)|\[at\]", re.I)


def _groups(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, kinds) of the numbers in groups that stand alone and have as many digits as a kind."""
    out = []
    for m in GROUPS.finditer(text):
        a, b = m.span()
        n = len(NOT_DIGIT.sub("", m[0]))
        kinds = [k for k, (low, high) in GROUPED.items() if low <= n <= high]
        if not kinds or (a and text[a - 1] not in BESIDE) or (b < len(text) and text[b] not in BESIDE):
            continue
        # A bracket around the number is not part of it.
        while text[a] in "([" and not any(x in text[a:b] for x in ")]"):
            a += 1
        out.append((a, b, kinds))
    return out


def _candidates(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Tokens and numbers in groups that look like a kind without being of its form, clear of all base spans and each other."""
    spans: dict[tuple[int, int], list[str]] = {}
    taken = sorted((a, b) for _, a, b in base)
    i = 0
    for a, b, kinds in _groups(text):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            spans[a, b] = kinds
    ordered = sorted([*taken, *spans])
    at, i = 0, 0
    while m := MARK.search(text, at):
        begin = m.start()
        while begin > at and text[begin - 1] not in " \t\n\x0b\f\r":
            begin -= 1
        whole = TOKEN.match(text, begin)
        at = whole.end()
        a, b = _trim(text, begin, at)
        while i < len(ordered) and ordered[i][1] <= a:
            i += 1
        if b - a < 5 or (i < len(ordered) and ordered[i][0] < b and (a, b) not in spans):
            continue
        kinds = [k for k in KINDS if SHAPES[k].fullmatch(text[a:b]) or k in spans.get((a, b), [])]
        if kinds:
            spans[a, b] = kinds
    return [
        {"kind": "?" + ",".join(kinds), "start": a, "end": b, "value": _digest(text[a:b]), "patterns": _surroundings(text, a, b)} for (a, b), kinds in sorted(spans.items())
    ]


def _digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_SPAN = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
_BASE = pa.list_(pa.struct(_SPAN))
_ITEMS = pa.list_(pa.struct([*_SPAN, ("value", pa.int64()), ("patterns", pa.list_(pa.string()))]))
BASE_DDL = "array<struct<kind:string,start:long,end:long>>"
ITEMS_DDL = "array<struct<kind:string,start:long,end:long,value:long,patterns:array<string>>>"


def bootstrap(edges: DataFrame, rounds: int | None = None, least_seeds: int = 3, confident: float = 0.8, believed: float = 0.8) -> DataFrame:
    """(value, kind, belief): instances of high belief from ``edges`` (pattern, value, seed, fits).

    ``seed``: the kind of a seed, else NULL; ``fits``: the kinds that another value looks like, with commas. Confidence of
    a pattern for a kind: belief summed over its distinct values, over that sum, 0.5 and the number of values of other
    kinds or that don't look like the kind; values that do and aren't known yet don't count. Only patterns with
    ``least_seeds`` distinct known values of the kind count. Belief of a value: noisy-or over its confident patterns. Values
    believed in count as known from the next round on, until a round (or the last of ``rounds``) finds none.
    """
    edges = cut_lineage(edges.distinct())
    pairs = cut_lineage(edges.select("pattern", "value").distinct())
    met = cut_lineage(pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("met")))
    known = cut_lineage(edges.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct())
    seeds = known.select("value").distinct()
    fits = edges.where("seed IS NULL").select("value", F.explode(F.split("fits", ",")).alias("kind")).distinct()
    fits = cut_lineage(fits.join(seeds, "value", "left_anti"))
    found = known.where(F.lit(False))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    done = 0
    while rounds is None or done < rounds:
        open_ = fits.join(known.select("value").distinct(), "value", "left_anti")
        sums = pairs.join(known, "value").groupBy("pattern", "kind").agg(F.sum("belief").alias("sum"), F.count(F.lit(1)).alias("of"))
        sums = sums.where(F.col("of") >= least_seeds).join(met, "pattern")
        likely = pairs.join(open_, "value").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("likely"))
        against = F.col("met") - F.col("of") - F.coalesce("likely", F.lit(0))
        score = F.col("sum") / (F.col("sum") + against + 0.5)
        good = sums.join(likely, ["pattern", "kind"], "left").select("pattern", "kind", score.alias("score")).where(F.col("score") >= confident)
        offered = pairs.join(good, "pattern").join(open_, ["value", "kind"]).groupBy("value", "kind")
        belief = offered.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-12)))))).alias("belief"))
        # One kind per value: the one most believed in, ties in the order of kinds.
        best = belief.where(F.col("belief") >= believed).groupBy("value").agg(F.min_by(F.struct("kind", "belief"), F.struct(-F.col("belief"), rank)).alias("b"))
        new = cut_lineage(best.select("value", "b.kind", "b.belief"))
        done += 1
        if new.isEmpty():
            break
        found, known = cut_lineage(found.unionByName(new)), cut_lineage(known.unionByName(new))
    return found.select("value", "kind", "belief")


def find_personal_data(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, base, added) of each row of ``docs`` (doc_id, text): arrays of (kind, start, end), code points, end exclusive."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_at"))
    found = cut_lineage(rows.mapInArrow(frugal(_find), keyed(f"_at long, base {BASE_DDL}, items {ITEMS_DDL}", doc_id=docs.schema["doc_id"].dataType)))
    items = found.select("_at", F.explode("items").alias("i"))
    seed = F.when(~F.col("i.kind").startswith("?"), F.col("i.kind"))
    fits = F.when(F.col("i.kind").startswith("?"), F.substr(F.col("i.kind"), F.lit(2)))
    edges = items.select(F.explode("i.patterns").alias("pattern"), F.col("i.value").alias("value"), seed.alias("seed"), fits.alias("fits"))
    trusted = bootstrap(edges, **options)
    likely = items.where(F.col("i.kind").startswith("?")).select("_at", "i.kind", "i.start", "i.end", "i.value")
    shape = F.array_contains(F.split(F.substr(F.col("l.kind"), F.lit(2)), ","), F.col("t.kind"))
    added = likely.alias("l").join(trusted.alias("t"), (F.col("l.value") == F.col("t.value")) & shape)
    # One kind per span: the one most believed in, ties in the order of kinds.
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("t.kind"))
    best = added.groupBy("_at", "start", "end").agg(F.min_by("t.kind", F.struct(-F.col("t.belief"), rank)).alias("kind"))
    per_row = best.groupBy("_at").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    empty = F.array().cast(BASE_DDL)
    return found.select("doc_id", "_at", "base").join(per_row, "_at", "left").select("doc_id", "base", F.coalesce("added", empty).alias("added"))


def ordered_spans(base, added):
    """All spans by start, then kind in the order of ``KINDS``."""
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    sortable = F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("r"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(sortable)


def span_text(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
