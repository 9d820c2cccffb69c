"""Repair of conversation structure by weighted CYK parsing of intervals.

A conversation is right when its roles read ``(s?(ua)+)?`` (s system, u user, a assistant). Its grammar is in Chomsky normal form:
the symbol [p, q] derives what leads from state p to state q, so all rules are [p, q] -> [p, r] [r, q] and [p, q] -> one edited row. A
cell of the chart holds, for one span of rows and each symbol, the least (cost, audit); the audit has one letter per edit (D delete,
I insert, K keep, R rerole) and ties go to the least one in ASCII. Inserted turns derive from the empty span; each row's cell
is closed under them on both sides before any cells are joined. Cells are joined bottom-up by span length. As a symbol names
both its states, any one split of a span gives its cell, so neighbours are joined in pairs: spans of 1, 2, 4, ... rows.

Equal costs of the same rows never give one audit that begins with another (what is left would be insertions, which cost), so the
least audit of a span is made of the least audits of its parts.

Rows are sorted once into ranges (by conversation, turn, role, text) and keep that place as one number. Parts of ``PART`` places
are parsed in tasks, then parts of a conversation in turn, so a conversation of any length is spread. Audits go back to the rows part by part.

Defined results: a NULL conversation is one of its own; NULL turns come first; of rows of one turn the order is that of role and
text; NULL role or text counts as one space; repeated rows are duplicates; roles of other initials are never kept; a
conversation without rows has no result; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..session import cut_lineage
from .text import small_batches

# States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
PART_BITS = 10
PART = 1 << PART_BITS
PARTS_JOINED = 256
BASKET = 8192
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPACE_CHARS = " \t\n\x0b\x0c\r"
FACTS = "rows long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_role string, last_role string"
CELLS = "costs array<long>, audits array<string>"


@dataclass(frozen=True)
class Costs:
    """Costs of edits; keeping is free. ``truncated`` is added for each truncated row that stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if min(self.delete, self.insert) <= 0 or min(self.rerole, self.truncated) < 0:
            raise ValueError("deletions and insertions must cost, and nothing may be negative")


def _reachable() -> list[tuple[int, int]]:
    pairs = {(p, p) for p in range(4)} | {(p, q) for (p, _), q in MOVES.items()}
    while more := {(p, s) for p, q in pairs for r, s in pairs if q == r} - pairs:
        pairs |= more
    return sorted(pairs)


SYMBOLS = _reachable()
PLACE = {s: i for i, s in enumerate(SYMBOLS)}
RULES = [[(PLACE[p, r], PLACE[r, q]) for r in range(4) if (p, r) in PLACE and (r, q) in PLACE] for p, q in SYMBOLS]


def joined(left: list, right: list) -> list:
    """The cell of two neighbouring spans: by each symbol the least (cost, audit) over its rules."""
    out = []
    for rules in RULES:
        best, ties = None, []
        for a, b in rules:
            x, y = left[a], right[b]
            if x is None or y is None:
                continue
            cost = x[0] + y[0]
            if best is None or cost < best:
                best, ties = cost, [(x, y)]
            elif cost == best:
                ties.append((x, y))
        out.append(None if best is None else (best, min(x[1] + y[1] for x, y in ties)))
    return out


def empty_span(costs: Costs) -> list:
    """The cell of no rows: what insertions alone derive."""
    cell = [None] * len(SYMBOLS)
    for p in range(4):
        cell[PLACE[p, p]] = (0, "")
    one = list(cell)
    for (p, x), q in MOVES.items():
        if x in NAMES:
            one[PLACE[p, q]] = (costs.insert, "I")
    while (more := _less(cell, joined(cell, one))) != cell:
        cell = more
    return cell


def _less(a: list, b: list) -> list:
    return [min((x for x in pair if x is not None), default=None) for pair in zip(a, b)]


def one_row(initial: str, fault: int, costs: Costs, nothing: list) -> list:
    """The cell of one row, closed under insertions."""
    cell = [None] * len(SYMBOLS)
    for p in range(4):
        cell[PLACE[p, p]] = (costs.delete, "D")
    if fault not in (BLANK, DUPLICATE):
        more = costs.truncated if fault == TRUNCATED else 0
        for (p, x), q in MOVES.items():
            edits = [(more, "K")] if x == initial else []
            edits += [(costs.rerole + more, "R")] if x in NAMES else []
            options = [e for e in [cell[PLACE[p, q]], *edits] if e is not None]
            cell[PLACE[p, q]] = min(options, default=None)
    return joined(joined(nothing, cell), nothing)


def _bottom_up(cells: list) -> list:
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def _facts_joined(parts: list[tuple]) -> tuple:
    """Sums of two and more neighbouring spans' facts, with what happens where they meet."""
    rows = blank = duplicate = truncated = illegal = turns = 0
    first = last = head = tail = None
    for r, b, d, t, i, n, lo, hi, x, y in parts:
        rows, blank, duplicate, truncated, illegal = rows + r, blank + b, duplicate + d, truncated + t, illegal + i
        if tail is not None:
            illegal += tail + x not in LEGAL
        head, tail = x if head is None else head, y
        if lo is not None:
            turns += n - (last == lo)
            first, last = lo if first is None else first, hi
    return rows, blank, duplicate, truncated, illegal, turns, first, last, head, tail


def _result(keys: list, made: list[tuple], cells: list[list]) -> pa.Table:
    names = [f.split()[0] for f in FACTS.split(", ")]
    columns = {"grp": pa.array([k[0] for k in keys], pa.string()), "part": pa.array([k[1] for k in keys], pa.int64())}
    for i, c in enumerate(names):
        columns[c] = pa.array([m[i] for m in made], pa.string() if c.endswith("role") else pa.int64())
    columns["costs"] = pa.array([[None if x is None else x[0] for x in c] for c in cells], pa.list_(pa.int64()))
    columns["audits"] = pa.array([[None if x is None else x[1] for x in c] for c in cells], pa.list_(pa.string()))
    return pa.table(columns)


def _runs(table: pa.Table, order: str) -> Iterator[tuple[tuple, dict]]:
    """(grp, part) and the columns of each run of a group's table."""
    table = table.combine_chunks().sort_by([("grp", "ascending"), ("part", "ascending"), (order, "ascending")])
    columns = {c: table.column(c).to_pylist() for c in table.column_names}
    begin = 0
    keys = list(zip(columns["grp"], columns["part"]))
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[begin]:
            yield keys[begin], {c: v[begin:i] for c, v in columns.items()}
            begin = i


def _parse_rows(costs: Costs):
    def run(table: pa.Table) -> pa.Table:
        nothing, known = empty_span(costs), {}
        keys, made, cells = [], [], []
        for key, rows in _runs(table, "at"):
            facts, chart = [], []
            for initial, fault, turn in zip(rows["initial"], rows["fault"], rows["turn"]):
                if (initial, fault) not in known:
                    known[initial, fault] = one_row(initial, fault, costs, nothing)
                chart.append(known[initial, fault])
                has = int(turn is not None)
                facts.append((1, int(fault == BLANK), int(fault == DUPLICATE), int(fault == TRUNCATED), 0, has, turn, turn, initial, initial))
            keys.append(key)
            made.append(_facts_joined(facts))
            cells.append(_bottom_up(chart))
        return _result(keys, made, cells)

    return run


def _parse_parts(table: pa.Table) -> pa.Table:
    names = [f.split()[0] for f in FACTS.split(", ")]
    keys, made, cells = [], [], []
    for key, parts in _runs(table, "old"):
        keys.append(key)
        made.append(_facts_joined(list(zip(*[parts[c] for c in names]))))
        cells.append(_bottom_up([[None if c is None else (c, a) for c, a in zip(x, y)] for x, y in zip(parts["costs"], parts["audits"])]))
    return _result(keys, made, cells)


def _in_baskets(rows: DataFrame, run, total: int, per: int) -> DataFrame:
    basket = F.pmod(F.xxhash64("grp", "part"), F.lit(max(1, -(-total // per))))
    return rows.withColumn("basket", basket).groupBy("basket").applyInArrow(run, f"grp string, part long, {FACTS}, {CELLS}")


def _parsed(facts: DataFrame, costs: Costs) -> tuple[DataFrame, DataFrame]:
    """(parts with their rows, one row per conversation: grp, facts, cost, audit)."""
    total = facts.count()
    parts = cut_lineage(_in_baskets(facts, _parse_rows(costs), total, BASKET))
    done, state = None, parts
    while True:
        ranked = state.select("grp", "part").withColumn("_k", F.row_number().over(Window.partitionBy("grp").orderBy("part")) - 1)
        ranked = cut_lineage(ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("grp"))))
        single = state.join(ranked.where("_n = 1").select("grp", "part"), ["grp", "part"], "left_semi")
        done = single if done is None else done.unionByName(single)
        left = ranked.where("_n > 1").count()
        if not left:
            break
        open_ = state.join(ranked.where("_n > 1").drop("_n"), ["grp", "part"]).withColumn("old", F.col("part"))
        open_ = open_.withColumn("part", F.floor(F.col("_k") / PARTS_JOINED).cast("long")).drop("_k")
        state = cut_lineage(_in_baskets(open_, _parse_parts, left, 64))
    ends = [PLACE[0, q] for q in FINAL]
    options = F.array(*[F.struct(F.col("costs")[i].alias("cost"), F.col("audits")[i].alias("audit")) for i in ends])
    best = F.array_min(F.filter(options, lambda o: o["cost"].isNotNull())).alias("best")
    return parts, done.select("grp", *[f.split()[0] for f in FACTS.split(", ")], best).select("*", "best.cost", "best.audit").drop("best")


def _cut_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part: its piece of the audit, whether a system turn opens the conversation, the number of the part's first turn."""
    for batch in batches:
        grps, pieces, numbers, systems, seqs = [], [], [], [], []
        for grp, audit, parts in zip(*[batch.column(c).to_pylist() for c in ("grp", "audit", "parts")]):
            at, seq = 0, 0
            # Turns come in pairs but for the system turn.
            system = (len(audit) - audit.count("D")) % 2 == 1
            for i, p in enumerate(parts):
                end, rows = at, p["rows"]
                while rows:
                    rows -= audit[end] != "I"
                    end += 1
                end = len(audit) if i + 1 == len(parts) else end
                piece = audit[at:end]
                grps.append(grp)
                pieces.append(piece)
                numbers.append(p["part"])
                systems.append(system)
                seqs.append(seq)
                seq += len(piece) - piece.count("D")
                at = end
        columns = [pa.array(grps, pa.string()), pa.array(numbers, pa.int64()), pa.array(pieces, pa.string()), pa.array(systems, pa.bool_()), pa.array(seqs, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["grp", "part", "audit", "system", "seq"])


class _Repair:
    """Edits rows as they come: a part's audit first, then its rows in order."""

    def __init__(self):
        self.letters, self.seq, self.system = iter(()), 0, False

    def _role(self) -> str:
        return NAMES["ua"[(self.seq - self.system) % 2]]

    def _inserted(self, letter):
        while letter == "I":
            yield self.seq, self._role(), "", "I"
            self.seq += 1
            letter = next(self.letters, None)
        return letter

    def part(self, audit: str, seq: int, system: bool):
        self.letters, self.seq, self.system = iter(audit), seq, system

    def row(self, role: str, text: str):
        letter = yield from self._inserted(next(self.letters))
        if letter == "D":
            return
        yield self.seq, role if letter == "K" else self._role(), text, letter
        self.seq += 1

    def rest(self):
        yield from self._inserted(next(self.letters, None))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
    """(grp, turns) in order of the stream; a conversation's turns may come in several lists, the first one at its first part."""
    repair, current = _Repair(), None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("grp", "audit", "seq", "system", "role", "text")]
        for grp, audit, seq, system, role, text in zip(*columns):
            if audit is not None:
                if current is not None:
                    yield current, list(repair.rest())
                current = grp
                repair.part(audit, seq, system)
                yield grp, []
            else:
                yield grp, list(repair.row(role, text))
    if current is not None:
        yield current, list(repair.rest())


def _as_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows):
        grp, seq, role, text, edit = zip(*rows)
        return pa.RecordBatch.from_pydict({"grp": pa.array(grp), "seq": pa.array(seq, pa.int64()), "role": pa.array(role), "text": pa.array(text), "edit": pa.array(edit)})

    held: list[tuple] = []
    for grp, turns in _edited(batches):
        held += [(grp, *t) for t in turns]
        if len(held) >= 1000:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def _as_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple[str, str]] = []
    current, digest, any_ = None, hashlib.sha256(), False
    for grp, turns in _edited(batches):
        if grp != current:
            if current is not None:
                done.append((current, digest.hexdigest()))
            current, digest, any_ = grp, hashlib.sha256(), False
        for _, role, text, _ in turns:
            digest.update(f"{chr(10) if any_ else ''}{role}:{text}".encode())
            any_ = True
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pydict({"grp": [d[0] for d in done], "repaired_sha256": [d[1] for d in done]})
            done = []
    if current is not None:
        done.append((current, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_pydict({"grp": [d[0] for d in done], "repaired_sha256": [d[1] for d in done]})


class Repaired:
    """Conversations with the edits found for them."""

    def __init__(self, staged: DataFrame, parts: DataFrame, found: DataFrame, kind: DataType):
        self._staged, self._parts, self._found, self._kind = staged, parts, found, kind

    def summary(self) -> DataFrame:
        """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost (longs), audit."""
        gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
        return self._found.select("grp", self._conv(), gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def _conv(self) -> Column:
        return F.when(F.col("grp") != "n", F.substr("grp", F.lit(2))).cast(self._kind).alias("conv")

    def _stream(self, *spread: str) -> DataFrame:
        """Audits and rows, each part's audit before its rows, in order within partitions."""
        lists = self._parts.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("part", "rows"))).alias("parts"))
        pieces = self._found.select("grp", "audit").join(lists, "grp").mapInArrow(_cut_audits, "grp string, part long, audit string, system boolean, seq long")
        marks = pieces.select("grp", "part", F.lit(None).cast("long").alias("at"), "audit", "seq", "system", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
        rows = self._staged.select("grp", F.shiftright("at", PART_BITS).alias("part"), "at", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("boolean").alias("system"), "role", "text")
        small_batches(self._staged.sparkSession)
        return marks.unionByName(rows).repartition(*spread).sortWithinPartitions("grp", "part", "at")

    def turns(self) -> DataFrame:
        """One row per turn of the repaired conversations: conv, seq (from 0), role, text, edit."""
        made = self._stream("grp", "part").mapInArrow(_as_turns, "grp string, seq long, role string, text string, edit string")
        return made.select(self._conv(), "seq", "role", "text", "edit")

    def digests(self) -> DataFrame:
        """(grp, repaired_sha256): of ``role:text`` of all turns, joined by line ends. A conversation streams through one hash."""
        return self._stream("grp").mapInArrow(_as_digests, "grp string, repaired_sha256 string")


def conversation_key(conv: Column) -> Column:
    """The conversation as a text that is never NULL."""
    return F.coalesce(F.concat(F.lit("s"), conv.cast("string")), F.lit("n"))


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", costs: Costs = Costs()) -> Repaired:
    """Find the cheapest edits that set every conversation right. Results: ``summary``, ``turns``, ``digests``."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    named = rows.select(conversation_key(F.col(conv)).alias("grp"), F.col(turn).cast("long").alias("turn"), *filled, F.monotonically_increasing_id().alias("uid"))
    order = ["grp", "turn", "role", "text", "uid"]
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order)
    staged = cut_lineage(dealt.select("grp", "turn", "role", "text", F.monotonically_increasing_id().alias("at")))
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    first = staged.groupBy("grp", same.alias("same")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    body = F.expr(f"trim(BOTH '{''.join(f'\\u{ord(c):04x}' for c in SPACE_CHARS)}' FROM text)")
    fault = F.when(F.col("body") == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.right("body", F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    narrow = staged.select("grp", "turn", "at", F.substr("role", F.lit(1), F.lit(1)).alias("initial"), F.right(body, F.lit(1)).alias("body"))
    facts = narrow.join(first, "at", "left").select("grp", F.shiftright("at", PART_BITS).alias("part"), "at", "turn", "initial", fault.alias("fault"))
    parts, found = _parsed(cut_lineage(facts), costs)
    return Repaired(staged, parts, cut_lineage(found), rows.schema[conv].dataType)
