"""Manifest, repeated passages and conversation repair against plain Python."""

import collections
import hashlib
import heapq
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import SCHEMA, clashing, odd_rows

from latticeframe.llm import conversations, manifest, queries, repeats, sha256
from latticeframe.llm.text import fold_of

WS = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


# Merkle manifest


def test_states_are_those_of_sha256():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(70)]
    words = sha256.to_words(digests)
    assert sha256.to_bytes(words) == digests
    parts = np.arange(70) % 4
    state = sha256.fresh(70)
    for k in range(3):
        state = sha256.resume(state, words[:, parts > k], parts > k)
    state = sha256.to_words(sha256.to_bytes(state))
    assert sha256.to_bytes(sha256.finish(state, parts)) == [hashlib.sha256(d.hex().encode() * int(n)).digest() for d, n in zip(digests, parts)]


def hexdigest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        c = levels[-1]
        levels.append([hexdigest("".join(c[i : i + 3])) for i in range(0, len(c), 3)])
    return levels


def expected_manifest(rows):
    def leaf(r, text):
        return hexdigest("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted(by[s], key=lambda x: x[:3]) for s in sources}
    trees = {s: tree([x[2] for x in groups[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for i, (_, _, own, r) in enumerate(groups[s]):
            text = r[1]
            if text is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0:
                text = text.replace("\n", "")
            value, siblings = leaf(r, text), ""
            for levels, j in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    at = j // 3 * 3
                    run = level[at : at + 3]
                    siblings += "".join(x for q, x in enumerate(run) if at + q != j)
                    run[j - at] = value
                    value, j = hexdigest("".join(run)), j // 3
            yield r[0], own, trees[s][-1][0], top[-1][0], hexdigest(siblings), value, value == top[-1][0]


def found_manifest(docs):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.when(fold_of("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaf, changed = manifest.hashed_fields(*fields, F.col("text")), manifest.hashed_fields(*fields, text)
    return [tuple(r) for r in manifest.dataset_manifest(docs, leaf=leaf, changed=changed).collect()]


def test_manifest_odd_rows(spark, odd, empty):
    got = found_manifest(clashing(odd))
    assert ordered(got) == ordered(expected_manifest(odd_rows()))
    assert found_manifest(empty) == []


def test_manifest_of_one_row(spark):
    docs = spark.createDataFrame([(2, "a\nb", None, None, None)], SCHEMA)
    assert found_manifest(docs) == list(expected_manifest([(2, "a\nb", None, None, None)]))


def test_manifest_of_many_tiers_and_sources(spark):
    rng = random.Random(2)
    sources = ["big"] * 2300 + [f"s{rng.randrange(900):03}" for _ in range(1100)] + [None] * 3
    rows = [(i // 2, f"line {i}\nand {rng.random()}", "en", s, i) for i, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = found_manifest(docs)
    assert ordered(got) == ordered(expected_manifest(rows)) and {r[-1] for r in got} == {True, False}


# Repeated passages


def expected_repeats(rows, width):
    words = [(r[0], [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r[1] or "")]) for r in rows]
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, w in words:
        for p in range(len(w) - width + 1):
            s = tuple(w[p : p + width])
            first[s] = min(first.get(s, key(i)), key(i))
    for i, w in words:
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < key(i):
                gone.update(range(p, p + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def passages():
    """Shared passages of all lengths around the window, under changing neighbours; chains; a passage that very many share."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [text(n) for n in (8, 12, 13, 14, 20, 60, 200)]
    common = text(16)
    rows = []
    for i in range(160):
        parts = [text(rng.randint(0, 25)) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(shared))
        if i % 2:
            parts.insert(rng.randrange(4), common)
        rows.append((rng.choice([i, i, i, 7, None]), rng.choice(["  ", " ", "\n\t"]).join(w for p in parts for w in p), "en", "s", 1))
    rows += [(500, " ".join(shared[-1][10:150]), "en", "s", 1), (3, " ".join(shared[-1][140:] + shared[-1][:30]), "en", "s", 1)]
    return rows


def found_repeats(docs, width):
    got = repeats.repeated_passages(docs, width=width).select("id", "n_words", "n_removed", F.lower(F.hex("kept")))
    return [tuple(r) for r in got.collect()]


@pytest.mark.parametrize("width,crowd", [(13, 4096), (13, 1), (9, 2)])
def test_repeats_match_windows(spark, monkeypatch, width, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rows = passages()
    got = found_repeats(spark.createDataFrame(rows, SCHEMA).repartition(7), width)
    assert ordered(got) == ordered(expected_repeats(rows, width))
    assert len({r[2] for r in got}) > 10


def test_repeats_odd_rows(spark, odd, empty):
    assert ordered(found_repeats(clashing(odd), 13)) == ordered(expected_repeats(odd_rows(), 13))
    assert found_repeats(empty, 13) == []
    left = repeats.without_repeats(clashing(odd))
    assert left.columns == clashing(odd).columns
    want = collections.Counter(d for *_, d in expected_repeats(odd_rows(), 13))
    texts = [" ".join((r["text"] or "").split()) for r in left.collect()]
    assert collections.Counter(hashlib.sha256(t.encode()).hexdigest() for t in texts if t.isascii()) <= want


def test_spans_are_maximal(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"{a} x {b}", "", "", 0), (2, f"y {b} {a} z", "", "", 0)], SCHEMA)
    spans = {r["id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in repeats.repeated_passages(docs).collect()}
    assert spans == {1: [], 2: [(1, 51)]}


def test_automaton_statistics():
    rng = random.Random(4)
    for _ in range(60):
        held = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(4)]
        asked = [rng.choice("abcd") for _ in range(30)]
        automaton = repeats.SuffixAutomaton()
        for h in held:
            automaton.add(h)
        joined = ["".join(h) for h in held]
        want = [max(n for n in range(j + 2) if any("".join(asked[j + 1 - n : j + 1]) in h for h in joined)) for j in range(30)]
        assert list(automaton.statistics(asked)) == want


# Conversations


def damage(rows):
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if v is None else v for v in (r, x))
        if kind == 1:
            x = ""
        if kind == 2:
            x = x.translate({ord(q): None for q in ".!?"})
        yield from [(c, t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)


MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(items, costs):
    """Shortest path over (rows read, state), by cost and then by audit."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if i == len(items) and q in (0, 3):
            return cost, audit, out
        if (i, q) in seen:
            continue
        seen.add((i, q))
        for x, name in NAMES.items():
            if (q, x) in MOVES:
                heapq.heappush(heap, (cost + costs.insert, audit + "I", i, MOVES[q, x], (*out, f"{name}:")))
        if i == len(items):
            continue
        role, text, fault = items[i]
        heapq.heappush(heap, (cost + costs.delete, audit + "D", i + 1, q, out))
        if fault in ("blank", "duplicate"):
            continue
        more = costs.truncated if fault else 0
        if (q, role[:1]) in MOVES:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, MOVES[q, role[:1]], (*out, f"{role}:{text}")))
        for x, name in NAMES.items():
            if (q, x) in MOVES:
                heapq.heappush(heap, (cost + costs.rerole + more, audit + "R", i + 1, MOVES[q, x], (*out, f"{name}:{text}")))


def expected_repairs(rows, costs=conversations.Costs()):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    for c, v in by.items():
        v.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
        seen, items, n = set(), [], collections.Counter()
        for _, r, x in v:
            body = x.strip(WS)
            fault = "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((r, x))
            items.append((r, x, fault))
            n[fault] += 1
        turns = [t for t, _, _ in v if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:]))
        cost, audit, out = cheapest(items, costs)
        yield c, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, out


TALKS = "conv_id long, turn long, role string, text string"


def talks(seed, many=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(many), None]:
        for t in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "u", "", None])
            text = rng.choice(["Yes.", "No!", "Why?", "well", "", " \n", None, f"word {rng.random()}.", f"cut {rng.random()}"])
            rows += [(c, rng.choice([t, t, t, None]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


def found_repairs(df, costs=conversations.Costs()):
    repaired = conversations.repair_conversations(df, costs=costs)
    turns = collections.defaultdict(list)
    for r in repaired.turns().collect():
        turns[r["conv"]].append((r["seq"], f"{r['role']}:{r['text']}"))
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in turns.values())
    digests = {r["grp"]: r["repaired_sha256"] for r in repaired.digests().collect()}
    for r in repaired.summary().collect():
        out = tuple(t for _, t in sorted(turns[r["conv"]]))
        assert digests[r["grp"]] == hashlib.sha256("\n".join(out).encode()).hexdigest()
        yield *tuple(r)[1:], out


@pytest.mark.parametrize("seed,costs", [(1, conversations.Costs()), (2, conversations.Costs(rerole=3, delete=7, insert=2, truncated=0)), (3, conversations.Costs(1, 1, 1, 1))])
def test_repairs_match_shortest_paths(spark, seed, costs):
    rows = talks(seed)
    df = spark.createDataFrame(rows, TALKS).repartition(4)
    extra = df.select("*", *[F.lit(1).alias(c) for c in ("grp", "at", "part", "fault", "uid", "audit", "conv")])
    assert ordered(found_repairs(extra, costs)) == ordered(expected_repairs(rows, costs))


def test_repair_of_a_long_conversation(spark):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "same."])) for t in range(3000)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, TALKS).repartition(4)
    assert ordered(found_repairs(df)) == ordered(expected_repairs(rows))


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], TALKS)
    assert list(found_repairs(df)) == []


def test_any_split_of_a_span_gives_its_cell():
    rng = random.Random(7)
    costs = conversations.Costs(rerole=2, delete=3, insert=2, truncated=1)
    nothing = conversations.empty_span(costs)
    for _ in range(40):
        cells = [conversations.one_row(rng.choice("suat"), rng.randrange(4), costs, nothing) for _ in range(5)]
        whole = conversations._bottom_up(cells)
        for k in range(1, 5):
            assert conversations.joined(conversations._bottom_up(cells[:k]), conversations._bottom_up(cells[k:])) == whole


def test_op13_over_damaged_rows(spark, tmp_path):
    rows = talks(5, 200)
    spark.createDataFrame(rows, TALKS).write.parquet(str(tmp_path / "conversations.parquet"))
    want = {c: (0, 0, 0, 0, 0, 0, "", ()) for c, *_ in rows} | {r[0]: r[1:] for r in expected_repairs(damage(rows))}
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op13_repair(spark, str(tmp_path)).collect()}
    assert got == {c: (*w[:-1], hashlib.sha256("\n".join(w[-1]).encode()).hexdigest()) for c, w in want.items()}
    assert len(list(itertools.chain(got))) == len(want)
