"""Every operator of the subpackage against plain Python on small tables, with odd rows of all kinds."""

import collections
import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from latticeframe.llm import exact_dedup, jaccard_join, mixing, packing, personal_data, queries, sharding, simhash, suffix_tree, toxicity, wrapper
from latticeframe.llm.text import token_codes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(LOW)


def odd_rows():
    """NULLs in every column, empty, blank and long texts, ties and repeated rows, near and exact copies."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = text(30_000)
    near = [text(80)]
    for _ in range(6):
        cut = near[0].split()
        cut[rng.randrange(len(cut))] = rng.choice(words)
        near.append(" ".join(cut))
    rows = [(i, text(rng.randint(1, 120)), "en", f"s{i % 4}", 1) for i in range(40)]
    rows += [(100 + i, t, "en", "s1", 2) for i, t in enumerate(near)]
    rows += [(200 + i, rows[3][1].upper() if i % 2 else rows[3][1], "en", "s2", 3) for i in range(9)]
    rows += [(300, long, "en", "s0", 9), (301, long, None, "s0", 9), (302, "", "en", "s3", 0), (303, None, "en", "s3", None), (304, " \t\n ", None, None, 4)]
    rows += [(None, text(20), None, None, None), (None, None, None, None, None), (305, "É é ß İ ünï", "de", None, 5), (306, "one", "en", "s1", 3)]
    rows += [(307, "same row again and again", "en", "s2", 1)] * 5
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns under names that operators use themselves."""
    names = ["score", "predicted", "id", "file", "row", "rank", "copies", "nth", "size", "kept", "n", "_c0", "_file", "_at", "h", "label", "toxic", "_metadata"]
    return df.select("*", *[F.lit(7).alias(c) for c in names])


def labels_of(spark):
    return spark.createDataFrame([(i, 1, 1 if i % 5 == 0 else 0) for i in range(60)] + [(None, 1, 1), (3, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")


# Toxicity


def toxic_docs(spark):
    rng = random.Random(3)
    clean = ["the cat sat", "on a mat", "green tea is warm", "we walk home"]
    bad = ["you utter blockhead", "such a rotten gloop", "blockheads and gloops everywhere"]
    rows = []
    for i in range(60):
        parts = [rng.choice(clean) + "." for _ in range(6)]
        if i % 5 == 0:
            parts.insert(rng.randrange(6), rng.choice(bad) + "!")
        rows.append((i, " ".join(parts), "en", "s", 1))
    return spark.createDataFrame(rows, SCHEMA)


def test_toxicity_learns_and_locates(spark):
    docs = toxic_docs(spark)
    model = toxicity.fit_toxicity(docs, labels_of(spark))
    rows = toxicity.score_toxicity(docs, model, keep=["doc_id", "text"]).collect()
    assert {r["doc_id"] for r in rows if r["predicted"]} == {i for i in range(60) if i % 5 == 0}
    for r in rows:
        assert 0 <= r["score"] <= 1
        if r["predicted"]:
            best = max(r["offending"], key=lambda s: s["p"])
            assert re.search("blockhead|gloop", r["text"][best["start"] : best["end"]])


def test_toxicity_score_is_noisy_or(spark):
    model = toxicity.ToxicityModel({"=bad": 2.0, "^wor": 1.0}, -1.0, -4.0)
    texts = ["bad thing. fine. Worse", "worst", "nothing here", "", None, "bad\nbad"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(rows, model).collect()}
    p = lambda x: 1 / (1 + math.exp(-x))
    sentences = {0: [1.0, 0.0], 1: [0.0], 2: [], 3: [], 4: [], 5: [1.0, 1.0]}
    for k, logits in sentences.items():
        want = 1 - (1 - p(-4.0)) * math.prod(1 - p(x) for x in logits)
        assert got[k] == pytest.approx(want, rel=1e-9)


def test_toxicity_odd_rows(spark, odd, empty):
    model = toxicity.fit_toxicity(odd, labels_of(spark))
    assert toxicity.score_toxicity(odd, model).count() == odd.count()
    assert toxicity.fit_toxicity(empty, labels_of(spark)).weights == {}
    assert toxicity.score_toxicity(empty, model).count() == 0
    kept = toxicity.drop_toxic(clashing(odd), toxicity.ToxicityModel())
    assert kept.columns == clashing(odd).columns and kept.count() == odd.count()


# Exact dedup


def expected_groups(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    return groups


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, odd, weak):
    digest = (lambda text: F.substring(exact_dedup.sha256(text), 1, 1)) if weak else exact_dedup.sha256
    shown = exact_dedup.exact_groups(odd.select("doc_id", "text"), digest=digest).collect()
    groups = expected_groups(odd_rows())
    assert len(shown) == len(odd_rows())
    by_id = collections.defaultdict(list)
    for r in odd_rows():
        by_id[r[0]].append(low(r[1]))
    want = collections.Counter()
    for ids in groups.values():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, top, len(ids))] += 1
    assert collections.Counter((r["id"], r["keep_id"], r["group_size"]) for r in shown) == want
    assert sum(r["kept"] for r in shown) == len(groups)


def test_exact_state_goes_on(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(9, "a"), (4, "c")], "doc_id long, text string")
    folder = str(tmp_path / "state")
    exact_dedup.exact_groups(first, folder=folder).count()
    log, checkpoint = f"{folder}/log", f"{folder}/state"
    exact_dedup.append_arrivals(exact_dedup.located(second), log)
    exact_dedup.advance(spark, log, checkpoint)
    state = {(r["keep"]["id"], r["n"]) for r in exact_dedup.kept_state(spark, checkpoint).collect()}
    assert state == {(9, 3), (3, 1), (4, 1)}


def test_exact_drop(spark, odd, empty):
    docs = clashing(odd)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(expected_groups(odd_rows()))
    assert exact_dedup.drop_copies(empty).count() == 0
    assert exact_dedup.exact_groups(empty).count() == 0


# Personal data

EM = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(text):
    d = [int(c) for c in text[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0


def plain_spans(text):
    out = [(m.start(), 0, "email", m.end()) for m in EM.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_base_spans_as_the_forms_say():
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice("a@.-+1 2(9_b5)é") for _ in range(rng.randint(0, 40)))
        assert personal_data.base_spans(text) == plain_spans(text), text
    fixed = "write to a.b@c.co.uk or 10.0.0.255, pay 4111 1111 1111 1111, call +1 (555) 010-9999."
    assert personal_data.joined(personal_data.base_spans(fixed)) == personal_data.joined(plain_spans(fixed)) and len(plain_spans(fixed)) == 4


def test_long_runs_take_linear_time():
    assert personal_data.base_spans("1" * 300_000 + "." + "a" * 300_000) == []
    assert personal_data.base_spans("a" * 300_000 + "@") == []


def test_context_reveals_unseen_identifiers(spark, empty):
    rows = [(i, f"greetings, please call me at +1 555 010 {i:04d} any time", None, None, None) for i in range(9)]
    rows += [(50, "greetings, please call me at 555-010-7777 any time", None, None, None), (51, "it holds 555-010-7777 grains", None, None, None)]
    rows += [(60, "chapter 12 has 123-456-789 lines", None, None, None), (61, None, None, None, None), (62, "", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in personal_data.find_personal_data(docs).collect()}
    assert len(got) == len(rows)
    assert [tuple(s) for s in got[50]["added"]] == [("phone", 29, 41)]
    assert len(got[51]["added"]) == 1 and not got[60]["added"] and not got[61]["base"]
    assert all(len(got[i]["base"]) == 1 and not got[i]["added"] for i in range(9))
    assert personal_data.find_personal_data(empty).count() == 0


def test_personal_data_odd_rows(spark, odd):
    found = personal_data.find_personal_data(clashing(odd)).select("doc_id", personal_data.span_text(personal_data.ordered_spans(F.col("base"), F.col("added"))).alias("s"))
    assert found.count() == odd.count()


def test_found_values_lead_to_further_patterns(spark):
    number = lambda i: f"555-010-{i:04d}"
    # Three seeds and as many unseen values: two of them lead on to other patterns, round after round.
    rows = [f"hello please ring me on +1 555 010 {i:04d} before noon" for i in range(3)] + [f"hello please ring me on {number(i)} before noon" for i in range(3)]
    rows += [f"our front desk has {number(i)} all week" for i in range(6)] + [f"fax machine answers {number(i)} at night" for i in range(3, 8)]
    # As many addresses of machines as numbers: no pattern of phones.
    rows += [f"the log says +1 555 010 {i:04d} was seen" for i in range(3)] + [f"the log says 10.0.0.{i} was seen" for i in range(3)] + ["the log says 555-010-9999 was seen"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["added"]] for r in personal_data.find_personal_data(docs).collect()}
    for i, text in enumerate(rows):
        m = re.search("555-010-[0-9]{4}", text)
        assert got[i] == ([("phone", *m.span())] if m and m[0] != number(9999) else []), text


def test_identifiers_written_in_groups(spark):
    unseen = {"phone": ["555 010 7777", "0044 20 7946 0958", "(212) 555-0187", "[020] 7946 0958", "555-010-7777"], "card": ["4111 1111 1111 1112"]}
    rows = [f"please call me at +1 555 010 {i:04d} any time" for i in range(4)]
    rows += [f"please charge my card {n} right now" for n in ("4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004")]
    want = [[]] * len(rows)
    for kind, frame in (("phone", "please call me at {} any time"), ("card", "please charge my card {} right now")):
        for value in unseen[kind]:
            rows.append(frame.format(value))
            want.append([(kind, rows[-1].index(value), rows[-1].index(value) + len(value))])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["added"]] for r in personal_data.find_personal_data(docs).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_candidates_are_apart_and_take_linear_time():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("a@.-+1 2(9_b5)[] 34") for _ in range(rng.randint(0, 60)))
        base = personal_data.base_spans(text)
        found = [(c["start"], c["end"]) for c in personal_data._candidates(text, base)]
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:])) and not any(a < y and x < b for a, b in found for _, x, y in base)
    assert personal_data._candidates("1 " * 300_000, []) == [] and personal_data._candidates("(" * 300_000 + "1", []) == []


# Suffix tree


def test_base_scores(spark, odd):
    tree = suffix_tree.fit_suffix_tree(odd.where("doc_id % 3 <> 0"), local_words=40)
    rows = suffix_tree.score_texts(clashing(odd), tree, keep=["doc_id", "text"]).collect()
    count = collections.Counter()
    for doc_id, text, *_ in odd_rows():
        if doc_id is not None and doc_id % 3:
            count.update([*WORD.findall(low(text)), ""])
    n, v = sum(count.values()), len(count)
    assert (tree.tokens, tree.distinct, len(rows)) == (n, v, len(odd_rows()))
    for r in rows:
        tokens = [*WORD.findall(low(r["text"])), ""]
        want = sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        assert r["base_score"] == pytest.approx(want, abs=1e-6)
        assert (r["n_tokens"], r["n_known"]) == (len(tokens), sum(count[t] > 0 for t in tokens))


def test_states_are_distributions_and_help(spark):
    rng = random.Random(1)
    lines = []
    for _ in range(400):
        words = [rng.choice("ab")]
        while len(words) < 30:
            words.append({"a": "b", "b": "c"}.get(words[-1]) or rng.choice("abx"))
        lines.append(" ".join(words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    tree = suffix_tree.fit_suffix_tree(docs, least_share=1e-4)
    assert tree.states[0].kept.any()
    ids = np.arange(len(tree.frequent))
    counts = tree.counts[suffix_tree._find(tree.words, tree.frequent)]
    root = tree.root(counts)
    for context in np.flatnonzero(tree.states[0].kept):
        p = suffix_tree._mixed(tree, 1, np.full(len(ids), context), ids, root)
        unknown = suffix_tree._mixed(tree, 1, np.array([context]), np.array([-1]), np.array([tree.root(0)]))
        assert p.sum() + unknown[0] == pytest.approx(1, abs=1e-9)
    total = suffix_tree.score_texts(docs, tree).agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > 0.7 * total[1]


def test_suffix_tree_without_texts(spark, odd, empty):
    tree = suffix_tree.fit_suffix_tree(empty)
    assert tree.tokens == 0
    assert suffix_tree.score_texts(odd, tree).count() == odd.count()
    assert suffix_tree.score_texts(empty, tree).count() == 0


def plain_tree(texts, least=5, prior=20.0):
    """The tree of contexts of up to two words in plain Python: a function that scores a text."""
    seqs = [[*WORD.findall(low(t)), ""] for t in texts]
    count = collections.Counter(tuple(s[i : i + n]) for s in seqs for n in (1, 2, 3) for i in range(len(s) - n + 1))
    tokens, distinct = sum(map(len, seqs)), len({w for s in seqs for w in s})
    states = {}

    def prob(context, word):
        p = (count[(word,)] + 0.1) / (tokens + 0.1 * (distinct + 1))
        for c in (context[len(context) - k :] for k in range(1, len(context) + 1)):
            if c in states:
                n = count[(*c, word)]
                p = ((n if n >= least else 0) + states[c] * p) / (count[c] + prior)
        return p

    for length in (1, 2):
        follow = collections.defaultdict(dict)
        for s, n in count.items():
            if len(s) == length + 1 and n >= least:
                follow[s[:-1]][s[-1]] = n
        new = {}
        for c, nexts in follow.items():
            lower = {w: prob(c[1:], w) for w in nexts}
            rest, other = 1 - sum(nexts.values()) / count[c], max(1 - sum(lower.values()), 1e-12)
            gain = sum(n / count[c] * math.log(n / count[c] / lower[w]) for w, n in nexts.items()) + (rest * math.log(rest / other) if rest > 0 else 0)
            if count[c] * gain > 0.5 * len(nexts) * math.log(max(count[c], 2)):
                new[c] = rest * count[c] + prior
        states |= new
    score = lambda t: sum(math.log10(prob(tuple(s[max(0, i - 2) : i]), w)) for s in [[*WORD.findall(low(t)), ""]] for i, w in enumerate(s))
    return score, [sum(len(c) == n for c in states) for n in (1, 2)]


def test_rare_strings_count_in_large_corpora(spark):
    rng = random.Random(6)
    common = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    # Each phrase stands 8 times among 700,000 tokens: a share of 1e-5.
    texts = [" ".join(rng.choice(common) for _ in range(1700)) + f" rare{i % 50} north{i % 7} wind{i % 50} end{i % 50}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    asked = spark.createDataFrame([(i, f"rare{i} north{i % 7} wind{i} end{i} rare{i} unheard") for i in range(50)] + [(99, None)], "doc_id long, text string")
    score, sizes = plain_tree(texts)
    assert min(sizes) >= 50
    for options in ({}, {"local_strings": 60, "local_words": 20}, {"local_strings": 0, "local_words": 0}):
        tree = suffix_tree.fit_suffix_tree(docs, **options)
        assert [t[0].count() for t in tree.tables] == sizes
        for r in suffix_tree.score_texts(asked, tree, keep=["doc_id", "text"]).collect():
            assert r["score"] == pytest.approx(score(r["text"]), abs=1e-6)


# Wrapper induction


def test_pages(spark):
    def page(i, body):
        return (
            f"<html><head><title>t{i}</title><script>var a='</p>';</script></head><body><header>Site {i}</header><nav><ul><li><a href=x>menu {i}</a></ul></nav>"
            f"<div class='cookie-notice'>we use {i}</div><main><article><h1>Title {i}</h1><div>Printed by Example Press</div>{body}<div class='comments'><p>first! {i}</p></div></article></main>"
            f"<aside>related {i}</aside><form><input name=q><button>go {i}</button></form><footer>&copy; {i}</footer></body></html>"
        )

    bodies = [f"<p>It was &amp; remains   {i} <b>bold</b>ly<br>so<p>second\n{i}<ul><li>point {i}</ul>" for i in range(12)]
    rows = [(i, f"https://h.example/{i}", page(i, b)) for i, b in enumerate(bodies)]
    rows += [(90, None, None), (91, "https://h.example/x", ""), (92, "odd", "<p>loose <i>text</i> <"), (93, "http://one.example/", "<div><p>Alone here<p>and more</div>"), (None, None, "<table><tr><td>" + "deep" * 3)]
    rows += [(94, "http://deep.example/", "<div>" * 3000 + "low" + "</div>" * 3000)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"Title {i} It was & remains {i} boldly so second {i} point {i}"
    assert (got[90], got[91], got[92], got[93], got[None], got[94]) == ("", "", "loose text <", "Alone here and more", "deepdeepdeep", "low")
    assert wrapper.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_layout_boxes_and_link_lists_stay():
    text = lambda page: wrapper.main_text(wrapper.parse(page), set())
    article = "<article><h1>Head</h1><p>Body text</p><ul><li><a href=x>First source</a><li><a href=y>Second source</a></ul></article>"
    for box in ("post has-sidebar", "layout no-sidebar", "site-content share-enabled", "sidebar", "page has-header", "social"):
        assert text(f"<body><div class='{box}'>{article}</div></body>") == "Head Body text First source Second source", box
    assert text(f"<form><div>{article}</div></form>") == "Head Body text First source Second source"
    assert text("<main><div class='post has-comments'>Body</div><div class='cookie-notice'>no</div><div class='related'><article>card</article></div></main>") == "Body"
    assert text("<div class=related><article>card</article></div><main>Body</main>") == "Body"


def test_given_pages_are_whole(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        bare = re.sub(r"<[^>]*(>|\Z)", " ", re.sub(r"</?b>", "", body))
        assert got[r["page_id"]] == " ".join(html.unescape(bare).split())


def test_alignment_finds_the_largest_matching():
    a, b = wrapper.parse("<div><h1>x</h1><p>1<p>2<span>s</span></div>"), wrapper.parse("<div><p>1<em>q</em><p>2<p>3<span>s</span></div>")
    pairs = [(x.tag, y.tag) for x, y in wrapper.align(a, b)]
    assert sorted(pairs) == sorted([("#page", "#page"), ("div", "div"), ("p", "p"), ("p", "p"), ("span", "span")]) or len(pairs) >= 4


# Mixing


def test_targets_fill_up_to_their_limits(spark):
    sizes = {"a": 10, "b": 500, "c": 300, "d": 1000, None: 40, "e": 0}
    sized = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    order = sorted((k for k in sizes if k is not None)) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = {k for k in free if share[k] > 3 * sizes[k]}
        if not over:
            target |= share
            break
        target |= {k: 3.0 * sizes[k] for k in over}
        left -= sum(3.0 * sizes[k] for k in over)
        free -= over
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in target.items()}


def test_mix_meets_targets(spark, odd):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(1, 200)), None, f"s{rng.choice('aaaabc')}", None) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted(got) == sorted(again) and len(got) == len(rows)
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in got:
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 0.02 * target[s] + 200 for s in target)
    shown = mixing.mix_sources(clashing(odd)).collect()
    assert len(shown) == len(odd_rows())
    assert sum(r["size"] for r in shown) == sum(len(WORD.findall(t or "")) for _, t, *_ in odd_rows())


def test_rounding_keeps_expectations(spark):
    rows = [(i, " ".join(["w"] * 10), None, "a", None) for i in range(60)] + [(100 + i, "w " * 10, None, "b", None) for i in range(140)]
    docs = spark.createDataFrame(rows, SCHEMA)
    tries = [{r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs, seed=s).where("source = 'a'").collect()} for s in (1, 2, 3)]
    # The number of copies is the expected one, rounded either way; which documents are taken changes.
    want = 5 / 7 * 2000 / 10
    assert all(abs(sum(t.values()) - min(want, 180)) <= 1 for t in tries)


def test_mixed_rows(spark, odd, empty):
    docs = clashing(odd)
    chosen = collections.Counter()
    for r in mixing.mix_sources(docs).collect():
        chosen[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    found = collections.Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in rows.select("doc_id", "source", "text").collect())
    assert found == +chosen
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


# N-gram Jaccard join


def shingle_sets(rows):
    out = []
    for _, text, *_ in rows:
        words = WORD.findall(low(text))
        out.append(frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    return out


def plain_links(rows):
    sets = shingle_sets(rows)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    return links, [find(x) for x in range(len(rows))]


def test_near_duplicates(spark, odd, empty):
    rows = odd_rows()
    links, roots = plain_links(rows)
    got = jaccard_join.near_duplicates(clashing(odd)).collect()
    assert collections.Counter((r["id"], r["n_links"]) for r in got) == collections.Counter((r[0], n) for r, n in zip(rows, links))
    assert sum(r["stays"] for r in got) == len(set(roots))
    kept = jaccard_join.keep_one(clashing(odd))
    assert kept.columns == clashing(odd).columns and kept.count() == len(set(roots))
    assert jaccard_join.near_duplicates(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0


def test_blocks_lose_no_link(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own), None, None, None))
    links, roots = plain_links(rows)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 20)
    got = {r["id"]: r for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i]["n_links"] for i in range(150)] == links
    assert len({got[i]["group_id"] for i in range(150)}) == len(set(roots))


def test_pruning_is_by_the_posterior():
    need = jaccard_join.least_matches(0.8, 1e-6)
    for n, m in need.items():
        tail = lambda k: sum(math.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(k + 1))  # noqa: B023, E731
        assert tail(m) >= 1e-6 and (m == 0 or tail(m - 1) < 1e-6)


# SimHash


def plain_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def test_edited_texts(spark):
    rows = [r for r in odd_rows() if r[0] is not None and r[0] < 307]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["id"]: r for r in simhash.compare_edited(clashing(docs)).collect()}
    order = plain_order(rows)
    assert len(got) == len(rows)
    prints = {i: int(r["fingerprint"], 16) for i, r in got.items()}
    for here, after in zip(order, order[1:] + order[:1]):
        text, r = here[1] or "", got[here[0]]
        third = len(text) // 3
        edited = text[: len(text) - third] + (after[1] or "")[:third]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        gap = (int(r["fingerprint"], 16) ^ int(got[after[0]]["fingerprint"], 16)).bit_count()
        assert r["near_next"] == pytest.approx(1 - gap / 64)
        assert r["n_near"] == sum((prints[here[0]] ^ p).bit_count() <= 3 for p in prints.values()) - 1
    assert len({got[i]["fingerprint"] for i in range(200, 209)} | {got[3]["fingerprint"]}) == 1


def test_neighbours_across_buckets(spark, odd):
    rows = [r for r in odd_rows() if r[0] is not None and r[0] < 307]
    order = plain_order(rows)
    for size in (500, 5000, 1 << 30):
        got = {r["id"]: r for r in simhash.with_successors(spark.createDataFrame(rows, SCHEMA).repartition(3), bucket_bytes=size).collect()}
        assert len(got) == len(rows)
        for here, after in zip(order, order[1:] + order[:1]):
            text = here[1] or ""
            third = len(text) // 3
            assert got[here[0]]["edited"] == text[: len(text) - third] + (after[1] or "")[:third]
            assert got[here[0]]["next_at"] == got[after[0]]["at"]
    # NULL and repeated identifiers are in the ring too.
    ring = {r["at"]: r["next_at"] for r in simhash.with_successors(odd, bucket_bytes=3000).collect()}
    at, seen = next(iter(ring)), set()
    while at not in seen:
        seen.add(at)
        at = ring[at]
    assert len(seen) == len(odd_rows())


def test_fingerprints_count_votes(spark):
    texts = ["a bb ccc dddd a bb", "word", "x " * 5000 + "longest words here"]
    terms = [(a, b) for t in texts for w in [t.split()] for a, b in zip(w, [*w[1:], ""])]
    table = spark.createDataFrame(sorted(set(terms)), "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    hashed = {(r["a"], r["b"]): r["h"] & (2**64 - 1) for r in table}
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r["k"]: r["fingerprint"] & (2**64 - 1) for r in simhash.fingerprints(docs, ["k"]).collect()}
    for k, t in enumerate(texts):
        w = t.split()
        votes = [0] * 64
        for a, b in zip(w, [*w[1:], ""]):
            weight = min(3, 1 + (len(a) + len(b)) // 6)
            for i in range(64):
                votes[i] += weight if hashed[a, b] >> i & 1 else -weight
        assert got[k] == sum(1 << i for i in range(64) if votes[i] > 0)


@pytest.mark.parametrize("radius, blocks", [(3, 6), (2, 4), (0, 3), (6, 8)])
def test_block_tables_find_all(spark, radius, blocks):
    rng = random.Random(radius)
    values = [rng.getrandbits(64) for _ in range(20)]
    for v in list(values):
        for _ in range(5):
            for _ in range(rng.randint(0, radius + 1)):
                v ^= 1 << rng.randrange(64)
            values.append(v)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    found = simhash.hamming_neighbours(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), radius, blocks).collect()
    got = {r["fingerprint"] & (2**64 - 1): r["n_near"] for r in found}
    for v in set(values):
        assert got.get(v, 0) == sum(0 < (v ^ w).bit_count() <= radius for w in values)


def test_simhash_odd_rows(spark, odd, empty):
    assert simhash.compare_edited(odd).count() == odd.count()
    assert simhash.compare_edited(empty).count() == 0
    one = simhash.compare_edited(spark.createDataFrame([(1, "only one text", None, None, None)], SCHEMA)).collect()
    assert one[0]["near_next"] == 1.0


# Packing


def test_pieces_and_places(spark, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.tokenized_pieces(clashing(odd), path, capacity=256)
    rows = packing.pack(pieces, capacity=256).collect()
    want = collections.Counter()
    for doc_id, text, *_ in odd_rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 256):
            cut = np.array(ids[k : k + 256], "<u4")
            want[(doc_id, k // 256, k, len(cut), zlib.crc32(cut.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(bins) == set(range(len(bins)))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(packing.tokenized_pieces(empty, path)).count() == 0


def test_encoder_is_the_tokenizer():
    path = queries.tokenizer_path()
    encoder = packing.Encoder(path)
    texts = ["It's I'LL 12.5 É́ Σ İx ..., a.,, b.. c", "a b <|startoftext|> x\x0by\x1cz  ", "<|STARTOFTEXT|> A", "", None, "x y z naïve.", "end.", "don't.'s"]
    flat, ends = encoder.ids(pa.array(texts))
    begin = [0, *ends[:-1]]
    for t, a, b in zip(texts, begin, ends):
        assert list(flat[a:b]) == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_two_for_one_fills_better():
    # Greedy puts 60 + 35; giving 35 up for 20 + 20 fills the bin.
    patterns = packing.best_two_fit({60: 1, 35: 1, 20: 2}, 100)
    assert patterns[0] == ((60, 20, 20), 1)
    rng = random.Random(6)
    counts = collections.Counter(rng.randint(1, 400) for _ in range(5000))
    used = collections.Counter()
    for lengths, times in packing.best_two_fit(dict(counts), 400):
        assert sum(lengths) <= 400
        for n in lengths:
            used[n] += times
    assert used == counts


# Sharding


def test_shards(spark, odd, empty):
    rows = sharding.shuffle_into_shards(odd.select("doc_id", "text"), ["doc_id"], shards=7).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sorted(len(v) for v in by.values()) == sorted(len(odd_rows()) // 7 + (j < len(odd_rows()) % 7) for j in range(7))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r[0] for r in odd_rows())
    assert sharding.shuffle_into_shards(empty, ["doc_id"]).count() == 0


def test_matrix_has_exact_margins_and_the_right_law():
    total = np.zeros((3, 4))
    for seed in range(400):
        m = np.array(sharding.communication_matrix([50, 10, 33], 4, seed))
        assert list(m.sum(1)) == [50, 10, 33] and sorted(m.sum(0)) == [23, 23, 23, 24]
        total += m
    want = np.outer([50, 10, 33], [24, 23, 23, 23]) / 93
    assert np.abs(total / 400 - want).max() < 0.5
    rng = random.Random(0)
    draws = [sharding.hypergeometric(rng, 30, 50, 20) for _ in range(4000)]
    p = 30 / 80
    assert np.mean(draws) == pytest.approx(20 * p, abs=0.15)
    assert np.var(draws) == pytest.approx(20 * p * (1 - p) * 60 / 79, rel=0.1)
    assert sharding.hypergeometric(rng, 10**12, 3 * 10**12, 10**6) == pytest.approx(250_000, rel=0.02)


# Pipeline


def stage_inputs(spark, tmp_path, odd):
    path = str(tmp_path / "sf")
    labels_of(spark).write.parquet(f"{path}/labels.parquet")
    clashing(odd).write.parquet(f"{path}/documents.parquet")
    odd.where("false").write.parquet(f"{path}/none.parquet")
    return path


def test_stages_keep_columns_and_rows(spark, tmp_path, odd):
    path = stage_inputs(spark, tmp_path, odd)
    for name in ("documents", "none"):
        docs = spark.read.parquet(f"{path}/{name}.parquet")
        for k, (stage, run) in enumerate(corpus_pipeline.STAGES):
            out = run(spark, docs, path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, stage
            out.write.parquet(f"{path}/{name}-{stage}")
            docs = spark.read.parquet(f"{path}/{name}-{stage}")
        assert (docs.count() > 0) == (name == "documents")


def test_pipeline_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for stage, run in corpus_pipeline.STAGES[1:3]:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        kept = {r["doc_id"] for r in run(spark, docs, SF_DIR).collect()}
        if stage == "exact_dedup":
            assert kept == {max(ids) for ids in expected_groups(before).values()}
        else:
            groups = collections.defaultdict(list)
            for (doc_id, _), root in zip(before, plain_links(before)[1]):
                groups[root].append(doc_id)
            assert kept == {min(v) for v in groups.values()}


def test_tokens_are_what_lies_between_spaces():
    texts = ["  A b\x0bC\x1cd\x0c\n", "", None, "É x Y"]
    codes, rows, words = token_codes(pa.array(texts))
    got = collections.defaultdict(list)
    for c, r in zip(codes, rows):
        got[int(r)].append(words[int(c)].as_py())
    assert [got[i] for i in range(4)] == [WORD.findall(low(t)) for t in texts]
