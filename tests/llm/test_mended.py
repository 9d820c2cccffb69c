"""Cases that earlier versions of the operators got wrong."""

import collections

import pytest
from pyspark.sql import functions as F
from test_llm_operators import SCHEMA, labels_of, odd_rows

import corpus_pipeline
from latticeframe.llm import exact_dedup, suffix_tree, toxicity, wrapper


def test_exact_groups_over_three_runs(spark, tmp_path):
    """A digest of no use at all: every text has to be told apart by its bytes, those of earlier runs too."""
    runs = [[(1, "aa"), (2, "b")], [(3, "BB"), (4, "AA"), (5, None)], [(6, "cc"), (7, "dd"), (8, "aa")]]
    folder = str(tmp_path / "state")
    weak = lambda text: F.lit(b"x")
    for n in range(3):
        got = exact_dedup.exact_groups(spark.createDataFrame(runs[n], "doc_id long, text string"), folder=folder, digest=weak).collect()
        groups = collections.defaultdict(list)
        for i, text in [r for run in runs[: n + 1] for r in run]:
            groups[(text or "").lower()].append(i)
        want = {(i, max(ids), len(ids), i == max(ids)) for ids in groups.values() for i in ids}
        assert {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == want


def text_of(page):
    return wrapper.main_text(wrapper.parse(page), set())


@pytest.mark.parametrize("attribute", ["style='overflow:hidden'", "aria-hidden='false'", "title='the hidden truth'", "data-id=search", "class=notice", "data-class='ad'"])
def test_paragraphs_of_the_article_stay(attribute):
    assert text_of(f"<article><h1>Head</h1><p {attribute}>Kept.</p><p>End.</p></article>") == "Head Kept. End."


def test_hidden_and_other_boxes_go():
    assert text_of("<article><p>A</p><div class='ad'>x</div><div hidden>y</div><p hidden>z</p><aside>n</aside></article>") == "A"


def test_all_articles_are_kept():
    assert text_of("<article><p>One</p></article><nav>no</nav><article><p>Two, which is longer</p></article>") == "One Two, which is longer"
    assert text_of("<div class=content>One<div class=content>in</div></div><div class=content>Two</div>") == "One in Two"


def test_very_deep_pages_are_read():
    n = 60_000
    assert text_of("<div>" * n + "low" + "</div>" * n + "<p>after</p>") == "low after"
    assert text_of("<b>" * n + "low") == "low"


def test_constants_beside_optional_blocks_go(spark):
    """Neutral tags and no names: only the alignment of a host's pages can tell."""
    def page(i):
        extra = f"<div>Update {i} of today</div>" if i % 10 < 7 else ""
        return f"<body><div>Home</div><div><div>Story {i} begins</div>{extra}<div>Printed by X</div><div>Line {i * 7} ends</div></div><div>All rights reserved</div></body>"

    rows = [(i, "http://n.example/p", page(i)) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        assert "Printed" not in got[i] and "Home" not in got[i] and "rights" not in got[i]
        assert f"Story {i} begins" in got[i] and f"Line {i * 7} ends" in got[i]


def test_stages_take_any_columns(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    odd = docs.select(
        "*", F.struct(F.lit(1).alias("a-b"), F.lit("x").alias("c d")).alias("s"), F.array(F.lit(1)).alias("dotted.name"), F.create_map(F.lit("k"), F.lit(2)).alias("männlich")
    )
    kept = toxicity.drop_toxic(odd, toxicity.fit_toxicity(docs, labels_of(spark)))
    assert kept.columns == odd.columns
    labels_of(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, str(tmp_path))
        assert odd.columns == kept.columns, name
        folder = str(tmp_path / name)
        odd.select(*[F.col(f"`{c}`") for c in odd.columns]).write.parquet(folder)
        odd = spark.read.parquet(folder)
    assert corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path)).count() > 0


def test_tree_grows_while_contexts_tell_something(spark):
    """The next word follows from the four words before it and from no fewer."""
    import itertools
    import random

    rng = random.Random(3)
    rule = {c: rng.choice("xyz") for c in itertools.product("ab", repeat=4)}
    rows = []
    for i in range(400):
        c = [rng.choice("ab") for _ in range(4)]
        rows.append((i, " ".join([*c, rule[tuple(c)]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grown, cut = suffix_tree.fit_suffix_tree(docs), suffix_tree.fit_suffix_tree(docs, depth=2)
    assert len(grown.tables) >= 4 and len(cut.tables) == 2
    total = lambda tree: suffix_tree.score_texts(docs, tree).agg(F.sum("score")).first()[0]
    assert total(grown) > total(cut) + 10
