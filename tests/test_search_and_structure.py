"""Search over many materials, file names, vocabularies, long structure files and learned models against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeframe.operators import clustering as cl
from latticeframe.operators import joins as jn
from latticeframe.operators import similarity as sim
from latticeframe.operators import vectors as vec
from latticeframe.operators import vocabulary as vocab
from latticeframe.sources import poscar

MATERIAL = (
    "id long, " + ", ".join(f"{n} int" for n in ("Z2", "Z2w_1", "Z2w_2", "Z2w_3", "Z4", "Z4pi", "Z8", "space_group", "ebr_class", "fragile_bands_count"))
    + ", soc_enabled double, smallest_gap double, topological_type string, topological_subtype string, "
    + ", ".join(f"lattice_{n} double" for n in ("a", "b", "c", "alpha", "beta", "gamma"))
)


def materials(seed, n):
    rng = random.Random(seed)
    some = lambda *values: rng.choice(values)
    rows = []
    for i in range(n):
        base = rows[rng.randrange(len(rows))][1:] if rows and rng.random() < 0.5 else None
        row = [some(0, 1, None), some(0, 1), some(0, 1), some(0, 1, None), some(0, 1, 2, 3), some(0, 1, None), some(0, 3, 7), some(2, 12, 15, 166, 225, None), some(0, 1, 2), some(0, 1, 2, None)]
        row += [some(0.0, 1.0), some(0.0, 0.1, 0.12, 1.5, None), some("TI", "SM", "", None), some("a", "b", "")]
        row += [some(3.0, 3.1, 5.0, 9.0, None) for _ in range(3)] + [some(90.0, 91.0, 120.0) for _ in range(3)]
        rows.append((i, *[b if base and rng.random() < 0.8 else v for b, v in zip(base or row, row)]))
    return rows


def agree(got, df, single):
    want = {}
    for r in df.select("id").collect():
        for x in single(r.id).collect():
            want[r.id, x.id] = tuple(x)[1:]
    assert got == want and want


@pytest.mark.parametrize("threshold", [0.7, 0.9])
def test_analogues_of_all_as_one_by_one(spark, threshold):
    df = spark.createDataFrame(materials(1, 45), MATERIAL).cache()
    pairs = sim.analogue_pairs(df, "id", sim.MATERIAL_SPEC, threshold).collect()
    assert len(pairs) == len({(r.id, r.other) for r in pairs})
    agree({(r.id, r.other): (r.similarity,) for r in pairs}, df, lambda i: sim.topological_analogues(df, "id", i, sim.MATERIAL_SPEC, threshold).select("id", "similarity"))
    asked = df.where("id < 3")
    some = {(r.id, r.other) for r in sim.analogue_pairs(df, "id", sim.MATERIAL_SPEC, threshold, asked).collect()}
    assert some == {(r.id, r.other) for r in pairs if r.id < 3}


@pytest.mark.parametrize("threshold", [0.6, 0.95])
def test_transitions_of_all_as_one_by_one(spark, threshold):
    df = spark.createDataFrame(materials(2, 40), MATERIAL).cache()
    names = ["Z2", "Z4", "Z8"]
    pairs = sim.transition_pairs(df, "id", sim.MATERIAL_SPEC, names, threshold).collect()
    assert len(pairs) == len({(r.id, r.other) for r in pairs})
    got = {(r.id, r.other): (r.structural_similarity, r.shared_count) for r in pairs}
    agree(got, df, lambda i: sim.transition_candidates(df, "id", i, sim.MATERIAL_SPEC, names, threshold).select("id", "structural_similarity", "shared_count"))


def test_a_threshold_that_needs_no_common_value_is_refused(spark):
    df = spark.createDataFrame(materials(3, 5), MATERIAL)
    with pytest.raises(ValueError):
        sim.analogue_pairs(df, "id", sim.MATERIAL_SPEC, 0.05)


def test_file_names_by_substring(spark):
    rng = random.Random(4)
    ids = [f"J-{n}" for n in (1, 12, 123, 7)] + ["", None]
    formulas = ["C", "SiO2", "O", "POSCAR", "A_b", None, "LongFormulaName12"]
    mats = [(f"m{k}" if i is None else i, f) for k, (i, f) in enumerate(itertools.product(ids, formulas))]
    mats = list({m[0]: m for m in [(f"{i}{'' if f is None else ''}x{k}" if i else "", f) for k, (i, f) in enumerate(mats)]}.values())
    parts = ["POSCAR", "_", ".vasp", *[m[0] for m in mats if m[0]], *[f for f in formulas if f], "x"]
    files = [("".join(rng.choice(parts) for _ in range(rng.randint(1, 5))), rng.randrange(3)) for _ in range(300)]
    files = [("d/" * d + b, b, d) for b, d in files]
    df = spark.createDataFrame(mats, "material_id string, formula string")
    got = {r.material_id: (r.path, r.pattern_rank) for r in jn.ranked_file_match(df, spark.createDataFrame(files, "path string, base string, depth int")).collect()}

    def after(base, word, start):
        at = base.find(word, start)
        return at + len(word) if at >= 0 else None

    want = {}
    for mid, formula in mats:
        hits = []
        for path, base, depth in files:
            ranks = []
            for word, first, trailing in ((mid, 1, 3), (formula, 2, 4)):
                if not word:
                    continue
                end = after(base, word, 0)
                if end is not None and base.find("POSCAR", end) >= 0:
                    ranks.append(0 if first == 1 and base.startswith(word) else first)
                if base.startswith("POSCAR") and base.find(word, 6) >= 0:
                    ranks.append(trailing)
            if ranks:
                hits.append((min(depth, 1), min(ranks), path))
        if hits:
            want[mid] = (min(hits)[2], min(hits)[1])
    assert got == want and len(want) > 5


def test_vocabulary_keeps_indexes(spark, tmp_path):
    store = str(tmp_path / "v")
    runs = [[("k", "b"), ("k", "d"), ("b", "x"), ("k", None)], [("k", "a"), ("k", "b"), ("n", "q"), (None, "z")], [("k", "d")], [("k", "c"), ("k", "a")]]
    for facts in runs:
        held = vocab.append_labels(spark, store, spark.createDataFrame(facts, "kind string, label string"))
    got = {(r.kind, r.label): (r.idx, r.version) for r in held.collect()}
    assert got == {("k", "b"): (0, 1), ("k", "d"): (1, 1), ("b", "x"): (0, 1), ("k", "a"): (2, 2), ("n", "q"): (0, 2), ("k", "c"): (3, 3)}
    coded = vocab.codes(spark.createDataFrame([(1, "k", "c"), (1, "k", "b"), (2, "k", "unseen"), (2, "k", "d")], "id int, kind string, label string"), ["id"], held)
    assert {(r.id, tuple(r.indexes), r.size) for r in coded.collect()} == {(1, (0, 3), 4), (2, (1,), 4)}


def test_long_files_read_like_texts(spark, tmp_path):
    rng = random.Random(5)

    def structure(i):
        n = rng.randint(1, 4)
        flags = rng.random() < 0.5
        lines = [f"s {i}", "1.0", "2 0 0", "0 3 0", "0 0 4", "Na Cl", f"{n} 1"] + (["Selective dynamics"] if flags else []) + [rng.choice(["Direct", "Cartesian"])]
        return "\n".join(lines + [f"{k} 0 0{' T F T' if flags else ''}" for k in range(n + 1)]) + "\n" * rng.choice([1, 1, 2, 3])

    texts = {f"f{k}.vasp": "".join(structure(i) for i in range(n)) for k, n in enumerate((1, 5, 300))} | {"e.vasp": "\n \n", "cut.vasp": structure(0) + "tail\n1.0\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = poscar.read_structures(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    df = spark.createDataFrame(list(texts.items()), "name string, value string")
    shown = lambda r: (r.structure_idx, r.comment, r.formula, r.direct, str(r.positions))
    want = {(r.name, *shown(r)) for r in poscar.split_structures(df).collect()}
    assert {(r.file.rsplit("/", 1)[1], *shown(r)) for r in got} == want and len(got) == len(want) == 307


def test_projection_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12)) * np.linspace(1, 6, 12) @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + 5
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>").repartition(4)
    got = np.array([[r.x, r.y] for r in sorted(cl.projected(df, "id", "v").collect(), key=lambda r: r.id)])
    axes = np.linalg.svd(x - x.mean(0))[2][:2]
    want = x @ axes.T
    signs = np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])
    assert np.allclose(got, want * signs, atol=1e-6)


def test_codebook_is_lloyds(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 3)) + c for c in ((0, 0, 0), (6, 0, 0), (0, 9, 0))])
    rng.shuffle(x)
    df = spark.createDataFrame([(i, i % 2, [float(v) for v in row]) for i, row in enumerate(x)] + [(999, 0, None)], "id long, c int, v array<double>").repartition(3)
    book = x[:5].copy()
    for _ in range(6):
        word = ((x[:, None] - book[None]) ** 2).sum(-1).argmin(1)
        book = np.array([x[word == k].mean(0) if (word == k).any() else book[k] for k in range(5)])
    got = vec.learned_codebook(df, "v", "id", 5, 6)
    assert np.allclose(got, book)
    word = ((x[:, None] - book[None]) ** 2).sum(-1).argmin(1)
    shares = {(r.c, r.word): r.share for r in vec.bag_of_words(df, "c", "v", got).collect()}
    for c in (0, 1):
        counts = np.bincount(word[np.arange(len(x)) % 2 == c], minlength=5)
        assert all(shares.get((c, k), 0) == pytest.approx(counts[k] / counts.sum()) for k in range(5))


def test_states_merge_to_whole_clouds(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 4)) * [1, 2, 3, 4] + [0, 5, 0, -3]
    x[:, 3] = 2.0
    df = spark.createDataFrame([("ab"[i % 2], [float(v) for v in row]) for i, row in enumerate(x)] + [("a", None), (None, [1.0] * 4)], "c string, v array<double>").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        rows = vec.vectorize_clouds(df, "c", "v", 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {}
    for r in rows:
        got.setdefault((r.c, r.method), {})[r.pos] = r.value
    for k, c in enumerate("ab"):
        y = x[k::2]
        d = y - y.mean(0)
        moments = [np.zeros(4), *[(d**p).mean(0) for p in (2, 3, 4)]]
        flat = lambda parts: dict(enumerate(np.concatenate(parts)))
        assert got[c, "moment"] == pytest.approx(flat(moments), abs=1e-9)
        pool = [y.mean(0), y.max(0), y.min(0), np.median(y, 0), np.sqrt((y**2).sum(0)), y.max(0) - y.min(0)]
        assert got[c, "pool"] == pytest.approx(flat(pool))
        values = np.sort(np.linalg.eigvalsh(np.cov(y.T, bias=True)))[::-1]
        assert got[c, "pca"] == pytest.approx(flat([np.zeros(3), np.sqrt(np.clip(values[:3], 0, None)), values[:3] / values.sum()]), abs=1e-6)
        hist = [np.histogram(y[:, j], 10, density=True)[0] for j in range(4)] + [np.histogram(y, 10, density=True)[0]]
        assert got[c, "histogram"] == pytest.approx(flat(hist), abs=1e-9)
        m2 = moments[1][:3]
        assert [got[c, "statistical"][24 + 2 * j] for j in range(3)] == pytest.approx(list(moments[2][:3] / m2**1.5))
        assert got[c, "statistical"][20] == pytest.approx(y.mean())
    assert (None, "pool") in got


def test_substrings_need_no_pairs(spark):
    # The index is linear in the names: terms of any number meet it by equality.
    df = spark.range(500).select(F.concat(F.lit("id-"), "id").alias("material_id"), F.lit("zz").alias("formula"))
    files = spark.range(500).select(F.concat(F.lit("x_id-"), "id", F.lit("_POSCAR")).alias("base"), F.lit(0).alias("depth")).withColumn("path", F.col("base"))
    found = {r.material_id: r.path for r in jn.ranked_file_match(df, files).collect()}
    assert found["id-499"] == "x_id-499_POSCAR" and found["id-4"] == "x_id-400_POSCAR" and len(found) == 500
