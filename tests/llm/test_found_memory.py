"""Findings of round 3 on the memory of the pipeline's workers."""

from __future__ import annotations

import os
import subprocess
import sys

import pyarrow as pa

from latticeframe.llm import packing, queries, text, toxicity

COUNT = """
import random, resource
import numpy as np, pyarrow as pa
from latticeframe.llm import toxicity
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(60_000)]
texts = pa.array([" ".join(rng.choices(words, k=200)) for _ in range(2000)])
batch = pa.RecordBatch.from_arrays([texts, pa.array(np.arange(2000) % 2)], ["text", "toxic"])
del words
toxicity._tokens(texts)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(int(r.column("hot").to_numpy().sum()) for r in toxicity._count_features(iter([batch])))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_features_are_counted_in_little_memory():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    ran = subprocess.run([sys.executable, "-c", COUNT], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True)
    n, peak = map(int, ran.stdout.split())
    assert n > 100_000
    assert peak < 100


def test_features_of_all_tokens_at_once():
    tokens = ["", "...", "a", "abc", "abcd", "(abcdefgh)", "ééééx!", "\U0001f600\U0001f601ab", "\x00", "-x-y-", "abc"]
    found = [[k for k in kinds if k is not None] for kinds in zip(*(x.to_pylist() for x in toxicity._kinds(pa.array(tokens))))]
    assert found == [toxicity._features(t) for t in tokens]
    index = {"^abc": 0, "=abc": 1, "^ééé": 2}
    sizes, begin, flat = toxicity._token_features(pa.array(tokens), index)
    assert [list(flat[b : b + n]) for b, n in zip(begin, sizes)] == [[index[f] for f in toxicity._features(t) if f in index] for t in tokens]


def test_other_operators_drop_a_workers_encoder(spark):
    path = queries.tokenizer_path()

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([packing.kept_encoder.cache_info().currsize])})

    def encoded(batches):
        packing.kept_encoder(path).ids(pa.array(["alpha beta"]))
        yield from held(batches)

    rows = spark.range(0, 16, 1, 16)
    assert {r["n"] for r in rows.mapInArrow(encoded, "n long").collect()} == {1}
    assert {r["n"] for r in rows.mapInArrow(text.frugal(held), "n long").collect()} == {0}
