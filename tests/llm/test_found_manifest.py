"""Cases of the third round's findings on the training-data operators; earlier versions fail them."""

import numpy as np
import pyarrow as pa

from latticeframe.llm import manifest


def test_manifest_folds_untouched_leaves(spark, monkeypatch):
    """An untouched row's leaf is folded too: with a spoilt fold it must not come out as the block's own node."""
    table = pa.table({"key": [0, 1], "grp": ["s", "s"], "idx": [0, 1], "n": [2, 2], "digest": [bytes(32), b"\x01" * 32], "changed": [bytes(32), b"\x01" * 32]})
    made = manifest._prove(table)
    assert made["folded"].to_pylist() == made["top"].to_pylist()
    fold = manifest._Level.refold
    monkeypatch.setattr(manifest._Level, "refold", lambda self, node, value: fold(self, node, value) ^ np.uint32(1))
    made = manifest._prove(table)
    assert all(f != t for f, t in zip(made["folded"].to_pylist(), made["top"].to_pylist()))
    monkeypatch.undo()
    docs = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2]) for i in range(9)], "doc_id long, text string, source string")
    kept = []
    prove = manifest._in_blocks
    monkeypatch.setattr(manifest, "_in_blocks", lambda nodes, run, *a: kept.append(prove(nodes, run, *a)) or kept[-1])
    got = manifest.dataset_manifest(docs).collect()
    assert len(got) == 9 and all(r.verified and r.folded_root == r.root for r in got)
    # What is folded is carried for every row; nothing is filled in from the root.
    assert kept[0].where("folded IS NULL").count() == 0
