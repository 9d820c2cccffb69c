"""A training corpus in five stages; each stage's result is written and read again as the next one's documents.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All
but the last return the columns of documents. SQL can express none of the models, so there is no ORACLE_SQL; the stages are
tested against plain Python on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticeframe.llm.exact_dedup import drop_copies
from latticeframe.llm.jaccard_join import keep_one
from latticeframe.llm.mixing import mixed_rows
from latticeframe.llm.packing import pack, tokenized_pieces
from latticeframe.llm.queries import table, tokenizer_path
from latticeframe.llm.text import fold_of
from latticeframe.llm.toxicity import drop_toxic, fit_toxicity
from latticeframe.session import cut_lineage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from labels outside fold 0 of 5, as op1 does."""
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", 5) != 0)
    return drop_toxic(docs, fit_toxicity(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts, the one with the largest doc_id."""
    return drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each near-duplicate group, the one with the smallest doc_id."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens; copies that the mix repeats are packed each."""
    return pack(tokenized_pieces(docs, tokenizer_path()))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("jaccard_join", jaccard_join), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
