"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence with evidence (a word or word beginning of the vocabulary) has probability
``sigmoid(b + sum of its weights)``; a document is toxic if one of its sentences is, or by a small leak:
``1 - (1 - leak) * prod(1 - p)`` (noisy-or). Only document labels train the weights; sentences are then located.

Defined results: NULL and empty texts score the leak alone; rows with NULL label are not learned from; several
labels of one key count as their largest; repeated rows score alike; without any usable label every score is
the leak's start value; a NULL key is scored like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import filled, frugal, keyed, slices, small_batches, token_codes, unit_hash

# A sentence ends with a token that ends so, or with its line.
ENDS = (".", "!", "?")
STRIP = ".,;:!?\"'()[]{}*#%&$|<>-_=+~`/\\"
LINE = "\x00"
PREFIXES = (3, 4, 5, 6)
UNIT = re.compile(r"[^\x20\x09-\x0D]+|\n")


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -2.0
    leak: float = -5.0


def _features(token: str) -> list[str]:
    """The bare word and its beginnings, which hold for inflected forms too."""
    word = token.strip(STRIP)
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) > k)] if word else []


def _kinds(tokens: pa.Array) -> Iterator[pa.Array]:
    """``_features`` of all tokens at once, kind by kind (null: the token has none of it)."""
    words = pc.utf8_trim(tokens, characters=STRIP)
    sizes = pc.utf8_length(words)
    for k in (0, *PREFIXES):
        named = pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(words, 0, k), "") if k else pc.binary_join_element_wise("=", words, "")
        yield pc.if_else(pc.greater(sizes, k), named, pa.scalar(None, named.type))


def _tokens(texts: pa.Array):
    """Token codes with rows and sentence numbers (over the whole batch), and the distinct tokens."""
    marked = pc.replace_substring(filled(texts), "\n", f" {LINE} ")
    codes, rows, tokens = token_codes(marked)
    ends = pc.equal(tokens, LINE)
    for mark in ENDS:
        ends = pc.or_(ends, pc.ends_with(tokens, mark))
    ends = ends.to_numpy(zero_copy_only=False)[codes]
    starts = np.ones(len(codes), bool)
    starts[1:] = ends[:-1] | (rows[1:] != rows[:-1])
    return codes, rows, np.cumsum(starts) - 1, tokens


def _softplus(x):
    return np.logaddexp(0, x)


def _sigmoid(x):
    return np.exp(-np.logaddexp(0, -x))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold a feature, summed per slice and kind of feature."""
    for batch in batches:
        for part in slices(batch):
            codes, rows, _, tokens = _tokens(part.column("text"))
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            doc, code = np.divmod(np.unique(rows * max(len(tokens), 1) + codes), max(len(tokens), 1))
            del codes, rows
            for kind in _kinds(tokens):
                coded = kind.dictionary_encode()
                names, feature = coded.dictionary, coded.indices.fill_null(-1).to_numpy()[code].astype(np.int64)
                held = np.unique((doc * len(names) + feature)[feature >= 0])
                of, feature = np.divmod(held, max(len(names), 1))
                hot = np.bincount(feature[toxic[of]], minlength=len(names))
                cold = np.bincount(feature[~toxic[of]], minlength=len(names))
                yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(hot, pa.int64()), pa.array(cold, pa.int64())], ["feature", "hot", "cold"])


def _token_features(tokens: pa.Array, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens with features in ``index``: their number by code, where each one's features begin, and the features."""
    known = pa.array(list(index), tokens.type)
    found = np.stack([pc.fill_null(pc.index_in(kind, known, skip_nulls=True), -1).to_numpy(zero_copy_only=False) for kind in _kinds(tokens)], 1)
    sizes = (found >= 0).sum(1)
    return sizes, np.concatenate([[0], np.cumsum(sizes)]), found[found >= 0].astype(np.int64)


def _bags(index: dict[str, int]):
    """Per labelled document the features of its sentences with evidence, sentence after sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                codes, rows, sentence, tokens = _tokens(part.column("text"))
                sizes, begin, flat = _token_features(tokens, index)
                hit = np.flatnonzero(sizes[codes] > 0)
                bags: list[list[int]] = [[] for _ in range(part.num_rows)]
                for i in hit:
                    bag = bags[rows[i]]
                    for f in flat[begin[codes[i]] : begin[codes[i] + 1]]:
                        bag.append(int(sentence[i]) << 32 | int(f))
                yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int64()), pa.array(bags, pa.list_(pa.int64()))], ["toxic", "bag"])

    return run


def _gradient(w: np.ndarray, bias: float, leak: float):
    """Sums of the loss gradient over the documents of a task; position 0 is the bias, 1 the leak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) + 2)
        for batch in batches:
            bags = batch.column("bag")
            y = batch.column("toxic").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(bags)), pc.list_value_length(bags).to_numpy(zero_copy_only=False))
            entry = bags.flatten().to_numpy(zero_copy_only=False)
            if len(entry):
                sentence, feature = entry >> 32, entry & 0xFFFFFFFF
                key = np.concatenate([[True], (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])])
                s = np.cumsum(key) - 1
                owner = doc[key]
                x = bias + np.bincount(s, w[feature], minlength=s[-1] + 1)
                mass = _softplus(leak) + np.bincount(owner, _softplus(x), minlength=len(bags))
            else:
                mass = np.full(len(bags), _softplus(leak))
            slope = np.where(y > 0, -1 / np.expm1(np.maximum(mass, 1e-9)), 1.0)
            total[1] += slope.sum() * _sigmoid(leak)
            if len(entry):
                by_sentence = slope[owner] * _sigmoid(x)
                total[0] += by_sentence.sum()
                total[2:] += np.bincount(feature, by_sentence[s], minlength=len(w))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["at", "g"])

    return run


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 20_000, least_docs: int = 3,
    least_z: float = 4.0, least_lift: float = 3.0, rounds: int = 40, rate: float = 0.3, decay: float = 1e-4,
) -> ToxicityModel:
    """Learn from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text).

    The fit uses at most ``max_rows`` labelled keys, those with the smallest hash; so the broadcast list of keys
    and the model (``max_features`` weights) are bounded. The vocabulary holds features that significantly more toxic
    than clean documents have. Weights come from full gradients, one small Spark job per round.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("long")).alias("toxic"))
    # Few more keys than wanted pass by their hash, so that no task sends its own ``max_rows`` to be merged.
    share = min(1.0, 1.5 * max_rows / max(known.count(), 1))
    chosen = known.where(unit_hash(0, F.col("doc_id")) <= share).orderBy(unit_hash(0, F.col("doc_id")), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    counted = rows.mapInArrow(frugal(_count_features), "feature string, hot long, cold long")
    counted = counted.groupBy("feature").agg(F.sum("hot").alias("hot"), F.sum("cold").alias("cold"))
    size = rows.agg(F.sum("toxic").alias("hot"), F.count("toxic").alias("n")).first()
    n, n_hot = size["n"] or 0, size["hot"] or 0
    if not n_hot or n_hot == n:
        return ToxicityModel()
    share = (F.col("hot") + F.col("cold")) / n
    high, low = F.col("hot") / n_hot, F.col("cold") / (n - n_hot)
    z = (high - low) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n_hot + 1 / (n - n_hot)))
    picked = counted.where((F.col("hot") >= least_docs) & (z >= least_z) & (high >= least_lift * low))
    names = [r["feature"] for r in picked.orderBy(z.desc(), "feature").limit(max_features).select("feature").collect()]
    index = {f: i for i, f in enumerate(names)}
    bags = cut_lineage(rows.mapInArrow(frugal(_bags(index)), "toxic long, bag array<long>").coalesce(max(1, spark.sparkContext.defaultParallelism)))
    theta = np.concatenate([[-2.0, -4.0], np.zeros(len(names))])
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        parts = bags.mapInArrow(_gradient(theta[2:], theta[0], theta[1]), "at long, g double")
        grad = np.zeros_like(theta)
        for r in parts.groupBy("at").agg(F.sum("g").alias("g")).collect():
            grad[r["at"]] = r["g"]
        grad = grad / n
        grad[2:] += decay * theta[2:]
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        theta = theta - rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    return ToxicityModel({f: float(theta[i + 2]) for f, i in index.items()}, float(theta[0]), float(theta[1]))


def _spans(text: str, model: ToxicityModel) -> list[dict]:
    """Sentences with evidence: start, end (code points) and probability, in text order."""
    found: list[dict] = []
    begin, end, score, hit = None, 0, model.bias, False

    def close():
        if hit:
            found.append({"start": begin, "end": end, "p": float(_sigmoid(score))})

    for m in UNIT.finditer(text):
        token = m[0]
        if token != "\n":
            begin = m.start() if begin is None else begin
            end = m.end()
            held = [model.weights[f] for f in _features(token.translate(_ASCII)) if f in model.weights]
            hit, score = hit or bool(held), score + sum(held)
        if token == "\n" or token.endswith(ENDS):
            close()
            begin, score, hit = None, model.bias, False
    close()
    return found


_ASCII = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SPANS = "array<struct<start:int,end:int,p:double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def _scored(docs: DataFrame, model: ToxicityModel, keep: list[str], threshold: float) -> DataFrame:
    """``keep`` columns, renamed to _0, _1, ..., with score, predicted and offending."""
    small_batches(docs.sparkSession)
    names = [f"_{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keep, names)], F.col("text").alias("text"))
    index = {f: i for i, f in enumerate(model.weights)}
    weights, bias, leak = np.fromiter(model.weights.values(), float), model.bias, model.leak

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                codes, rows, sentence, tokens = _tokens(part.column("text"))
                sizes, begin, flat = _token_features(tokens, index)
                per = np.zeros(len(tokens))
                np.add.at(per, np.repeat(np.arange(len(tokens)), sizes), weights[flat])
                hit = sizes[codes] > 0
                mass = np.full(part.num_rows, _softplus(leak))
                if hit.any():
                    ids, where = np.unique(sentence[hit], return_inverse=True)
                    owner = np.zeros(len(ids), np.int64)
                    owner[where] = rows[hit]
                    x = bias + np.bincount(where, per[codes[hit]])
                    mass += np.bincount(owner, _softplus(x), minlength=part.num_rows)
                score = -np.expm1(-mass)
                predicted = score >= threshold
                texts = part.column("text")
                found = [_spans(texts[i].as_py(), model) if p and texts[i].is_valid else [] for i, p in enumerate(predicted)]
                columns = [part.column(a) for a in names]
                columns += [pa.array(score), pa.array(predicted.astype(np.int32)), pa.array(found, _SPANS)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "score", "predicted", "offending"])

    kinds = {a: docs.schema[c].dataType for c, a in zip(keep, names)}
    return source.mapInArrow(frugal(run), keyed(f"score double, predicted int, offending {SPANS}", **kinds))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``keep`` columns of each row with score, predicted and, for rejected rows, the offending sentences.

    The whole text is read. Columns: *keep, score double, predicted int, offending array of (start, end, p).
    """
    keep = ["doc_id"] if keep is None else keep
    scored = _scored(docs, model, keep, threshold)
    return scored.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "score", "predicted", "offending")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rejected rows; columns as given, whatever their names."""
    kept = _scored(docs, model, docs.columns, threshold).where(F.col("predicted") == 0)
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
