"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the
sum of its words' weights; the document's is their noisy-or, so one bad
sentence is enough and the label of the document teaches which one it is.
Fragments join what follows until SHORT words are together, and a word counts
once in a sentence, so texts of many tiny or repetitive sentences are not
taken for worse than they are. A
word's weight is the sum over its features: the word and its first 3 to 6
letters, of which those count that COMMON documents of the sample have.

Fitted on at most about SAMPLE labelled rows (half of them toxic where there
are as many), drawn by a hash of doc_id, of texts up to FIT_CHARS characters;
scores see text alone. Null texts count as empty; texts without words score
0. A label that is null or missing teaches nothing; of several labels of one
doc_id the largest counts. No documents give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .langid import is_held_out

#: Labelled rows to fit on at most, and the longest text among them.
SAMPLE, FIT_CHARS = 3_000, 200_000
#: Words that a sentence has at least, the last one apart.
SHORT = 6
#: Documents of the sample that a feature must occur in.
COMMON = 6
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """(first, last, distinct lower-case words) of each sentence that has words; places in the text as it is."""
    first, last, words = -1, 0, []
    for m in SENTENCE.finditer(text):
        found = WORD.findall(m[0].lower())
        if found:
            first, last = (m.start() if first < 0 else first), m.end()
            words += found
            if len(words) >= SHORT:
                yield first, last, set(words)
                first, words = -1, []
    if words:
        yield first, last, set(words)


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings."""
    marks = [f"={word}", *(f"^{word[:n]}" for n in range(3, 7) if len(word) >= n)]
    return [zlib.crc32(m.encode("utf-8", "replace")) for m in marks]


def fit(texts: list[str], labels: np.ndarray, rounds: int = 250, rate: float = 0.3, sparse: float = 0.6) -> tuple[float, dict[int, float]]:
    """The bias and the features' weights, by proximal Adagrad on the noisy-or likelihood with an L1 penalty."""
    known: dict[str, int] = {}
    words, ends, bags = [], [], []
    for text in texts:
        bags.append(len(ends))
        for _, _, found in sentences(text):
            ends.append(len(words))
            words += [known.setdefault(w, len(known)) for w in sorted(found)]
    if not words or not 0 < labels.sum() < len(labels):
        return (5.0 if len(labels) and labels.all() else -5.0), {}
    word = np.asarray(words)
    lists = [word_features(w) for w in known]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    names, feature = np.unique(np.concatenate(lists), return_inverse=True)
    sentence = np.repeat(np.arange(len(ends)), np.diff([*ends, len(words)]))
    bag = np.repeat(np.arange(len(bags)), np.diff([*bags, len(ends)]))
    # features of too few documents are left out: pairs of (word, document) first, then of (feature, document)
    pair = np.unique(word * len(bags) + bag[sentence])
    start = np.searchsorted(owner, np.arange(len(lists) + 1))
    many = np.diff(start)[pair // len(bags)]
    at = np.repeat(start[pair // len(bags)] - np.cumsum(many) + many, many) + np.arange(many.sum())
    held = np.bincount(np.unique(feature[at] * len(bags) + np.repeat(pair % len(bags), many)) // len(bags), minlength=len(names))
    use = held[feature] >= COMMON
    owner, feature = owner[use], feature[use]
    bias, weight = -7.0, np.zeros(len(names))
    y, size = labels[bag].astype(bool), len(bags)
    squares, bias_squares = np.ones(len(weight)), 1.0
    balance = np.where(y, len(labels) / (2 * labels.sum()), len(labels) / (2 * (len(labels) - labels.sum())))
    for _ in range(rounds):
        value = np.bincount(owner, weight[feature], len(lists))
        z = np.clip(bias + np.bincount(sentence, value[word], len(ends)), -30, 30)
        p, soft = 1 / (1 + np.exp(-z)), np.logaddexp(0, z)
        total = np.maximum(np.bincount(bag, soft, size), 1e-9)
        slope = np.where(y, -1 / np.expm1(np.minimum(total, 50))[bag], 1.0) * p * balance
        by_word = np.bincount(word, slope[sentence], len(lists))
        g = np.bincount(feature, by_word[owner], len(weight))
        squares += g**2
        step = rate / np.sqrt(squares)
        weight -= step * g
        weight = np.sign(weight) * np.maximum(np.abs(weight) - step * sparse, 0)
        b = slope.sum()
        bias_squares += b * b
        bias -= rate * b / np.sqrt(bias_squares)
    kept = np.nonzero(np.abs(weight) > 1e-4)[0]
    return float(bias), dict(zip(names[kept].tolist(), weight[kept].tolist(), strict=True))


class Scorer(dict):
    """Word -> weight, filled on first use; up to a limit that bounds memory."""

    def __init__(self, bias: float, weight: dict[int, float], keep: int = 400_000):
        super().__init__()
        self.bias, self.weight, self.keep = bias, weight, keep

    def __missing__(self, word: str) -> float:
        value = sum(self.weight.get(f, 0.0) for f in word_features(word))
        if len(word) <= 40 and len(self) < self.keep:
            self[word] = value
        return value

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(first, last, probability) of each sentence."""
        out, get = [], self.__getitem__
        for first, last, words in sentences(text):
            z = self.bias + sum(map(get, words))
            out.append((first, last, 1 / (1 + math.exp(-min(z, 30))) if z > -30 else 0.0))
        return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, dict[int, float]]:
    told = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
    told = told.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    share = lambda k: int(1_000_000 * min(1.0, sample / 2 / max(counts.get(k, 0), 1)))
    drawn = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, share(1)).otherwise(share(0)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & (F.length("text") <= FIT_CHARS))
    joined = texts.join(F.broadcast(drawn), "doc_id")  # drawn has about `sample` rows
    got = joined.orderBy(F.xxhash64("doc_id", "text")).limit(2 * sample).select("text", "toxic").toArrow()  # documents may repeat a doc_id
    pairs = sorted(zip(got["text"].to_pylist(), got["toxic"].to_pylist(), strict=True))
    return fit([t for t, _ in pairs], np.asarray([y for _, y in pairs], float))


def score(docs: DataFrame, model: tuple[float, dict[int, float]]) -> DataFrame:
    """doc_id, held_out, score, predicted and offending (first, last, score of sentences at 0.5 or more) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    span = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(2):
                found = scorer.sentences(text.as_py())
                p = np.asarray([f[2] for f in found])
                scores.append(float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())))
                spans.append([{"first": a, "last": b, "score": float(s)} for a, b, s in found if s >= 0.5])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, pa.list_(span))],
                ["doc_id", "held_out", "score", "predicted", "offending"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), whole_text("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, offending array<struct<first:int,last:int,score:double>>")
