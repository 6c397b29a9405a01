"""Language identification with a string kernel, Nystroem landmarks and kernel ridge regression.

The blended-spectrum presence kernel counts the distinct 1-, 2- and 3-grams
that two texts share, each length divided by the root of both texts' own
counts. Letters are folded to 63 classes (a to z, and other letters by code
point), all else to a break. Kernel values against LANDMARKS texts, whitened,
are the features of one ridge regression for each language; texts are scored
in batches by matrix products.

The model is fitted on at most about SAMPLE labelled rows (or one for each
language, if there are more languages), shared evenly by the languages and
drawn by a hash of doc_id; text and lang of these rows are
all that it sees, and a prediction sees text alone. Every language is learned. Null texts and texts
without a letter get ``und`` and score 0; so do all when no row has a label.
Null and repeated ids are each answered; no documents give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Labelled rows to fit on at most, landmark texts, ridge.
SAMPLE, LANDMARKS, RIDGE = 1_600, 160, 1e-2
CLASSES = 64
#: Where the codes of the 1-, 2- and 3-grams begin, and their number.
STARTS = (0, CLASSES, CLASSES + CLASSES**2, CLASSES + CLASSES**2 + CLASSES**3)


@functools.cache
def folding() -> np.ndarray:
    """The class of each code point: 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c % 37
    return out


def grams(text: str) -> np.ndarray:
    """The codes of all 1- to 3-grams of a text, repeats included; none if it has no letter."""
    c = folding()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    if not c.any():
        return np.zeros(0, np.int32)
    c = np.concatenate([[0], c[(c != 0) | (np.concatenate([[1], c[:-1]]) != 0)], [0]]).astype(np.int32)
    two = c[:-1] * CLASSES + c[1:]
    return np.concatenate([c, STARTS[1] + two, STARTS[2] + two[:-1] * CLASSES + c[2:]])


def is_held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # codes that a landmark has
    landmarks: np.ndarray  # packed presence: landmarks x vocabulary
    norms: np.ndarray  # landmarks x 3
    weights: np.ndarray  # landmarks x languages

    def scorer(self):
        """A function from texts to (language or und, score)."""
        bits = np.unpackbits(self.landmarks, axis=1, count=len(self.vocabulary)).astype(np.float32) if self.languages else None
        order = np.searchsorted(self.vocabulary, STARTS)
        if self.languages:
            for n in range(3):
                bits[:, order[n] : order[n + 1]] /= 3 * np.maximum(self.norms[:, n : n + 1], 1)
        flags = np.zeros(STARTS[3], np.uint8)

        def score(texts: list[str | None]) -> list[tuple[str, float]]:
            have = np.zeros((len(texts), len(self.vocabulary)), np.float32)
            letters = np.zeros(len(texts), bool)
            for i, text in enumerate(texts):
                codes = grams(text) if text and self.languages else ()
                if len(codes):
                    letters[i] = True
                    flags[codes] = 1
                    have[i] = flags[self.vocabulary]
                    for n in range(3):
                        have[i, order[n] : order[n + 1]] /= np.sqrt(flags[STARTS[n] : STARTS[n + 1]].sum(dtype=np.int64))
                    flags[codes] = 0
            if not self.languages:
                return [("und", 0.0)] * len(texts)
            values = have @ bits.T @ self.weights
            best = values.argmax(axis=1)
            top = np.clip((1 + values[np.arange(len(texts)), best]) / 2, 0, 1)
            return [(self.languages[b], float(s)) if ok else ("und", 0.0) for b, s, ok in zip(best.tolist(), top.tolist(), letters.tolist(), strict=True)]

        return score


def fit(languages: list[str], sets: list[np.ndarray], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The model from the distinct gram codes of labelled texts."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.uint8), np.zeros((0, 3)), np.zeros((0, 0)))
    label = np.asarray([names.index(x) for x in languages])
    rank = np.empty(len(label), np.int64)
    for k in range(len(names)):
        rank[label == k] = np.arange((label == k).sum())
    chosen = np.lexsort((label, rank))[:landmarks]  # evenly from all languages
    vocabulary = np.unique(np.concatenate([sets[i] for i in chosen]))
    order = np.searchsorted(vocabulary, STARTS)

    def presence(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Which codes of the vocabulary each text has, and the roots of each text's own counts."""
        have, norms = np.zeros((len(codes), len(vocabulary)), np.float32), np.zeros((len(codes), 3))
        for i, own in enumerate(codes):
            at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
            have[i, at[vocabulary[at] == own]] = 1
            norms[i] = np.sqrt(np.diff(np.searchsorted(own, STARTS)))
        return have, norms

    def scaled(have: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return np.concatenate([have[:, order[n] : order[n + 1]] / np.maximum(norms[:, n : n + 1], 1) for n in range(3)], axis=1)

    marks, norms = presence([sets[i] for i in chosen])
    across = scaled(marks, norms).T
    kernel = np.concatenate([scaled(*presence(sets[i : i + 128])) @ across for i in range(0, len(sets), 128)]).astype(float) / 3
    value, vector = np.linalg.eigh(kernel[chosen] + 1e-6 * np.eye(len(chosen)))
    white = vector / np.sqrt(np.maximum(value, 1e-6))
    phi = kernel @ white
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    beta = np.linalg.solve(phi.T @ phi + ridge * len(sets) / 100 * np.eye(len(chosen)), phi.T @ target)
    return Model(names, vocabulary, np.packbits(marks.astype(bool), axis=1), norms, white @ beta)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows that are not held out."""
    rows = docs.where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = stored(rows.groupBy("lang").count())  # Spark broadcasts it while it is small
    share = max(1, sample // max(counts.count(), 1))
    limits = counts.select("lang", F.ceil(F.least(F.lit(1.0), F.lit(share) / F.col("count")) * 1_000_000).alias("limit"))
    drawn = rows.select("doc_id", "lang", "text").join(limits, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("limit"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(grams(x.as_py())).astype("<i4").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), batch.column(2)], ["lang", "codes", "h"])

    coded = drawn.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("h")).mapInArrow(codes, "lang string, codes binary, h long")
    got = coded.where(F.length("codes") > 0).orderBy("h").limit(2 * sample + share).toArrow()  # rows that share one doc_id are drawn all or none
    pairs = sorted(zip(got["lang"].to_pylist(), got["codes"].to_pylist(), strict=True))
    return fit([k for k, _ in pairs], [np.frombuffer(c, "<i4") for _, c in pairs])


def in_a_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, as they are, in whose text a language is found; a model without languages rejects only texts without a letter."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for i in range(0, len(batch), 128):
                part = batch.slice(i, 128)
                texts = part.column(at).to_pylist()
                keep = [name != "und" for name, _ in score(texts)] if model.languages else [bool(t) and len(grams(t)) > 0 for t in texts]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for i in range(0, len(batch), 128):
                part = batch.slice(i, 128)
                found = score(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
