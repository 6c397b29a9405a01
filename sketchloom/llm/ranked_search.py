"""Ranked lexical search by dense blocked multiplication.

Only terms of the items matter. One pass over the documents writes, for each,
its length and the item terms it has with their counts; the counts of all
documents give the terms' weights. A second pass multiplies tiles: a block of
items over the compact vocabulary of that block (weight times occurrences in
the item) by the same terms' impacts in a tile of documents, as doubles, so
that BLAS does the work. Every product and partial sum is a whole number; a
block's vocabulary is cut into tiles of at most VOCABULARY terms, and before
the sum of its largest products could reach 2^53; what the cuts give is added
as 64-bit integers, so scores are exact.
Of each tile, all documents that reach the tile's k-th best score stay, ties
included, and are cut to k by (score, doc_id) across the tiles of a task, then
across tasks in a window.

Items travel in passes of at most PASS_TERMS terms with repeats; statistics are
those of all documents in any pass. Documents of any length are read in
stretches. Null and empty texts have no terms. Documents and items that repeat
count each; a null doc_id comes back null and loses every tie, a null item_id
comes back null. Items without terms, empty tables and terms that no document
has give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_or_last, id_or_null, lower_words, stored, whole_text

#: Terms, with repeats, of the items of one pass (so that its tables stay under 128 MB); items of a block; terms and documents of a tile.
PASS_TERMS, ITEMS, VOCABULARY, TILE = 250_000, 64, 2048, 1024
EXACT = 2**53
#: A document's impact of a term never reaches more.
MOST_IMPACT = 10**6


def vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of the vocabulary, a broadcast dict), counts: a row for each document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, found = 0, []
                for words in lower_words(text.as_py()):
                    n += len(words)
                    found.append(np.fromiter((k for k in map(known.get, words) if k is not None), np.int32))
                if n:
                    own, tf = np.unique(np.concatenate(found), return_counts=True)
                    ids.append(doc)
                    sizes.append(n)
                    terms.append(own)
                    counts.append(tf)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


@dataclass
class Block:
    """Items of one block: their places in the pass, and the cuts of its vocabulary: (terms, sorted; items x terms products of weight and occurrences)."""

    items: np.ndarray
    cuts: list[tuple[np.ndarray, np.ndarray]]


def blocks(items: list[dict[int, int]], weights: dict[int, int]) -> list[Block]:
    """items: term -> occurrences. Items that are alike in their terms' number share a block, so that its table is dense."""
    out = []
    for at in range(0, len(items), ITEMS):
        part = items[at : at + ITEMS]
        terms = sorted({t for item in part for t in item if weights.get(t, 0) > 0})
        cuts, own, total = [], [], 0
        for t in terms:
            most = MOST_IMPACT * weights[t] * max(item.get(t, 0) for item in part)
            if own and (total + most >= EXACT or len(own) == VOCABULARY):
                cuts.append(own)
                own, total = [], 0
            own.append(t)
            total += most
        cuts += [own] if own else []
        tables = [(np.asarray(c, np.int64), np.asarray([[float(item.get(t, 0) * weights[t]) for t in c] for item in part])) for c in cuts]
        out.append(Block(np.arange(at, at + len(part)), tables))
    return out


class Tile:
    """Documents by row: their ids, and (row, term, impact) of each item term they have."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray], documents: int, terms: int):
        self.ids, (ends, self.term, counts) = ids, lists
        self.row = np.repeat(np.arange(len(ids)), ends)
        m = np.asarray([25 + 75 * n * documents // terms for n in sizes.tolist()], np.int64)
        self.impact = (10**9 * counts) // (1000 * counts + 8 * m[self.row])

    def scores(self, block: Block) -> np.ndarray:
        """Items x documents."""
        out = np.zeros((len(block.items), len(self.ids)), np.int64)
        for terms, table in block.cuts:
            at = np.minimum(np.searchsorted(terms, self.term), len(terms) - 1)
            has = terms[at] == self.term
            dense = np.zeros((len(terms), len(self.ids)))
            dense[at[has], self.row[has]] = self.impact[has]
            out += (table @ dense).astype(np.int64)
        return out


class Best:
    """The best k (score, doc_id) of each item so far; ties by the smaller doc_id."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.least[items]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero(scores >= least[:, None])
        if not len(i):
            return
        item, score, doc = np.concatenate([self.item, items[i]]), np.concatenate([self.score, scores[i, j]]), np.concatenate([self.doc, ids[j]])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        self.item, self.score, self.doc = item[nth < self.k], score[nth < self.k], doc[nth < self.k]
        full = nth == self.k - 1
        self.least[item[full]] = score[full]


def searched(rows: DataFrame, shared, documents: int, terms: int, k: int) -> DataFrame:
    """item (place in the pass), doc_id, score: the best k of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: list[Block] = shared.value
        best = Best(sum(len(b.items) for b in index), k)
        for batch in batches:
            for at in range(0, len(batch), TILE):
                ids, sizes, own, counts = batch.slice(at, TILE).columns
                lists = np.diff(own.offsets.to_numpy()), own.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy()
                tile = Tile(ids.to_numpy(), sizes.to_numpy(), lists, documents, terms)
                for block in index:
                    best.add(block.items, tile.scores(block), tile.ids)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.item, best.doc, best.score)], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def passes(items: DataFrame, terms: int) -> Iterator[list]:
    """The items in bounded lists of (item_id, occurrences of its terms)."""
    out, size = [], 0
    for row in items.toLocalIterator():
        own = Counter(w for words in lower_words(row["text"]) for w in words)
        if out and size + own.total() > terms:
            yield out
            out, size = [], 0
        out.append((row["item_id"], own))
        size += own.total()
    if out:
        yield out


def search(docs: DataFrame, items: DataFrame, k: int = 10, pass_terms: int = PASS_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) for each item (item_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(id_or_last("doc_id").alias("doc_id"), whole_text("text").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), whole_text("text").alias("text"))
    out = None
    for part in passes(items, pass_terms):
        part.sort(key=lambda x: x[1].total())  # blocks of items of like length
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, own in part for w in own}))}
        rows = stored(vectors(docs, spark.sparkContext.broadcast(vocabulary)))
        size = rows.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
        having = {r["term"]: r["n"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row for each term of the pass at most
        weights = {t: weight(size["documents"], n) for t, n in having.items()}
        index = blocks([{vocabulary[w]: n for w, n in own.items()} for _, own in part], weights)
        found = searched(rows, spark.sparkContext.broadcast(index), size["documents"], size["terms"] or 1, k)
        nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        found = found.withColumn("rank", nth).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(part)], "item long, item_id long")
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", id_or_null("doc_id").alias("doc_id"), "score")  # a row for each item of the pass
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


TERMS_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""WITH words AS (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL
), weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, total WHERE term IN (SELECT term FROM asked) GROUP BY term
), ms AS (SELECT doc_id, 100 - 75 + ((75 * n * docs) // terms) AS m FROM sizes, total
), scored AS (
  SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN ms USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""
