"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Every passage of every document (PASSAGE words, half overlapping the next) is
a query; every test unit (an item, its question or its answer, or PIECE words
of a longer one) that scores at least SHARE of its own full score retrieves its
item, so question and answer may stand far apart. Units are indexed in blocks
of BLOCK; each term keeps its largest impact in each block, so most passages
drop a block by its summed maxima, and WAND pivots through the rest, all pairs
of a passage and a block that is left to it in one step.
Items are verified word by word against the whole document: by the share of
the 5-word shingles of the question (all but the last sentence), of the answer
(the last) and of the whole item that the document has. The search goes through
all blocks, one after another, so that a task holds no more than a few numbers
for each word of a document; what it retrieves is verified after it.

An item is found when 0.8 of all its shingles are there, or 0.8 of the
question's and of the answer's. An item of fewer than five words is found when
all its words follow each other in the document; one without words never is.
Null texts are empty. Rows with equal doc_ids are
answered each, null doc_ids come back null, empty tables give no rows. The
index is broadcast in passes of at most INDEX_CHARS characters of items;
frequencies and lengths are those of the whole benchmark, so scores and
thresholds do not depend on the number of passes.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_text

PASSAGE, PIECE, BLOCK, SHARE = 128, 64, 4, 0.6
WORDS, OVERLAP = 5, 0.8
#: Characters of test items that one broadcast index holds; a larger benchmark is searched in several passes.
INDEX_CHARS = 4_000_000
K1, B = 1.2, 0.75
WORD = re.compile(r"[^\W_]+")
#: Passages, and entries of a table of passages by blocks or by terms, that are searched at once; words of the texts whose passages are made at once.
PASSAGES, CELLS, WORDS_AT_ONCE = 1024, 1 << 20, 1 << 16
#: A term in at least one of COMMON blocks is a row of the table of maxima; what its single precision may lose of a bound.
COMMON, NEAR = 8, 1e-4
LAST_SENTENCE = re.compile(r"[.!?\n](?=\s*[^\s.!?\n])")
FOUND = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def spread(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges: for each place in them the number of its range, and the place."""
    many = end - first
    which = np.repeat(np.arange(len(many)), many)
    return which, np.arange(len(which)) + np.repeat(first - np.cumsum(many) + many, many)


def shingles(ids: np.ndarray, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of all runs of `words` ids without a word that no item has (-1)."""
    if len(ids) < words:
        return np.zeros(0, np.uint64)
    known = np.append(0, np.cumsum(ids >= 0))
    at = np.nonzero(known[words:] - known[:-words] == words)[0]
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for k in range(words):
            out = (out ^ (ids[at + k].astype(np.int64) + 2).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out


def parts(text: str) -> tuple[str, str]:
    """Question and answer: the text up to its last sentence, and that sentence (both the whole, if it is one)."""
    cuts = [m.end() for m in LAST_SENTENCE.finditer(text)]
    return (text[: cuts[-1]], text[cuts[-1] :]) if cuts else (text, text)


def words_of(text: str | None) -> tuple[list[str], list[list[str]]]:
    """The words of an item, and those of its question and its answer; of a short item only the whole sequence is evidence."""
    words = WORD.findall((text or "").lower())
    return words, [WORD.findall(h) for h in parts((text or "").lower())] if len(words) >= WORDS else [words, words]


def units_of(words: list, halves: list[list]) -> list[list]:
    """What of an item is indexed: pieces of the whole and of both halves."""
    return [own[i : i + PIECE] for own in (words, *(h for h in halves if 0 < len(h) < len(words))) for i in range(0, max(1, len(own) - PIECE // 2), PIECE) if len(own)]


@dataclass
class Statistics:
    """Of all units of the benchmark: their number, their words, and how many have a term."""

    units: int
    words: int
    having: dict[str, int]


def statistics_of(texts: Iterable[str | None]) -> Statistics:
    out = Statistics(0, 0, Counter())
    for text in texts:
        for unit in units_of(*words_of(text)):
            out.units, out.words = out.units + 1, out.words + len(unit)
            out.having.update(set(unit))
    return out


class Index:
    """Postings with impacts, block maxima and the items' shingles; known: the statistics of all items, by default of these."""

    def __init__(self, items: list[tuple[int, str]], known: Statistics | None = None):
        known = known or statistics_of(t for _, t in items)
        self.terms: dict[str, int] = {}
        self.items, units, owner, wanted, self.short = [], [], [], defaultdict(list), set()
        for item, text in items:
            words, halves = words_of(text)
            if not words:
                continue
            ids = np.asarray([self.terms.setdefault(w, len(self.terms)) for w in words], np.int32)
            halves = [np.asarray([self.terms[w] for w in h], np.int32) for h in halves]
            if max(map(len, halves)) < WORDS:  # found by short parts alone
                self.short |= {min(WORDS, max(len(own), 1)) for own in (ids, *halves)}
            for kind, own in enumerate((ids, *halves)):
                n = min(WORDS, max(len(own), 1))
                wanted[n].append((3 * len(self.items) + kind, np.unique(shingles(own, n))))
            self.items.append(item)
            for own in units_of(ids, halves):
                units.append(own)
                owner.append(len(self.items) - 1)
        self.wanted = {words: self.looked_up(found) for words, found in wanted.items()}
        n = len(units)
        self.blocks = math.ceil(n / BLOCK)
        t = np.concatenate([np.unique(u) for u in units]) if n else np.zeros(0, np.int64)
        tf = np.concatenate([np.unique(u, return_counts=True)[1] for u in units]) if n else np.zeros(0)
        u = np.repeat(np.arange(n), [len(np.unique(x)) for x in units]) if n else np.zeros(0, np.int64)
        size = np.asarray([len(x) for x in units], float)
        df = np.asarray([known.having[w] for w in self.terms], float)
        idf = np.log1p((known.units - df + 0.5) / (df + 0.5))
        impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[u] / max(known.words / max(known.units, 1), 1))) if n else np.zeros(0)
        # units of like thresholds share a block, so that the least of a block is close to all of its own
        least = SHARE * np.bincount(u, impact, n)
        rank = np.argsort(least, kind="stable")
        self.least, self.owner, new = least[rank], np.asarray(owner, np.int64)[rank], np.empty(n, np.int64)
        new[rank] = np.arange(n)
        u = new[u]
        order = np.lexsort((u, t))
        t, u, impact = t[order], u[order], impact[order]
        self.first = np.searchsorted(t, np.arange(len(self.terms) + 1))
        self.unit, self.impact = u, impact
        # lists: the postings of a term in a block, by term and block, with their largest impact and their first unit
        key = t.astype(np.int64) * max(self.blocks, 1) + u // BLOCK
        at = np.nonzero(np.diff(key, prepend=-1))[0]
        self.list_at, self.list_key, self.list_block = np.append(at, len(u)), key[at], u[at] // BLOCK
        self.list_max = np.maximum.reduceat(impact, at) if len(at) else np.zeros(0)
        list_term = t[at]
        self.list_first = np.searchsorted(list_term, np.arange(len(self.terms) + 1))
        # terms of many blocks have a row of a table, so that most bounds are one multiplication
        many = np.diff(self.list_first)
        common = np.nonzero(many * COMMON >= max(self.blocks, 1))[0]
        self.row = np.full(len(self.terms), -1)
        self.row[common] = np.arange(len(common))
        self.list_of = np.full((len(common), self.blocks), -1, np.int32)
        own = np.nonzero(self.row[list_term] >= 0)[0]
        self.list_of[self.row[list_term[own]], self.list_block[own]] = own
        self.table = np.append(self.list_max, 0.0).astype(np.float32)[self.list_of]
        self.block_least = np.full(self.blocks, np.inf)
        np.minimum.at(self.block_least, np.arange(n) // BLOCK, self.least)

    @staticmethod
    def looked_up(found: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """Distinct shingles, where each one's parts begin, the parts (3 x item + 0 whole, 1 question, 2 answer), and the share that a shingle is of its part."""
        every = np.concatenate([s for _, s in found])
        part = np.repeat(np.asarray([p for p, _ in found], np.int64), [len(s) for _, s in found])
        weight = np.repeat([1 / max(len(s), 1) for _, s in found], [len(s) for _, s in found])
        order = np.argsort(every, kind="stable")
        distinct, first = np.unique(every[order], return_index=True)
        return distinct, np.append(first, len(every)), part[order], weight[order]

    def verified(self, ids: np.ndarray) -> dict[int, tuple[float, float, float]]:
        """Item -> overlap, question's overlap, answer's overlap, of the items that a document passes for."""
        shares: dict[int, float] = {}
        likely: set[int] = set()  # items of which a part passes
        for words in sorted(self.wanted, reverse=True):
            if words < WORDS and not likely and words not in self.short:
                continue  # its items have a longer part, and none of these passes
            distinct, first, part, weight = self.wanted[words]
            have = shingles(ids, words)
            if not len(have) or not len(distinct):
                continue
            at = np.minimum(np.searchsorted(distinct, have), len(distinct) - 1)
            at = np.unique(at[distinct[at] == have])
            many = first[at + 1] - first[at]
            place = np.repeat(first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
            parts_, inverse = np.unique(part[place], return_inverse=True)
            share = np.bincount(inverse, weight[place], len(parts_))
            shares.update(zip(parts_.tolist(), share.tolist(), strict=True))
            likely.update((parts_[share >= OVERLAP - 1e-9] // 3).tolist())
        found = {i: tuple(shares.get(3 * i + k, 0.0) for k in range(3)) for i in likely}
        return {i: s for i, s in found.items() if s[0] >= OVERLAP - 1e-9 or min(s[1:]) >= OVERLAP - 1e-9}

    def doc_ids(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        return np.array(list(map(self.terms.get, words, itertools.repeat(-1))), np.int32)

    def passages(self, ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """The number of passages, and (passage, term) pairs: each known term once in each passage."""
        half, terms = PASSAGE // 2, max(len(self.terms), 1)
        rows = max(1, math.ceil(len(ids) / half) - 1)
        at = np.nonzero(ids >= 0)[0]
        place = np.concatenate([at // half, at // half - 1])  # each half belongs to two passages
        key = np.unique((place * terms + np.concatenate([ids[at], ids[at]]))[(place >= 0) & (place < rows)])
        return rows, key // terms, key % terms

    def near_bounds(self, rows: int, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Passages x blocks: summed block maxima, in single precision."""
        row = self.row[term]
        has = row >= 0
        known = np.zeros((rows, len(self.table)), np.float32)
        known[passage[has], row[has]] = 1
        rare = ~has
        which, place = spread(self.list_first[term[rare]], self.list_first[term[rare] + 1])
        more = np.bincount(passage[rare][which] * self.blocks + self.list_block[place], self.list_max[place], rows * self.blocks)
        return known @ self.table + more.reshape(rows, self.blocks).astype(np.float32)

    def lists(self, passage: np.ndarray, term: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the pair, list) of all lists that the terms of each pair's passage have in its block."""
        which, place = spread(np.searchsorted(passage, pairs[0]), np.searchsorted(passage, pairs[0], "right"))
        block, own = pairs[1][which], term[place]
        row = self.row[own]
        found = np.full(len(own), -1)
        has = row >= 0
        found[has] = self.list_of[row[has], block[has]]
        rare = np.nonzero(~has)[0]
        if len(rare):
            wanted = own[rare] * self.blocks + block[rare]
            at = np.minimum(np.searchsorted(self.list_key, wanted), len(self.list_key) - 1)
            found[rare] = np.where(self.list_key[at] == wanted, at, -1)
        return which[found >= 0], found[found >= 0]

    def bounded(self, rows: int, passage: np.ndarray, term: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """(passage, block) pairs whose summed block maxima reach the block's least threshold, and their lists (see lists)."""
        pairs = np.nonzero(self.near_bounds(rows, passage, term) >= self.block_least * (1 - NEAR) - NEAR)
        which, found = self.lists(passage, term, pairs)
        stays = np.bincount(which, self.list_max[found], len(pairs[0])) >= self.block_least[pairs[1]] - 1e-9
        inside = stays[which]
        return (pairs[0][stays], pairs[1][stays]), (np.cumsum(stays) - 1)[which[inside]], found[inside]

    def candidates(self, ids: np.ndarray, blocks: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(passage, block) pairs of these blocks whose summed block maxima reach the block's least threshold."""
        asked = set(blocks)
        (passage, block), _, _ = self.bounded(*self.passages(ids))
        return ((p, b) for p, b in zip(passage.tolist(), block.tolist(), strict=True) if b in asked)

    def pivoted(self, block: np.ndarray, which: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, unit, score) of the units at their threshold or above; all pairs of a passage and a block step through WAND at once.

        block: that of each pair; which, found: its lists. A unit is a pivot if
        the lists that begin at it or before it can reach the block's least
        threshold together; other units are skipped, pivots are scored.
        """
        n, lead = len(block), self.unit[self.list_at[found]] % BLOCK
        reach = np.cumsum(np.bincount(which * BLOCK + lead, self.list_max[found], n * BLOCK).reshape(n, BLOCK), axis=1)
        pivot = (reach >= self.block_least[block][:, None] - 1e-9).ravel()
        of, place = spread(self.list_at[found], self.list_at[found + 1])
        at = which[of] * BLOCK + self.unit[place] % BLOCK
        scored = pivot[at]
        score = np.bincount(at[scored], self.impact[place[scored]], n * BLOCK)
        unit = np.repeat(block * BLOCK, BLOCK) + np.tile(np.arange(BLOCK), n)
        hit = np.nonzero(pivot & (unit < len(self.least)) & (score > 0))[0]
        hit = hit[score[hit] >= self.least[unit[hit]] - 1e-9]
        return hit // BLOCK, unit[hit], score[hit]

    def wand(self, terms: np.ndarray, block: int) -> list[tuple[int, float]]:
        """(unit, score) of the block's units at their threshold or above, for a set of terms."""
        which, found = self.lists(np.zeros(len(terms), np.int64), terms, (np.zeros(1, np.int64), np.asarray([block])))
        _, unit, score = self.pivoted(np.asarray([block]), which, found)
        return list(zip(unit.tolist(), score.tolist(), strict=True))

    def retrieved(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, score) of all units that a passage retrieves, by text; texts: as ids of words."""
        split = [self.passages(ids) for ids in texts]
        begins = np.cumsum([0, *(rows for rows, _, _ in split)])
        passage = np.concatenate([p + at for (_, p, _), at in zip(split, begins[:-1].tolist(), strict=True)])
        term, found = np.concatenate([t for _, _, t in split]), []
        rows = max(1, min(PASSAGES, CELLS // max(self.blocks, len(self.table), 1)))
        for at in range(0, int(begins[-1]), rows):
            own = slice(*np.searchsorted(passage, (at, at + rows)))
            (near, block), which, lists = self.bounded(min(rows, int(begins[-1]) - at), passage[own] - at, term[own])
            pair, unit, score = self.pivoted(block, which, lists)
            found.append((np.searchsorted(begins, near[pair] + at, "right") - 1, self.owner[unit], score))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def search(self, text: str) -> list[tuple[int, float, float, float, float]]:
        """(item, best score, overlap, question's overlap, answer's overlap) of the items found in a text."""
        return [hit for _, *hit in self.search_all([text])]

    def search_all(self, texts: Iterable[str]) -> Iterator[tuple[int, int, float, float, float, float]]:
        """(place of the text, item, best score, overlap, question's overlap, answer's overlap) of the items found in texts."""
        begin, group, size = 0, [], 0
        for ids in itertools.chain(map(self.doc_ids, texts), [None]):
            if group and (ids is None or size + len(ids) > WORDS_AT_ONCE):
                yield from self.found(begin, group)
                begin, group, size = begin + len(group), [], 0
            if ids is not None:
                group.append(ids)
                size += len(ids)

    def found(self, begin: int, texts: list[np.ndarray]) -> Iterator[tuple[int, int, float, float, float, float]]:
        if not len(self.owner):
            return
        text, item, score = self.retrieved(texts)
        for k in np.unique(text).tolist():
            own = slice(*np.searchsorted(text, (k, k + 1)))
            passed = self.verified(texts[k])
            for i in sorted(passed):
                of = score[own][item[own] == i]
                if len(of):
                    yield (begin + k, self.items[i], float(of.max()), *passed[i])


def statistics(items: DataFrame) -> DataFrame:
    """term, units: how many units have a term; the empty term has the number of units, the null one their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics_of(x.as_py() for x in batch.column(0))
            terms, counts = [*found.having, "", None], [*found.having.values(), found.units, found.words]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["term", "units"])

    return items.select("text").mapInArrow(run, "term string, units long").groupBy("term").agg(F.sum("units").alias("units"))


def leaks(docs: DataFrame, benchmark: DataFrame, index_chars: int = INDEX_CHARS) -> DataFrame:
    """FOUND rows: the test items found in each document."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes, found = max(1, math.ceil(chars / index_chars)), None
    known = stored(statistics(items))
    sums = {r["term"]: r["units"] for r in known.where("term is null or term = ''").collect()}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).toArrow().to_pylist()
        terms = known if passes == 1 else known.join(statistics(docs.sparkSession.createDataFrame(part, items.schema)).select("term"), "term", "left_semi")
        having = {r["term"]: r["units"] for r in terms.where("term <> ''").toLocalIterator()}  # the terms of at most index_chars characters
        index = docs.sparkSession.sparkContext.broadcast(Index(sorted(((r["item_id"], r["text"]) for r in part), key=lambda r: (r[0] is None, r)), Statistics(sums.get("", 0), sums.get(None, 0), having)))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = [(ids[k], *hit) for k, *hit in index.value.search_all(text.as_py() for text in batch.column(1))]
                columns = list(zip(*out, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        hits = rows.mapInArrow(run, FOUND)
        found = hits if found is None else found.unionByName(hits)
    return found
