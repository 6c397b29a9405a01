"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens: its documents end to end, in the order of
the input's partitions. Queues take turns. A turn falls due when the queue's
share of the tokens served so far reaches it, and windows are filled with turns
in the order in which they fall due; what a queue is short of is its deficit
and is carried on until its next turn. Queues with at least TURN tokens a window
take turns of one token, so that each window holds their share to the token; a
rarer one waits until TURN tokens are due to it, so that its documents are not
shredded. Inside a window the tokens of a queue lie together. Queues that run
dry leave their share to the others.

What is served before any window is a function of the window alone, so deficits
carry across partitions without any task waiting for another: a task only needs
the queue totals and where its documents begin in their queue. Long documents
are walked in slices, and only the windows that they touch are looked at. Every
window is full except for the last.

Sources with one token a window or more are among the `size` largest ones by
tokens and have a queue each, as have all with a target. The rest, of which no
window could hold the proportions, keep their joint share in one queue.

A target is the share of a window that a source gets while it lasts. The others
divide what the targets leave by their shares of the corpus; if there are no
others, targets are scaled to 1. A share of zero (also of the others, where
targets take all) is served when all other queues are dry. Targets of sources
without documents are void. Negative targets and sums over 1 are refused.

Null texts count as empty (their end token still takes a place), null sources
are a source of their own, repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_or_last, id_or_null, stored, token_bytes, whole_text

#: Tokens of a rare queue's turn (a sixteenth of a window at most), tokens of a slice, and numbers in the tables of a group of slices.
TURN, SLICE, NUMBERS = 256, 1 << 16, 1 << 21
END_ID = 2
ENCODED = "doc_id long, source string, part int, first long, n long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each document with its ids and its place among its partition's tokens of the same source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, served = token_bytes(tokenizer), TaskContext.get().partitionId(), {}
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            for i in range(0, len(batch), 512):
                rows = batch.slice(i, 512)
                ids = [memo.of(x.as_py()) + end for x in rows.column(2)]
                n, first = [len(x) // 4 for x in ids], []
                for q, m in zip(rows.column(1).to_pylist(), n, strict=True):
                    first.append(served.get(q, 0))
                    served[q] = first[-1] + m
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array([part] * len(n), pa.int32()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "part", "first", "n", "ids"],
                )

    return docs.select(id_or_last("doc_id").alias("doc_id"), name_of().alias("source"), whole_text("text").alias("text")).mapInArrow(run, ENCODED)


def name_of() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


class Turns:
    """The order of all turns of all queues: by the time at which they fall due, then by queue. Queues with a share of zero start when the others have ended."""

    def __init__(self, totals: np.ndarray, shares: np.ndarray, phases: np.ndarray, size: int):
        served = shares > 0
        self.start = np.where(served, 0.0, (totals[served] / shares[served]).max(initial=0.0) + 1)
        shares = np.where(served, shares, totals / max(totals[~served].sum(), 1))
        self.totals, self.shares, self.size = totals, shares, size
        turn = max(1, min(TURN, size // 16))
        self.turn = np.where(shares * size >= turn, 1, turn)
        self.phase = np.where(self.turn == 1, 0.5, phases)
        self.many = -(-totals // self.turn)

    def due(self, turn: np.ndarray, q=slice(None)) -> np.ndarray:
        """When a turn (its number in its queue) falls due: as far into its tokens as the queue's phase says."""
        first = turn * self.turn[q]
        return self.start[q] + (first + self.phase[q] * (np.minimum(self.totals[q], first + self.turn[q]) - first)) / self.shares[q]

    def before(self, time: np.ndarray) -> np.ndarray:
        """Tokens of turns that fall due before each time: rows of times, columns of queues."""
        time = time[:, None]
        n = np.clip(np.minimum((time - self.start) * self.shares, self.totals + 1.0) // self.turn, 0, self.many).astype(np.int64)
        while (late := (n > 0) & (self.due(n - 1) >= time)).any():
            n -= late
        while (early := (n < self.many) & (self.due(n) < time)).any():
            n += early
        return np.minimum(self.totals, n * self.turn)

    def served(self, windows: np.ndarray) -> np.ndarray:
        """Tokens that each queue has given before each window: rows of windows, columns of queues."""
        goal = np.minimum(windows * self.size, self.totals.sum())
        low, high = np.zeros(len(goal)), np.full(len(goal), (self.start + self.totals / self.shares).max() + 1)
        sure, more = np.zeros((len(goal), len(self.totals)), np.int64), np.tile(self.totals, (len(goal), 1))  # what is due before low and before high
        near, left = goal + np.asarray([[-1.0], [1.0]]) * (self.turn.sum() + len(self.turn)), np.arange(len(goal))  # while no queue is dry, time and tokens go together
        for step in itertools.count():
            # done where no time is left between the two, or one turn of one queue at most
            gap = more[left] - sure[left]
            left = left[(((gap > 0).sum(axis=1) > 1) | (gap > self.turn).any(axis=1)) & (np.nextafter(low[left], high[left]) < high[left])]
            if not len(left):
                break
            a, b = low[left], high[left]
            middle = near[step, left] if step < 2 else a + (b - a) / 2
            middle = np.where((middle <= a) | (middle >= b), np.nextafter(a, b) if step >= 2 else a + (b - a) / 2, middle)
            due = self.before(middle)
            fits = due.sum(axis=1) <= goal[left]
            low[left], high[left] = np.where(fits, middle, a), np.where(fits, b, middle)
            sure[left[fits]], more[left[~fits]] = due[fits], due[~fits]
        next_ = more - sure
        rest = (goal - sure.sum(axis=1))[:, None] - (np.cumsum(next_, axis=1) - next_)
        return sure + np.clip(rest, 0, next_)

    def touched(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slice, window): the windows, and maybe some around them, that hold tokens low to high of a queue."""
        a, b = low // self.turn[q], (high - 1) // self.turn[q]
        many = np.where(self.turn[q] == 1, 2, b - a + 1)  # of turns of one token the first and the last tell all
        who = np.repeat(np.arange(len(q)), many)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
        time = self.due(np.where(self.turn[q[who]] == 1, np.where(nth == 0, a[who], b[who]), a[who] + nth), q[who])
        first = self.before(time).sum(axis=1) // self.size
        last = (np.maximum(self.before(np.nextafter(time, np.inf)).sum(axis=1), 1) - 1) // self.size
        single = self.turn[q[who]] == 1
        last = np.where(single & (nth == 0), np.append(last[1:], 0), last)  # from the first token's window to the last one's
        use = ~single | (nth == 0)
        who, first, last = who[use], first[use], last[use]
        many = last - first + 1
        window = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.unique(np.stack([np.repeat(who, many), window]), axis=1)
        return pairs[0], pairs[1]


def cut(batch: list[tuple[int, int, int, bytes]], turns: Turns) -> Iterator[tuple]:
    """PIECES rows of documents (doc_id, queue, first position in the queue, ids)."""
    slices = [(i, at) for i, (_, _, _, ids) in enumerate(batch) for at in range(0, len(ids) // 4, SLICE)]
    step = max(1, NUMBERS // (len(turns.totals) * (SLICE // TURN)))
    for j in range(0, len(slices), step):
        group = slices[j : j + step]
        q = np.asarray([batch[i][1] for i, _ in group])
        low = np.asarray([batch[i][2] + at for i, at in group])
        high = low + [min(SLICE, len(batch[i][3]) // 4 - at) for i, at in group]
        who, window = turns.touched(q, low, high)
        windows = np.unique(np.concatenate([window, window + 1]))
        table = turns.served(windows)
        row, next_, own = np.searchsorted(windows, window), np.searchsorted(windows, window + 1), q[who]
        given = table[next_] - table[row]
        ahead = (np.cumsum(given, axis=1) - given)[np.arange(len(who)), own]  # where the queue's tokens begin in the window
        begin = table[row, own]
        a, b = np.maximum(low[who], begin), np.minimum(high[who], table[next_, own])
        for s, k, x, y, offset in zip(*(v[b > a].tolist() for v in (who, window, a, b, ahead + a - begin)), strict=True):
            doc, _, at, ids = batch[group[s][0]]
            yield doc, x - at, y - x, len(ids) // 4, k, offset, ids[4 * (x - at) : 4 * (y - at)]


def shares_of(totals: dict[str | None, int], targets: dict[str, float]) -> dict[str | None, float]:
    """The share of each queue (None: the joint one): targets as they are, what they leave divided by tokens."""
    if any(not 0 <= t <= 1 for t in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("targets are shares: none below zero, and no more than 1 in all")
    named = {q: float(t) for q, t in targets.items() if q in totals}
    others = sum(n for q, n in totals.items() if q not in named)
    if not others:
        scale = sum(named.values())
        named = {q: t / scale for q, t in named.items()} if scale else {}
        others = sum(n for q, n in totals.items() if q not in named)
    left = max(0.0, 1 - sum(named.values()))
    return {q: named[q] if q in named else left * n / others for q, n in totals.items()}


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents in windows of size tokens: PIECES, ids as little-endian uint32.

    targets: the share of tokens wanted from a source; by default all sources
    keep their share of the corpus, so that no queue runs dry before the last
    window.
    """
    targets = targets or {}
    encoded = stored(encode(docs, tokenizer))
    runs = stored(encoded.groupBy("source", "part").agg(F.sum("n").alias("n")))
    tokens = runs.groupBy("source").agg(F.sum("n").alias("n"))
    top = {r["source"]: r["n"] for r in tokens.orderBy(F.desc("n"), "source").limit(size).collect()}
    top |= {r["source"]: r["n"] for r in tokens.where(F.col("source").isin([*targets])).collect()}
    whole = tokens.agg(F.sum("n")).first()[0] or 0
    sums: dict[str | None, int] = {s: top[s] for s in dict.fromkeys([*targets, *top]) if s in top}
    sums |= {None: whole - sum(sums.values())} if whole > sum(sums.values()) else {}
    place = {s: i for i, s in enumerate(sums)}
    named = docs.sparkSession.createDataFrame(pa.table({"source": pa.array([s for s in place if s is not None], pa.string()), "queue": pa.array([i for s, i in place.items() if s is not None], pa.int32())}))
    runs = stored(runs.join(named, "source", "left").withColumn("queue", F.coalesce("queue", F.lit(place.get(None, 0)))))
    # where a run begins in its queue: what earlier parts hold, then, in the joint queue, what other sources of the part hold
    by_part = runs.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_part = by_part.select("queue", "part", before(Window.partitionBy("queue").orderBy("part")).alias("earlier"))
    inner = runs.withColumn("inner", before(Window.partitionBy("queue", "part").orderBy("source")))
    # kept as a table so that Spark knows its size: small, it is broadcast and the ids stay where they are
    runs = stored(inner.join(by_part, ["queue", "part"]).select("source", "part", "queue", (F.col("earlier") + F.col("inner")).alias("earlier")))
    totals = np.asarray([*sums.values()] or [1], np.int64)
    shares = np.asarray([*shares_of(sums, targets).values()] or [1.0])
    phases = np.asarray([zlib.crc32(b"%d" % q) % 997 + 1 for q in place.values()] or [1]) / 998  # rare queues of one turn are spread
    turns = Turns(totals, shares, phases, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                rows = batch.slice(i, 256)
                docs = [(d, q, at, ids) for d, q, at, ids in zip(*(c.to_pylist() for c in rows.columns), strict=True)]
                columns = list(zip(*cut(docs, turns), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 6 + [pa.binary()], strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = encoded.join(runs, ["source", "part"]).select("doc_id", "queue", (F.col("first") + F.col("earlier")).alias("at"), "ids")
    return placed.mapInArrow(run, PIECES).withColumn("doc_id", id_or_null("doc_id"))
