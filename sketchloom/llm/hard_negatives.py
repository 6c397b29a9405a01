"""Hard-negative mining by segment summary filtering.

Vectors become whole numbers, floor(scale * x) for each component; a score is
the inner product, an exact integer. Each vector is stored with the mean and
the deviation of its segments of 64, of 16 and of 4 components. For segments a
and b of m components a . b lies within m * (mean_a * mean_b +- dev_a * dev_b),
so the sums over a level bound the score. A pair whose bounds miss all that its
anchor still looks for is dropped; the others go on to the next, narrower level
and at last to the exact product.

An anchor's positives are the best rows of its label. For each of them its
negatives are the best rows of other labels that score from `low` percent of
the positive's score up to that score. Both are one search: rows travel once
into parts of bounded size, blocks of anchors travel to every part and pass
through it one after another. The best of each part meet in a window.

Rows with a null vec_id, label or vector, or with a component that is null or
not finite (also after scaling), take no part. Vectors of unlike lengths are
filled up with zeros; an empty one scores 0 with all. Ties go to the smaller
vec_id. Rows with the anchor's own vec_id are not searched for it; otherwise
each row counts by itself, rows that repeat too, and anchors that share a
vec_id are mined one by one. A score beyond 64 bits counts as the largest (or
least) number of 64 bits. A negative positive score has no negatives. No rows,
no anchors or a single label give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SEGMENTS = (64, 16, 4)
#: Bytes of a tile's components as doubles; of the rows that one task holds, as they are stored; anchors of a block.
TILE_BYTES, PART_BYTES, ANCHORS = 1 << 20, 128 << 20, 256
LEAST, MOST = -(2**63), 2**63 - 1
BLOCK = "n int, dims int, ids binary, labels binary, depth string, vectors binary, summaries binary, keys binary, windows binary"


def summaries(vectors: np.ndarray) -> np.ndarray:
    """Means, then deviations, of the segments of each width, side by side."""
    out = []
    for width in SEGMENTS:
        parts = vectors.reshape(len(vectors), -1, width)
        out += [parts.mean(axis=2), parts.std(axis=2)]
    return np.concatenate(out, axis=1).astype(np.float32)


def packed(ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray], scale: float) -> dict:
    dims = max(SEGMENTS[0] * math.ceil(max(map(len, vectors), default=0) / SEGMENTS[0]), SEGMENTS[0])
    values = np.zeros((len(ids), dims))
    for i, v in enumerate(vectors):
        values[i, : len(v)] = np.floor(scale * v)
    depth = next(d for d in ("i1", "i2", "i4", "f8") if d == "f8" or np.abs(values).max(initial=0) <= np.iinfo(d).max)
    return {"n": len(ids), "dims": dims, "ids": ids.tobytes(), "labels": labels.tobytes(), "depth": depth, "vectors": values.astype(depth).tobytes(), "summaries": summaries(values).tobytes()}


@dataclass
class Block:
    """Rows of a tile or of a block of anchors, their components as doubles, and (mean, deviation) for each level."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    norms: np.ndarray

    @classmethod
    def of(cls, row: dict, dims: int) -> Block:
        n, own = row["n"], row["dims"]
        wide = lambda x, width: np.pad(x, ((0, 0), (0, (dims - own) // width)))
        vectors = wide(np.frombuffer(row["vectors"], row["depth"]).reshape(n, own).astype(float), 1)
        flat, levels, at = np.frombuffer(row["summaries"], np.float32).reshape(n, -1).astype(float), [], 0
        for width in SEGMENTS:
            k = own // width
            levels.append((wide(flat[:, at : at + k], width), wide(flat[:, at + k : at + 2 * k], width)))
            at += 2 * k
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), vectors, levels, np.sqrt((vectors * vectors).sum(axis=1)))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: by doubles while these hold every sum exactly, else by Python's integers."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
    found = whole(a) @ whole(b).T
    return np.array([[min(max(v, LEAST), MOST) for v in r] for r in found.tolist()], np.int64).reshape(len(a), len(b))


def screened(a: Block, b: Block, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of the pairs alive those whose score may lie between the anchor's low and high, narrowed level by level."""
    low, high = np.where(low <= float(LEAST), -np.inf, low), np.where(high >= float(MOST), np.inf, high)  # clipped scores stand for all beyond
    for width, (mean_a, dev_a), (mean_b, dev_b) in zip(SEGMENTS, a.levels, b.levels, strict=True):
        r, c = np.nonzero(alive.any(axis=1))[0], np.nonzero(alive.any(axis=0))[0]
        if not len(r):
            break
        with np.errstate(all="ignore"):  # bounds that are no numbers drop nothing
            middle = (mean_a[r] * width) @ mean_b[c].T
            spread = (dev_a[r] * width) @ dev_b[c].T
            spread += 0.5 + 4e-6 * np.outer(a.norms[r], b.norms[c])  # more than the rounding of stored summaries can move a bound
            ok = ~((middle + spread < low[r, None]) | (middle - spread > high[r, None]))
        if len(r) == len(a.ids) and len(c) == len(b.ids):
            alive &= ok
        else:
            alive[np.ix_(r, c)] &= ok
    return alive


def search(a: Block, windows: np.ndarray, tiles: list[dict], same_label: bool, keep: int) -> tuple[np.ndarray, ...]:
    """(anchor's place, window, vec_id, score): the best `keep` rows in each window (low, high) of each anchor; windows: anchors x windows x 2."""
    at, of, ids, scores = (np.zeros(0, np.int64) for _ in range(4))
    floor = windows[:, :, 0].copy()  # what a row has to reach by now
    for tile in tiles:
        b = Block.of(tile, a.vectors.shape[1])
        alive = ((a.labels[:, None] == b.labels[None, :]) == same_label) & (a.ids[:, None] != b.ids[None, :])
        alive = screened(a, b, alive, floor.min(axis=1).astype(float), windows[:, :, 1].max(axis=1).astype(float))
        r, c = np.nonzero(alive.any(axis=1))[0], np.nonzero(alive.any(axis=0))[0]
        if not len(r):
            continue
        score, alive = exact(a.vectors[r], b.vectors[c]), alive[np.ix_(r, c)]
        for k in range(windows.shape[1]):
            inside = alive & (score >= floor[r, k, None]) & (score <= windows[r, k, 1, None])
            if len(c) > keep:  # of a tile only what reaches its own best few, with all ties
                values = np.where(inside, score, LEAST)
                inside &= score >= np.partition(values, len(c) - keep, axis=1)[:, len(c) - keep, None]
            i, j = np.nonzero(inside)
            at, of, ids, scores = (np.concatenate(x) for x in ((at, r[i]), (of, np.full(len(i), k)), (ids, b.ids[c[j]]), (scores, score[i, j])))
        order = np.lexsort((ids, ~scores, of, at))  # ~score descends without leaving 64 bits
        group = at[order] * windows.shape[1] + of[order]
        nth = np.arange(len(group)) - np.searchsorted(group, group)
        order = order[nth < keep]
        at, of, ids, scores = at[order], of[order], ids[order], scores[order]
        full = nth[nth < keep] == keep - 1
        floor[at[full], of[full]] = np.maximum(floor[at[full], of[full]], scores[full])
    return at, of, ids, scores


def windows_of(scores: list[int], low: int) -> list[int]:
    """Low and high, in turn, of the windows from low percent of each score to the score."""
    return [x for s in scores for x in (min(max(-(-low * s // 100), LEAST), MOST), s)]


def blocks(rows: DataFrame, scale: float, low: int | None = None) -> DataFrame:
    """rows (vec_id, label, vector) packed into BLOCK rows; with low they are anchors (also anchor and the scores below which they look, all scores if none are given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, 8192 if low is None else ANCHORS)
                widest = int(np.diff(part.column(2).offsets.to_numpy()).max(initial=1))
                part = part.slice(0, max(1, TILE_BYTES // (8 * max(widest, 1))))
                at += len(part)
                lists = part.column(2)
                vectors = np.split(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(lists.offsets.to_numpy()))[:-1])
                out = packed(part.column(0).to_numpy(), part.column(1).to_numpy(), vectors, scale) | {"keys": b"", "windows": b""}
                if low is not None:
                    asked = [windows_of(s, low) or [LEAST, MOST] for s in part.column(4).to_pylist()]
                    most = max(map(len, asked))
                    out["keys"] = part.column(3).to_numpy().tobytes()
                    out["windows"] = np.asarray([w + [MOST, LEAST] * ((most - len(w)) // 2) for w in asked], np.int64).tobytes()
                yield pa.RecordBatch.from_pylist([out], SCHEMA)

    columns = ["vec_id", "label", "vector", *([] if low is None else ["anchor", "scores"])]
    return rows.select(columns).mapInArrow(run, BLOCK)


SCHEMA = pa.schema([("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("depth", pa.string()), ("vectors", pa.binary()), ("summaries", pa.binary()), ("keys", pa.binary()), ("windows", pa.binary())])


def best(tiles: DataFrame, parts: int, asked: DataFrame, same_label: bool, keep: int) -> DataFrame:
    """anchor, window, vec_id, score, rank: the best `keep` rows for each window of each anchor in the blocks asked."""
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "*")
    there = tiles.select(F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), *tiles.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["part"] != part:
                    part, held = row["part"], []
                if row["kind"] == 0:
                    held.append(row)
                elif held:
                    a = Block.of(row, max([row["dims"], *(t["dims"] for t in held)]))
                    windows = np.frombuffer(row["windows"], np.int64).reshape(len(a.ids), -1, 2)
                    at, of, ids, scores = search(a, windows, held, same_label, keep)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.frombuffer(row["keys"], np.int64)[at], of, ids, scores)], ["anchor", "window", "vec_id", "score"])

    met = there.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "kind")
    found = met.mapInArrow(run, "anchor long, window long, vec_id long, score long")
    nth = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= keep)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, vector)."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    tiles = stored(blocks(rows, scale))
    size = tiles.agg(F.sum(F.length("vectors") + F.length("summaries")).alias("bytes"), F.count("*").alias("n")).first()
    parts = max(1, math.ceil((size["bytes"] or 0) / PART_BYTES), min(size["n"], 2 * rows.sparkSession.sparkContext.defaultParallelism))
    anchors = stored(rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()))
    spread = max(1, math.ceil(anchors.count() / (4 * ANCHORS)))
    ask = lambda asking: blocks(asking.repartition(spread, "anchor"), scale, low)
    firsts = stored(best(tiles, parts, ask(anchors.withColumn("scores", F.array().cast("array<long>"))), True, positives))
    own = firsts.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("own"))  # `positives` at most
    found = best(tiles, parts, ask(anchors.join(own, "anchor").withColumn("scores", F.transform("own", lambda p: p["score"]))), False, negatives)
    pairs = firsts.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    pairs = pairs.select("anchor", (F.col("rank") - 1).cast("long").alias("window"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(found, ["anchor", "window"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def shifted_labels(vectors: DataFrame) -> DataFrame:
    """The embeddings table as rows, with every seventh label moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))


ORACLE = """WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5"""
