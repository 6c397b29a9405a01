"""Exact dedup with a minimal perfect hash over historical distinct digests.

History is indexed once: its distinct digests fall into buckets of bounded
size, and each bucket holds a minimal perfect hash (levels of collision-free
bits, ranked) whose slots carry the full digest and the winner's locator (the
smallest doc_id, with the number of rows). Arrivals are grouped by digest
first, then looked up: the slot's digest is compared byte by byte; members
join the slot's group and nonmembers form groups of their own.

Null texts count as empty. Rows with a null doc_id never win over real ids.
Every row is answered, also rows that repeat in doc_id and text: of these,
where they hold the smallest doc_id, one is kept. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, id_or_last, id_or_null, stored, whole_text

#: Distinct digests in one bucket of the index, on average.
BUCKET_DIGESTS = 20_000
SLOTS = "bucket long, levels binary, bits binary, digests binary, winners binary, counts binary"
CLASSES = "digest binary, keep long, rows long"


def normalised(text):
    """Each run of white space becomes one space; runs that are one space already stay untouched."""
    return F.regexp_replace(whole_text(text), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(id_or_last("doc_id").alias("doc_id"), F.unhex(F.sha2(normalised("text"), 256)).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """A row for each distinct digest, combined before the shuffle."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))


def with_bucket(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


# A minimal perfect hash over 32-byte digests, after Limasset et al. (2017).


def mixed(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of all four words of each digest, another one at each level."""
    with np.errstate(over="ignore"):
        x = np.full(len(words), level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(4):
            x = (x ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
        return x


def build(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of each level in the bit array, the bit array, the slot of each digest)."""
    starts, bits, left, base = [0], [], np.arange(len(words)), 0
    at = np.zeros(len(words), np.int64)
    while len(left):
        size = max(64, 2 * len(left))
        x = (mixed(words[left], len(starts)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(x, minlength=size) == 1
        done = alone[x]
        at[left[done]] = base + x[done]
        bits.append(alone)
        left, base = left[~done], base + size
        starts.append(base)
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    rank = np.cumsum(flat) - 1
    return np.asarray(starts, np.int64), flat, rank[at] if len(words) else at


def find(words: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The slot to compare for each digest, -1 where no level has its bit."""
    rank, slot, left = np.cumsum(flat) - 1, np.full(len(words), -1, np.int64), np.arange(len(words))
    for level in range(1, len(starts)):
        low, high = starts[level - 1], starts[level]
        at = low + (mixed(words[left], level) % np.uint64(high - low)).astype(np.int64)
        hit = flat[at]
        slot[left[hit]] = rank[at[hit]]
        left = left[~hit]
    return slot


def digest_words(column) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<u8").reshape(-1, 4)


def build_bucket(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    words = digest_words(table["digest"])
    starts, flat, slot = build(words)
    order = np.argsort(slot)
    return pa.table({
        "bucket": pa.array([table["bucket"][0].as_py()], pa.int64()),
        "levels": pa.array([starts.astype("<i8").tobytes()], pa.binary()),
        "bits": pa.array([np.packbits(flat).tobytes()], pa.binary()),
        "digests": pa.array([words[order].tobytes()], pa.binary()),
        "winners": pa.array([table["doc_id"].to_numpy()[order].astype("<i8").tobytes()], pa.binary()),
        "counts": pa.array([table["rows"].to_numpy()[order].astype("<i8").tobytes()], pa.binary()),
    })


def look_up(arrivals: pa.Table, index: pa.Table) -> pa.Table:
    """The classes of one bucket: its slots with the members that arrived, then the nonmembers."""
    words, first, rows = (digest_words(arrivals["digest"]), arrivals["doc_id"].to_numpy().copy(), arrivals["rows"].to_numpy().copy()) if len(arrivals) else (np.zeros((0, 4), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    held, winner, count = np.zeros((0, 4), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    member = np.zeros(len(words), bool)
    if len(index):
        row = index.to_pylist()[0]
        held = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
        winner, count = (np.frombuffer(row[k], "<i8").copy() for k in ("winners", "counts"))
        starts = np.frombuffer(row["levels"], "<i8")
        flat = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(starts[-1])).astype(bool)
        slot = find(words, starts, flat)
        member = slot >= 0
        member[member] = (held[slot[member]] == words[member]).all(axis=1)
        np.minimum.at(winner, slot[member], first[member])
        np.add.at(count, slot[member], rows[member])
    out = np.concatenate([held, words[~member]])
    return pa.table({
        "digest": pa.array([x.tobytes() for x in out], pa.binary()),
        "keep": pa.array(np.concatenate([winner, first[~member]]), pa.int64()),
        "rows": pa.array(np.concatenate([count, rows[~member]]), pa.int64()),
    })


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """The index over grouped() history: one row for each bucket, of bounded size."""
    return with_bucket(groups, buckets).groupBy("bucket").applyInArrow(build_bucket, SLOTS)


def resolve(arrivals: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Classes (digest, keep, rows) of the index's slots and of grouped() arrivals together."""
    return with_bucket(arrivals, buckets).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(look_up, CLASSES)


def dedup(docs: DataFrame, is_history=None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    is_history tells which rows the index is built from (by default every
    second doc_id by hash); the others are the arrivals. The result is the
    same for any choice.
    """
    rows = stored(digests(docs))
    history = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if is_history is None else is_history
    old, new = grouped(rows.where(history)), grouped(rows.where(~history))
    buckets = max(1, math.ceil(rows.count() / BUCKET_DIGESTS))
    classes = resolve(new, build_index(old, buckets), buckets)
    one = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))
    every = one.join(classes, "digest").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return every.select(
        id_or_null("doc_id").alias("doc_id"),
        F.when(F.col("keep") != NO_ID, F.col("keep")).alias("keep_id"),
        F.col("rows").alias("group_size"),
        ((F.col("doc_id") == F.col("keep")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d
"""
