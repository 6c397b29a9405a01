"""License scan by diagonal voting.

All rolling K-word grams of the documents are joined with the positions of the
grams in the license templates: by their hashes, and then by the words
themselves, so that every vote is verified. A match at word p of a document and
at word t of a template votes for diagonal p - t. Votes are counted by diagonal,
diagonals at most NEAR apart are merged (words put in or left out move a text
from one diagonal to the next), and a span is a find when its votes cover
enough of the template's words: all of them, on one diagonal, for a template of
up to SHORT words; the share `least` of them for a longer one. A template
marked as base is a phrase whose words stand consecutively; each of its full
diagonals is a place.

Words are runs of digits, letters and characters beyond ASCII, after A-Z have
become lower case. Each document's words travel in pieces, so that a text of
any length is read in bounded memory; a piece starts with one empty gram, which
stands for the piece and carries its number of words to where the votes meet.

Null and empty texts have no words, no labels and score 0. Rows with equal
doc_ids are answered each, equal rows as often as they are there; null doc_ids
come back null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_words, whole_text

K, NEAR, SHORT, LEAST, PIECE = 3, 4, 8, 0.8, 4096


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    base: bool = False

    @property
    def needed(self) -> float:
        return 1.0 if len(self.words.split()) <= SHORT else LEAST


# Phrases of the contract, then names and grants of public licenses as their texts have them.
TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("epl", "eclipse public license"),
    Template("cc-by", "creative commons attribution license"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)


def pieces(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), at, n, words: up to PIECE words from word `at` on, behind K empty ones and before the K - 1 that follow."""

    def cut(text: str) -> Iterator[tuple[int, int, list[bytes]]]:
        """(at, n, words with those that follow) of each piece."""
        at, held = 0, []
        for words in lower_words(text):
            held += words
            while len(held) >= PIECE + K - 1:
                yield at, PIECE, held[: PIECE + K - 1]
                at, held = at + PIECE, held[PIECE:]
        yield at, len(held), held

    def flat(part: pa.RecordBatch, cuts: list[tuple[int, int, int, list[bytes]]]) -> pa.RecordBatch:
        rows, ats, sizes, lists = zip(*cuts, strict=True)
        ends = pa.array(np.cumsum([0, *(K + len(own) for own in lists)]), pa.int32())
        words = pa.array([w for own in lists for w in (*[b""] * K, *own)], pa.binary()).view(pa.string())
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(ats), pa.array(sizes), pa.ListArray.from_arrays(ends, words)], ["doc_id", "text_key", "at", "n", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, total = [], 0
            for row, text in enumerate(batch.column(2)):
                for at, n, own in cut(text.as_py()):
                    cuts.append((row, at, n, own))
                    total += len(own)
                    if total > 64 * PIECE:
                        yield flat(batch, cuts)
                        cuts, total = [], 0
            if cuts:
                yield flat(batch, cuts)

    text = whole_text("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, "doc_id long, text_key long, at long, n long, words array<string>")


WORDS = [f"w{i}" for i in range(K)]


def gram_positions(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """A row for each gram of each template, and one for the empty gram (template -1); a local relation, so that Spark knows its size before it chooses a join."""
    names = ["template", "t", "size", "label", "base", "needed", *WORDS]
    rows = [(-1, 0, 0, "", False, 1.0, *[""] * K)]
    for number, template in enumerate(templates):
        words = template.words.split()
        rows += [(number, t, len(words), template.label, template.base, template.needed, *words[t : t + K]) for t in range(len(words) - K + 1)]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.float64(), *[pa.string()] * K]
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names))


def votes(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """doc_id, text_key, template, t, diagonal and the template's columns for each match; a row with template -1 and n for each piece."""
    grams = F.arrays_zip(*((F.col("words") if i == 0 else F.slice("words", F.lit(i + 1), F.size("words"))).alias(w) for i, w in enumerate(WORDS)))
    rows = pieces(docs).select("doc_id", "text_key", "at", "n", F.posexplode(grams).alias("i", "g")).select("doc_id", "text_key", "at", "n", "i", *(F.col(f"g.{w}").alias(w) for w in WORDS))
    hashed = lambda df: df.withColumn("gram", F.xxhash64(*WORDS))
    there = hashed(gram_positions(docs.sparkSession, templates))
    met = hashed(rows.where(F.col(WORDS[-1]).isNotNull())).join(there, ["gram", *WORDS])
    return met.select("doc_id", "text_key", "template", "t", "size", "label", "base", "needed", F.when(F.col("template") >= 0, F.col("at") + F.col("i") - K - F.col("t")).otherwise(F.col("at")).alias("diagonal"), F.col("n"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, finds of every document.

    score: the largest share of a template's words that a span covers. finds:
    label, first and last word and share of each span found.
    """
    of = ["doc_id", "text_key"]
    shown = ["size", "label", "base", "needed"]
    rows = votes(docs, templates).repartition(*of)  # what follows needs no other shuffle
    whole = F.col("template") < 0
    by_diagonal = rows.groupBy(*of, "template", *shown, "diagonal").agg(
        F.collect_set("t").alias("ts"), F.sum(F.when(whole, F.col("n"))).alias("n"), F.count(F.when(whole & (F.col("diagonal") == 0), 1)).alias("copies")
    )
    line = Window.partitionBy(*of, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > NEAR, F.lit(False)) & ~whole
    spans = by_diagonal.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(line))
    full = ~whole & (F.size("ts") == F.col("size") - (K - 1))
    merged = spans.groupBy(*of, "template", *shown, "span").agg(
        F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"), F.count(F.when(full, 1)).alias("places"), F.min(F.when(full, F.col("diagonal"))).alias("first"), F.max(F.when(full, F.col("diagonal"))).alias("last"),
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("n").alias("n"), F.sum("copies").alias("copies"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + (K - 1))))))
    merged = merged.withColumn("share", F.when(~whole, F.when(F.col("places") > 0, 1.0).otherwise(covered / F.col("size"))))
    found = ~whole & F.when(F.col("needed") >= 1, F.col("places") > 0).otherwise(F.col("share") >= F.col("needed"))
    place = ~whole & F.col("base") & (F.col("places") > 0)
    names = lambda which: F.concat_ws(",", F.array_sort(F.collect_set(F.when(which, F.col("label")))))
    find = F.struct(F.col("label"), F.greatest(F.lit(0), F.col("low")).alias("first_word"), (F.col("high") + F.col("size") - 1).alias("last_word"), "share")
    out = merged.groupBy(*of).agg(
        F.sum("n").alias("n"), F.sum("copies").alias("copies"), F.coalesce(F.sum(F.when(place, F.col("places"))), F.lit(0)).alias("n_base"), F.min(F.when(place, F.col("first"))).alias("first_word"),
        F.max(F.when(place, F.col("last"))).alias("last_word"), names(place).alias("base_labels"), names(found).alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"), F.array_sort(F.collect_list(F.when(found, find))).alias("finds"),
    )
    each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return out.select("doc_id", (F.col("n") / F.col("copies")).cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "finds", each.alias("copy")).drop("copy")


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL for scan() without its finds, over documents with distinct doc_ids."""
    quoted = lambda x: f"'{x}'"
    values = ", ".join(f"({i}, {quoted(x.label)}, {x.base}, {x.needed}e0, string_split({quoted(x.words)}, ' '))" for i, x in enumerate(templates))
    gram = lambda words, at: " || ' ' || ".join(f"{words}[{at} + {i + 1}]" for i in range(K))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH templates AS (SELECT * FROM (VALUES {values}) AS v(template, label, base, needed, words)
), positions AS (SELECT template, label, base, needed, len(words) AS size, t, {gram("words", "t")} AS gram FROM (SELECT *, unnest(range(len(words) - {K - 1})) AS t FROM templates)
), texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), grams AS (SELECT doc_id, p, {gram("words", "p")} AS gram FROM (SELECT *, unnest(range(len(words) - {K - 1})) AS p FROM texts WHERE len(words) >= {K})
), by_diagonal AS (SELECT doc_id, template, any_value(label) AS label, any_value(base) AS base, any_value(needed) AS needed, any_value(size) AS size, p - t AS diagonal, list(DISTINCT t) AS ts FROM grams JOIN positions USING (gram) GROUP BY doc_id, template, p - t
), lagged AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {NEAR} THEN 1 ELSE 0 END AS apart FROM by_diagonal
), spans AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span, len(ts) = size - {K - 1} AS full_ FROM lagged
), merged AS (
  SELECT doc_id, template, span, any_value(label) AS label, any_value(base) AS base, any_value(needed) AS needed, any_value(size) AS size, flatten(list(ts)) AS ts, count(*) FILTER (WHERE full_) AS places,
    min(diagonal) FILTER (WHERE full_) AS first, max(diagonal) FILTER (WHERE full_) AS last FROM spans GROUP BY doc_id, template, span
), shares AS (SELECT *, CASE WHEN places > 0 THEN 1e0 ELSE CAST(len(list_distinct(flatten(list_transform(ts, lambda t: range(t, t + {K}))))) AS DOUBLE) / size END AS share FROM merged
), found AS (SELECT *, CASE WHEN needed >= 1 THEN places > 0 ELSE share >= needed END AS found FROM shares
), by_doc AS (
  SELECT doc_id, coalesce(sum(places) FILTER (WHERE base), 0) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(last) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base AND places > 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found) AS labels, max(share) AS score FROM found GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score
FROM texts t LEFT JOIN by_doc b ON t.doc_id = b.doc_id"""
