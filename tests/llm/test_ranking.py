"""Hard negatives, license scans and ranked search against brute-force versions and SQL, with every awkward case."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sketchloom.llm import hard_negatives, licenses, ranked_search

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_licenses", "op13_ranked_search"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r[c] for c in columns) for r in entry.queries()[name](spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr) and got


# 11. Hard negatives


def whole(vector, dims):
    return [math.floor(256 * x) for x in vector] + [0] * (dims - len(vector))


def brute_mined(rows, positives=5, negatives=5, low=80):
    fit = [(i, label, v) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)]
    dims = max((len(v) for _, _, v in fit), default=0)
    fit = [(i, label, whole(v, dims)) for i, label, v in fit]
    out = []
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    for anchor, label, a in (r for r in fit if r[0] % 100 == 0):
        scored = sorted((-clip(sum(x * y for x, y in zip(a, v, strict=True))), i, own) for i, own, v in fit if i != anchor)
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            near = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out += [(anchor, i, k + 1, n[1], -p, -n[0]) for k, n in enumerate(near)]
    return sorted(out)


MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives(spark, seed):
    rng = random.Random(seed)
    dims = [64, 5, 130][seed]
    centers = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, rng.randrange(3), [x + rng.gauss(0, 0.4) for x in rng.choice(centers)]) for i in range(500)]
    rows += [(1000 + i, i % 4, list(centers[0])) for i in range(40)]  # ties
    rows += [(-100, 1, centers[1]), (2001, None, centers[0]), (2002, 1, None), (2003, 1, [float("nan")] * dims), (2004, 1, [1.0, None]), (2005, 1, [float("inf")]), (2006, 2, [0.5]), (2007, 1, []), (None, 1, centers[0]), (2008, 1, [1e307])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>").withColumns({c: F.lit("clash") for c in ("anchor", "scores", "part", "score", "rank", "kind")}).repartition(5)
    got = sorted(tuple(r[c] for c in MINED) for r in hard_negatives.mine(frame, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_mined(rows) and got


def test_hard_negatives_beyond_doubles(spark):
    rng = random.Random(5)
    big = lambda: [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.choice([0, 8, 12, 200]) for _ in range(6)]
    rows = [(i, i % 3, big()) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>")
    assert sorted(tuple(r[c] for c in MINED) for r in hard_negatives.mine(frame, F.col("vec_id") % 100 == 0).collect()) == brute_mined(rows)


def test_hard_negatives_of_odd_tables(spark):
    kinds = "vec_id long, label int, vector array<float>"
    assert hard_negatives.mine(spark.createDataFrame([], kinds), F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(i, 1, [1.0, 2.0]) for i in range(30)], kinds)
    assert hard_negatives.mine(one, F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(one, F.col("vec_id") < 0).count() == 0
    twice = spark.createDataFrame([(0, 1, [1.0]), (0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (2, 2, [0.9])], kinds)
    found = hard_negatives.mine(twice, F.col("vec_id") == 0).collect()
    assert sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"]) for r in found) == sorted([(0, 1, 1, 2), (0, 1, 2, 2)] * 2)


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    for scale in (1.0, 1e-3, 1e6):
        rows = [rng.normal(rng.normal(0, 2), 1, 64) * scale for _ in range(60)]
        block = hard_negatives.Block.of(hard_negatives.packed(np.arange(60), np.zeros(60, np.int64), rows, 256.0), 64)
        scores = hard_negatives.exact(block.vectors, block.vectors)
        least, most = scores.min(axis=1).astype(float), scores.max(axis=1).astype(float)
        assert hard_negatives.screened(block, block, np.ones((60, 60), bool), least, most).all()
        dropped = ~hard_negatives.screened(block, block, np.ones((60, 60), bool), most, most)
        assert dropped.any() and not (dropped & (scores == scores.max(axis=1)[:, None])).any()


# 12. Licenses


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))


def brute_scan(text):
    words, places, labels, score, k = words_of(text), [], set(), 0.0, licenses.K
    base = set()
    for template in licenses.TEMPLATES:
        own = template.words.split()
        votes = defaultdict(set)
        for p in range(len(words) - k + 1):
            for t in range(len(own) - k + 1):
                if words[p : p + k] == own[t : t + k]:
                    votes[p - t].add(t)
        full = [d for d, ts in votes.items() if len(ts) == len(own) - k + 1]
        if template.base:
            assert sorted(full) == [p for p in range(len(words)) if words[p : p + len(own)] == own]
            places += full
            base |= {template.label} if full else set()
        spans, last = [], None
        for d in sorted(votes):
            if last is None or d - last > licenses.NEAR:
                spans.append([set(), False])
            spans[-1][0] |= votes[d]
            spans[-1][1] |= d in full
            last = d
        for ts, whole_ in spans:
            share = 1.0 if whole_ else len({t + i for t in ts for i in range(k)}) / len(own)
            score = max(score, share)
            if whole_ if len(own) <= licenses.SHORT else share >= licenses.LEAST:
                labels.add(template.label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


SCANNED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def license_texts():
    grant = licenses.TEMPLATES[14].words
    edited = grant.replace("free of charge ", "").replace("any person", "every single person")
    texts = [None, "", " \n", "Released under the MIT License.", "Under THE mit-license; under the MIT License", "Apache License, Version 2.0 (cc by-nc)", "CC BY-NC 4.0 cc by nc", "under the mit", "GNU General Public License, version 3", "GNU General Public License, version 4"]
    texts += [grant, f"x y {edited} z", grant[: len(grant) // 2], "é under the mit license İ", "under the apache license version 2 mit license version", "cc by " * 5000 + "nc", f"{'a b c ' * 3000}{edited}{' d e' * 900}", "under the mit license " * 3000]
    return texts


def test_licenses(spark):
    rows = [(i, t) for i, t in enumerate(license_texts())] + [(3, "Released under the MIT License."), (4, "another text, cc by nc"), (None, "cc by nc"), (None, "cc by nc"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("t", "n", "label", "words", "gram", "at", "copies", "span")}).repartition(4)
    got = sorted(((r["doc_id"], *(r[c] for c in SCANNED)) for r in licenses.scan(frame).collect()), key=repr)
    assert got == sorted(((i, *brute_scan(t)) for i, t in rows), key=repr)
    assert licenses.scan(frame.where("false")).count() == 0


def test_license_finds(spark):
    texts = dict(enumerate(license_texts()))
    frame = spark.createDataFrame([(k, texts[k]) for k in (3, 11)], "doc_id long, text string")
    finds = {r["doc_id"]: [(f["label"], f["first_word"], f["share"]) for f in r["finds"]] for r in licenses.scan(frame).collect()}
    assert finds[3] == [("mit", 1, 1.0)] and [f[0] for f in finds[11]] == ["mit"] and 0.8 <= finds[11][0][2] < 1


def test_licenses_of_other_templates(spark):
    frame = spark.createDataFrame([(1, "all rights are reserved by us"), (2, "no rights")], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(frame, (licenses.Template("own", "rights are reserved"),)).collect()}
    assert got == {1: "own", 2: ""}


# 13. Ranked search


def terms_of(text):
    return [t.translate(LETTERS) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_search(docs, items, k=10):
    own = [(i, Counter(terms_of(t))) for i, t in docs]
    n, length = sum(1 for _, c in own if c), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in own:
            m = 25 + 75 * c.total() * n // max(length, 1)
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(terms_of(text)).items() if t in c)
            if score > 0:
                scored.append((-score, doc if doc is not None else math.inf))
        out += [(item, r + 1, d if d != math.inf else None, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def searched(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=repr)


DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def test_ranked_search(spark):
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "γάμμα", "delta1", "É", "x", "the", "of", "İstanbul"]
    text = lambda n: " ".join(rng.choices(vocabulary, [1, 1, 1, 1, 1, 1, 20, 9, 1], k=n))
    docs = [(i, text(rng.choice([1, 5, 60]))) for i in range(300)] + [(400 + i, "the same, the SAME") for i in range(30)]  # ties
    docs += [(500, None), (501, ""), (502, "?!"), (None, "alpha alpha the same"), (None, "alpha alpha the same"), (503, "alpha"), (503, "alpha"), (504, text(30_000))]
    items = [(1, "alpha the Beta"), (2, "the the the same"), (3, None), (4, "?"), (5, "unseen words"), (None, "É γάμμα x"), (7, text(3000)), (1, "the same id again, alpha")]
    frame = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("n", "terms", "counts", "score", "rank", "item")}).repartition(6)
    asked = spark.createDataFrame(items, ITEMS).withColumn("rank", F.lit("clash"))
    want = brute_search(docs, items)
    assert searched(ranked_search.search(frame, asked)) == want
    assert searched(ranked_search.search(frame, asked, pass_terms=5)) == want  # an item a pass


def test_ranked_search_cuts_its_tables(monkeypatch):
    items = [{t: 1 + t % 3 for t in range(i, i + 40)} for i in range(0, 400, 7)]
    weights = {t: 1000 + t for t in range(500)}
    whole_ = ranked_search.blocks(items, weights)
    monkeypatch.setattr(ranked_search, "EXACT", 10**12)
    cut = ranked_search.blocks(items, weights)
    assert len(whole_[0].cuts) == 1 and len(cut[0].cuts) > 10
    tile = ranked_search.Tile(np.arange(3), np.asarray([40, 500, 7]), (np.asarray([2, 3, 1]), np.asarray([0, 5, 9, 100, 399, 12]), np.asarray([1, 2, 3, 400, 5, 6])), 100, 5000)
    assert all((tile.scores(a) == tile.scores(b)).all() for a, b in zip(whole_, cut, strict=True))


def test_ranked_search_of_odd_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], DOCS)
    assert ranked_search.search(none, spark.createDataFrame([(1, "a")], ITEMS)).count() == 0
    assert ranked_search.search(some, spark.createDataFrame([], ITEMS)).count() == 0
    assert ranked_search.search(spark.createDataFrame([(1, None), (2, "?")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)).count() == 0
