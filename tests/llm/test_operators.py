"""The ten operators against brute-force versions, on small tables with every awkward case."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sketchloom.llm import boosting, chat, components, decontaminate, exact_dedup, langid, packing, pii, simhash, suffix_dedup, token_lengths, toxicity
from sketchloom.llm.common import token_bytes, word_tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def awkward(rows, n=60):
    """Some real rows, then nulls, empty and long texts, copies, repeated rows and a hot source."""
    long = " ".join(r[1] for r in rows[:40])
    extra = [
        (1000, None, None, None, None), (1001, "", "en", "", 0), (1002, " \t\n", None, "src0", 3), (1003, long, "en", "src0", len(long)), (1004, long + " tail", "en", "src0", 0),
        (1005, rows[0][1], "fr", "src0", 1), (1006, rows[0][1].replace(" ", "  "), "fr", "src0", 1), (None, rows[1][1], "en", None, None), (None, "no id", "en", None, None),
        (1007, "1234 5678", None, "src0", 9), (1008, "😀 é İ ς", None, "x", 7), (1009, "a." * 3000 + "@" + "b." * 3000, "en", "x", 1), (1010, "1" * 9000, "en", "x", 1),
    ]
    return [*rows[:n], *extra, (1011, "twice the same row", "en", "src0", 1), (1011, "twice the same row", "en", "src0", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(awkward(rows), DOCS)
    clashing = ["digest", "bucket", "fp", "queue", "part", "ids", "core", "spans", "base", "toxic", "held_out", "score", "keep", "n_tokens"]
    return frame.withColumns({c: F.lit("clash") for c in clashing}).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false").cache()


def table(frame, *key):
    return sorted((tuple(r[k] for k in key) for r in frame.collect()), key=repr)


# 1. PII

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def sound(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if sound(k, m[0])]


PERSONAL = [
    "mail a.b+c@x-y.example.com, or d@e.f@g.hh and x@y", "at 1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.002.003.0004 or 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1111 and 4111 1111 1111 1112",
    "+1 (040) 555-0631 and +12345 and + 123456789", "é😀 4539578763621486@b.co 😀+49 30 1234567.", "a.bb@c.de%x@y.zz", "12 34", "card 4539  5787", "4539578763621486 4539578763621486 1",
]


def test_pii_base_spans(spark, docs, nothing):
    frame = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(PERSONAL)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    want = {(r["doc_id"], hashlib.sha256(",".join(base_spans(r["text"])).encode()).hexdigest()) for r in frame.collect()}
    got = pii.pii_digests(frame).collect()
    kinds = {r["doc_id"]: [sum(s.startswith(k + ":") for s in base_spans(r["text"])) for k in BASE] for r in frame.where("doc_id is not null").collect()}
    assert all([r[f"n_{k}"] for k in BASE] == kinds[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert {(r["doc_id"], r["base_sha256"]) for r in got} == want and len(got) == frame.count()
    for r in got:
        assert sum(r[f"n_{k}"] for k in BASE) + r["n_added"] == len([s for s in r["spans"].split(",") if s])
    assert pii.pii_digests(nothing).count() == 0


def test_pii_adds_what_looks_alike_and_redacts(spark):
    rng = random.Random(2)
    texts = [f"call +1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)} or the code {rng.randrange(10**11)} now" for _ in range(400)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = pii.find_pii(frame)
    assert all(len(r["base"]) == 1 for r in found.collect())
    clean = pii.redacted(frame, found).collect()
    assert all(r["text"].startswith("call [phone] or the code") for r in clean)


def test_pii_adds_what_no_pattern_says(spark):
    rng = random.Random(7)
    word = lambda n=1: " ".join("".join(rng.choices("abdeghilmnorstu", k=rng.randrange(3, 9))) for _ in range(n))
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    part = lambda: str(rng.randrange(256))

    def card():
        body = "4" + d(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    base = [lambda: f"{word()}.{d(2)}@{word()}.example.com", lambda: ".".join(part() for _ in range(4)), card, lambda: f"+1 ({d(3)}) 555-{d(4)}"]
    texts = [f"{word(9)} {base[i % 4]()} {word(6)}" for i in range(1200)] + [f"{word(9)} {d(9 + i % 4)} {word(6)}" for i in range(200)]
    hidden = [
        ("email", lambda: f"{word()}.{d(2)} (at) {word()} (dot) example (dot) com"), ("email", lambda: f"{word()}{d(1)}[at]{word()}[dot]com"), ("ip", lambda: "[.]".join(part() for _ in range(4))),
        ("phone", lambda: f"1 ({d(3)}) 555-{d(4)}"), ("phone", lambda: f"({d(3)}) 555-{d(4)}"), ("secret", lambda: f'"{rng.getrandbits(160):040x}"'), ("secret", lambda: f"{rng.getrandbits(128):032X}"),
    ]
    lead = {"secret": ' token = '}
    odd = [lambda: f"20{d(2)}-04-1{d(1)} 10.3{d(1)}", lambda: f"{d(1)}.{d(3)}.{d(3)}", lambda: f"order {d(9)}", lambda: f"{word(2).replace(' ', '/')}/{word(2).replace(' ', '/')}/{word()}", lambda: "-" * 40, lambda: "passwords: required", lambda: "x" * 50, lambda: "meet at noon dot the end"]
    planted = [(kind, f"{word(9)} {lead.get(kind, '')}{make()} {word(6)}") for _ in range(30) for kind, make in hidden]
    plain = [f"{word(9)} {odd[i % len(odd)]()} {word(6)}" for i in range(240)]
    frame = spark.createDataFrame(list(enumerate([*texts, *(t for _, t in planted), *plain])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(frame).collect()}
    hits = [[pii.KINDS[a["kind"]] for a in got[len(texts) + i]["added"]] == [kind] for i, (kind, _) in enumerate(planted)]
    assert sum(hits) >= 0.9 * len(hits)
    assert not any(r["added"] for i, r in got.items() if i < len(texts) or i >= len(texts) + len(planted))
    for i, (kind, text) in enumerate(planted):
        if kind == "secret" and hits[i]:
            a = got[len(texts) + i]["added"][0]
            assert re.fullmatch("[0-9a-fA-F]+", text[a["first"] : a["last"]])


def test_pii_of_a_text_full_of_contacts(spark):
    rng = random.Random(3)
    line = lambda i: f"mail joe.{i}@example{i % 7}.com or +1 (040) 555-{1000 + i % 9000} order {10**9 + i * 7919} at {i % 256}.2.3.4"
    text = "\n".join(map(line, range(6000)))  # quadratic steps would take minutes
    plain = [(i, f"call +1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)} or the code {rng.randrange(10**11)} now") for i in range(50)]
    got = {r["doc_id"]: r for r in pii.pii_digests(spark.createDataFrame([*plain, (99, text)], "doc_id long, text string")).collect()}
    assert got[99]["base_sha256"] == hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest()
    assert (got[99]["n_email"], got[99]["n_ip"]) == (6000, 6000)


@pytest.mark.parametrize("n", [1, 255, 256, 257, 700])
def test_running_results(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(-5, 1000) for _ in range(n)]
    frame = spark.createDataFrame([(values,), ([],)], "v array<int>")
    plus, most = pii.running(F.col("v"), F.lit(0), lambda a, b: a + b), pii.running(F.col("v"), F.lit(-9), F.greatest)
    rows = frame.select(plus.alias("plus"), most.alias("most")).collect()
    assert rows[0]["plus"] == np.cumsum(values).tolist() and rows[0]["most"] == np.maximum.accumulate(values).tolist() and rows[1]["plus"] == rows[1]["most"] == []


def test_pii_hits(spark):
    rng = random.Random(4)
    base = [(0, a, a + rng.randrange(1, 30)) for a in (rng.randrange(3000) for _ in range(120))]
    asked = [(a, a + rng.randrange(1, 30)) for a in (rng.randrange(3100) for _ in range(400))]
    frame = spark.createDataFrame([(base, asked), ([], asked[:5])], "base array<struct<kind:int,first:int,last:int>>, asked array<struct<first:int,last:int>>")
    found = frame.select(pii.let(pii.reach(F.col("base")), lambda b: F.transform("asked", lambda c: pii.hit(b, c))).alias("h")).collect()
    assert found[0]["h"] == [any(f < d and c < e for _, f, e in base) for c, d in asked] and found[1]["h"] == [False] * 5


def test_pii_spans_apart(spark):
    spans = [(4, 0, 10, 0.9), (3, 5, 12, 0.95), (0, 12, 20, 0.9), (1, 12, 20, 0.9), (2, 30, 31, 0.6)]
    frame = spark.createDataFrame([(spans,), ([],)], "s array<struct<kind:int,first:int,last:int,score:double>>")
    assert [[tuple(x) for x in r["a"]] for r in frame.select(pii.apart(F.col("s")).alias("a")).collect()] == [[(3, 5, 12), (0, 12, 20), (2, 30, 31)], []]


def test_boosting_in_sql_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (500, 3)).astype(float)
    model = boosting.Booster(rounds=5).fit(x, ((x[:, 0] > 4) & (x[:, 1] < 6)).astype(float))
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    got = [r["s"] for r in frame.select("i", model.column([F.col(c) for c in "abc"]).alias("s")).orderBy("i").collect()]
    assert np.allclose(got, model.score(x)) and model.score(x)[(x[:, 0] > 4) & (x[:, 1] < 6)].min() > 0.5
    assert boosting.threshold(np.array([0.9, 0.8, 0.3]), np.array([1, 1, 0]), 1.0) == 0.8
    assert boosting.threshold(np.zeros(0), np.zeros(0), 0.9) > 1


# 2. Exact dedup


def test_exact_dedup(docs, nothing):
    groups = {}
    for r in docs.collect():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        groups.setdefault(key, []).append(r["doc_id"])
    want = []
    for key, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        keep = ids[0]
        want += [(doc, keep, len(ids), n == 0, hashlib.sha256(key.encode()).hexdigest()) for n, doc in enumerate(ids)]
    for history in (None, F.lit(True), F.lit(False)):
        got = exact_dedup.dedup(docs, history)
        assert table(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.dedup(nothing).count() == 0


def test_exact_dedup_of_repeated_rows(spark, tmp_path):
    rows = [(2, "a b"), (2, "a  b"), (2, "a b"), (1, "c"), (None, "a b"), (None, "d"), (None, "d"), (3, None), (4, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["op2_exact_dedup"](spark, str(tmp_path))
    want = duckdb.sql(exact_dedup.ORACLE.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert table(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr) and len(want) == len(rows)
    assert got.where("kept").count() == got.select("text_sha256").distinct().count() == 4


def test_minimal_perfect_hash():
    words = np.random.default_rng(0).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    starts, flat, slot = exact_dedup.build(words)
    assert sorted(slot.tolist()) == list(range(5000)) and (exact_dedup.find(words, starts, flat) == slot).all()
    assert len(exact_dedup.build(words[:0])[2]) == 0


# 3. SimHash


def fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, pairs):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {i: top(i) for i in ids}


def test_simhash(docs, nothing):
    want = {}
    rows = docs.select("doc_id", "text").distinct().collect()
    prints = [(2**63 - 1 if r["doc_id"] is None else r["doc_id"], fingerprint(r["text"])) for r in rows]
    order = sorted(range(len(prints)), key=lambda i: prints[i][0])
    top = roots(range(len(order)), [(a, b) for a in range(len(order)) for b in range(a) if (prints[order[a]][1] ^ prints[order[b]][1]).bit_count() <= 3])
    for at, i in enumerate(order):
        doc, fp = prints[i]
        first = prints[order[top[at]]][0]
        want[doc, f"{fp:016x}"] = first
    got = {(2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"]): 2**63 - 1 if r["component_id"] is None else r["component_id"] for r in simhash.near_dedup(docs).collect()}
    assert got == want
    assert simhash.near_dedup(nothing).count() == 0


def test_near_finds_every_link(spark, monkeypatch):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(300)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for v in values for _ in range(2)]
    values += [values[0] ^ 1 << i ^ 1 << j for i in range(12) for j in range(i)]
    values = list(dict.fromkeys(values))
    monkeypatch.setattr(simhash, "BLOCK", 16)
    signed = [v - (v >> 63 << 64) for v in values]
    links = simhash.near(spark.createDataFrame([(v,) for v in signed], "fp long"))
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    order = sorted(range(len(signed)), key=lambda i: signed[i])
    top = roots(range(len(order)), [(a, b) for a in range(len(order)) for b in range(a) if (values[order[a]] ^ values[order[b]]).bit_count() <= 3])
    want = {signed[order[a]]: signed[order[top[a]]] for a in top}
    assert {v: got.get(v, v) for v in signed} == want


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 700)}


# 4. Language, 10. toxicity


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language(spark, rows, docs, nothing):
    got = langid.identify(docs, langid.train(docs)).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1000, 1001, 1002, 1007, 1010))
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["held_out"] == held(r["doc_id"]) for r in got if r["doc_id"] is not None)
    frame = spark.createDataFrame(rows, DOCS)
    out = langid.identify(frame, langid.train(frame)).join(frame.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    empty = langid.train(nothing)
    assert langid.identify(nothing, empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}


def test_toxicity(spark, docs, nothing):
    rng = random.Random(6)
    made = []
    for i in range(900):
        bad = i % 3 == 0
        sentences = [" ".join(rng.choices(["the", "of", "than", "onre", "tion", "edly", "wh"], k=8)) for _ in range(6)]
        if bad:
            sentences[i % 6] += " you " + rng.choice(["zonk", "blarg"])
        made.append((i, ". ".join(sentences) + ".", int(bad)))
    frame = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    labels = spark.createDataFrame([(m[0], m[2]) for m in made] + [(5000, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(frame, toxicity.train(frame, labels)).collect()}
    test = [m for m in made if held(m[0])]
    assert sum(got[m[0]]["predicted"] == m[2] for m in test) >= 0.97 * len(test)
    for doc, text, bad in test:
        if bad and got[doc]["offending"]:
            assert all(re.search("zonk|blarg", text[s["first"] : s["last"]]) for s in got[doc]["offending"])
    out = toxicity.score(docs, toxicity.train(docs, labels.where("false"))).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(nothing, (-5.0, {})).count() == 0


def folded(text):
    """The letters' classes of a text, one break for all that lies between."""
    code = lambda c: (ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37) if c.isalpha() else 0
    out = [0]
    for c in map(code, text.lower()):
        out += [c] if c or out[-1] else []
    return out + ([0] if out[-1] or len(out) == 1 else [0])


def presence_kernel(a, b):
    total = 0.0
    for n in (1, 2, 3):
        x, y = ({tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for t in (a, b))
        total += len(x & y) / max(1, np.sqrt(len(x))) / max(1, np.sqrt(len(y))) / 3
    return total


def test_language_equals_a_naive_kernel_ridge(rows):
    texts = [(r[2], r[1][:600]) for r in rows[:48] if r[2]]
    sets = [np.unique(langid.grams(t)) for _, t in texts]
    model = langid.fit([k for k, _ in texts], sets, landmarks=12)
    names = sorted({k for k, _ in texts})
    turn = {k: [i for i, (x, _) in enumerate(texts) if x == k] for k in names}
    marks = [turn[k][j] for j in range(len(texts)) for k in names if j < len(turn[k])][:12]
    forms = [folded(t) for _, t in texts]
    k_mm = np.asarray([[presence_kernel(forms[i], forms[j]) for j in marks] for i in marks])
    k_nm = np.asarray([[presence_kernel(f, forms[j]) for j in marks] for f in forms])
    value, vector = np.linalg.eigh(k_mm + 1e-6 * np.eye(len(marks)))
    white = vector @ np.diag(1 / np.sqrt(value))
    phi, target = k_nm @ white, np.asarray([[1.0 if k == n else -1.0 for n in names] for k, _ in texts])
    beta = np.linalg.solve(phi.T @ phi + langid.RIDGE * len(texts) / 100 * np.eye(len(marks)), phi.T @ target)
    for text in [rows[50][1], rows[60][1][:80], "é", "abc " + rows[3][1][:200]]:
        values = np.asarray([presence_kernel(folded(text), forms[j]) for j in marks]) @ white @ beta
        name, score = model.scorer()([text])[0]
        assert name == names[values.argmax()] and abs(score - np.clip((1 + values.max()) / 2, 0, 1)) < 1e-3


def test_language_learns_all_labels(spark):
    rng = random.Random(3)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 5)) for _ in range(60)]
    made = [(i, " ".join("".join(rng.choices(alphabets[i % 60], k=6)) for _ in range(40)), f"l{i % 60:02d}") for i in range(1200)]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string").withColumn("count", F.lit("clash")).withColumn("limit", F.lit("clash"))
    model = langid.train(frame, sample=50)
    assert model.languages == sorted({m[2] for m in made if not held(m[0])} & set(model.languages)) and len(model.languages) >= 30
    assert len(langid.train(frame, sample=10**6).languages) == 60


def naive_sentences(text):
    out, words, first = [], [], None
    for m in re.finditer(r"[^.!?\n]+", text):
        found = re.findall(r"[^\W_]+", m[0].lower())
        if found:
            first, last, words = (m.start() if first is None else first), m.end(), words + found
            if len(words) >= toxicity.SHORT:
                out.append((first, last, set(words)))
                first, words = None, []
    return out + ([(first, last, set(words))] if words else [])


def naive_features(word):
    return [zlib.crc32(m.encode()) for m in ["=" + word] + ["^" + word[:n] for n in (3, 4, 5, 6) if len(word) >= n]]


def test_toxicity_equals_a_naive_noisy_or(spark, rows, docs):
    rng = random.Random(4)
    texts = [r[1][:400] + (" you zonk. " if i % 3 == 0 else "") for i, r in enumerate(rows[:60])]
    labels = np.asarray([float(i % 3 == 0) for i in range(60)])
    bias, weight = toxicity.fit(texts, labels, rounds=5)
    bags = [[w for _, _, w in naive_sentences(t)] for t in texts]
    of = {f: {i for i, b in enumerate(bags) for s in b for w in s if f in naive_features(w)} for f in {f for b in bags for s in b for w in s for f in naive_features(w)}}
    theta, squares, b0, b2 = dict.fromkeys((f for f in of if len(of[f]) >= toxicity.COMMON), 0.0), dict.fromkeys(of, 1.0), -7.0, 1.0
    for _ in range(5):
        g, gb = dict.fromkeys(theta, 0.0), 0.0
        for y, bag in zip(labels, bags, strict=True):
            z = [b0 + sum(theta.get(f, 0.0) for w in s for f in naive_features(w)) for s in bag]
            stay = np.prod([1 / (1 + np.exp(v)) for v in z])
            share = len(labels) / 2 / (labels.sum() if y else len(labels) - labels.sum())
            for s, v in zip(bag, z, strict=True):
                slope = share / (1 + np.exp(-v)) * (-stay / (1 - stay) if y else 1.0)
                gb += slope
                for w in s:
                    for f in naive_features(w):
                        if f in g:
                            g[f] += slope
        for f in theta:
            squares[f] += g[f] ** 2
            step = 0.3 / np.sqrt(squares[f])
            v = theta[f] - step * g[f]
            theta[f] = np.sign(v) * max(abs(v) - step * 0.6, 0.0)
        b2 += gb * gb
        b0 -= 0.3 * gb / np.sqrt(b2)
    want = {f: v for f, v in theta.items() if abs(v) > 1e-4}
    assert abs(bias - b0) < 1e-6 and set(weight) == set(want) and all(abs(weight[f] - v) < 1e-6 for f, v in want.items()) and want
    model = (-3.0, {f: rng.uniform(-2, 2) for f in of})
    for r in toxicity.score(docs, model).collect():
        text = {d["doc_id"]: d["text"] for d in docs.where(F.col("doc_id") == r["doc_id"]).collect()}.get(r["doc_id"]) if r["doc_id"] in (1000, 1001, 1005, 1008, 1009, 3, 7) else False
        if text is not False:
            p = [1 / (1 + np.exp(-min(30, model[0] + sum(model[1].get(f, 0.0) for w in s for f in naive_features(w))))) for _, _, s in naive_sentences(text or "")]
            assert abs(r["score"] - (1 - np.prod([1 - min(x, 1 - 1e-12) for x in p]))) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5)


def test_toxicity_places_and_odd_labels(spark):
    text = "İİİİİİ. a b c d e f g h. you zonk and all the rest now. fine"
    got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), (-5.0, {zlib.crc32(b"=zonk"): 12.0})).first()
    assert [text[s["first"] : s["last"]] for s in got["offending"]] == [" you zonk and all the rest now"]
    texts = [(i, f"some words and more {'zonk' if i % 2 else 'of'} in line {i % 5}") for i in range(200)]
    labels = [(i, t, "clash") for i, _ in texts for t in ((1, 0) if i % 2 else (0, None, 7))]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int, text string"))
    assert all(r["predicted"] == r["doc_id"] % 2 for r in toxicity.score(frame, model).collect())


# 5. Token counts, 9. packing


def encoded(texts):
    return [e.ids for e in token_bytes(word_tokenizer_path()).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_lengths(docs, nothing):
    lengths = [len(x) for x in encoded([r["text"] for r in docs.collect()])]
    want = []
    for n in sorted(set(lengths)):
        from_n = [x for x in lengths if x >= n]
        want.append((n, lengths.count(n), len(from_n), sum(from_n), sum(min(x, n) for x in lengths)))
    got = token_lengths.length_report(docs, word_tokenizer_path())
    assert sorted(tuple(r[k] for k in ("n_tokens", "n_docs", "docs_from", "tokens_from", "truncated_total")) for r in got.collect()) == want
    assert token_lengths.length_report(nothing, word_tokenizer_path()).count() == 0


@pytest.mark.parametrize(("size", "targets"), [(4096, None), (64, None), (512, {"src0": 0.5, "src1": 0.3})])
def test_packing(docs, size, targets):
    rows = docs.select("doc_id", "text", "source").where("doc_id is not null").distinct().collect()
    ids = {r["doc_id"]: np.asarray([*x, packing.END_ID], "<u4") for r, x in zip(rows, encoded([r["text"] for r in rows]), strict=True)}
    source = {r["doc_id"]: r["source"] or "" for r in rows}
    pieces = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), word_tokenizer_path(), size, targets).collect()
    for doc, own in ids.items():
        parts = sorted((p for p in pieces if p["doc_id"] == doc), key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in parts) == own.tobytes() and [p["start"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts)])[:-1].tolist()
        assert all(p["doc_tokens"] == len(own) and len(p["ids"]) == 4 * p["length"] > 0 for p in parts)
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append(p)
    total = sum(map(len, ids.values()))
    assert sorted(windows) == list(range(-(-total // size)))
    for k, parts in windows.items():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts)])[:-1].tolist()
        assert sum(p["length"] for p in parts) == min(size, total - k * size)
    if targets is None:  # every window prefix has each source's share: a rare one to a turn, the others to their part of those turns
        shares = {s: sum(len(ids[d]) for d in ids if source[d] == s) / total for s in set(source.values())}
        served, turn = dict.fromkeys(shares, 0), min(packing.TURN, size // 16)
        rare = {s for s in shares if shares[s] * size < turn}
        slack = {s: 2 + len(shares) / 2 + (turn if s in rare else shares[s] * turn * len(rare)) for s in shares}
        for k in sorted(windows):
            for p in windows[k]:
                served[source[p["doc_id"]]] += p["length"]
            done = min(total, (k + 1) * size)
            assert all(abs(served[s] - shares[s] * done) <= slack[s] for s in shares)


def dealt(lengths, size, shares=None):
    """The windows of documents of these lengths (by queue), packed by Turns alone: a list of (queue, document, tokens) for each window."""
    totals = np.asarray([sum(x) for x in lengths], np.int64)
    turns = packing.Turns(totals, totals / totals.sum() if shares is None else shares, np.asarray([(7 * q % 11 + 1) / 13 for q in range(len(totals))]), size)
    batch = [((q, i), q, sum(own[:i]), np.arange(n, dtype="<u4").tobytes()) for q, own in enumerate(lengths) for i, n in enumerate(own)]
    out = {}
    for (q, i), start, length, total, window, offset, ids in packing.cut(batch, turns):
        assert np.frombuffer(ids, "<u4").tolist() == list(range(start, start + length)) and total == lengths[q][i]
        out.setdefault(window, []).append((offset, q, i, start, length))
    full = int(totals.sum())
    assert sorted(out) == list(range(-(-full // size)))
    for k, parts in out.items():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *(p[4] for p in parts)])[:-1].tolist() and sum(p[4] for p in parts) == min(size, full - k * size)
    pieces = sorted((q, i, start, length) for parts in out.values() for _, q, i, start, length in parts)
    for q, own in enumerate(lengths):
        for i, n in enumerate(own):
            mine = [(s, m) for a, b, s, m in pieces if (a, b) == (q, i)]
            assert sum(m for _, m in mine) == n and all(s + m == t for (s, m), (t, _) in zip(mine, mine[1:], strict=False))
    return out, turns


def brute_order(turns):
    """Tokens by turn in due order, one by one: the queue of each token of the whole stream."""
    every = sorted((float(turns.due(np.asarray([b]), np.asarray([q]))[0]), q, b) for q in range(len(turns.totals)) for b in range(int(turns.many[q])))
    stream = []
    for _, q, b in every:
        stream += [q] * int(min(turns.turn[q], turns.totals[q] - b * turns.turn[q]))
    return stream


@pytest.mark.parametrize("seed", range(6))
def test_turns_equal_the_order_they_fall_due(seed):
    rng = random.Random(seed)
    lengths = [[rng.randrange(1, 400) for _ in range(rng.choice([1, 2, 30]))] for _ in range(rng.randrange(1, 9))]
    shares = None if seed % 2 else np.asarray([rng.random() for _ in lengths])
    out, turns = dealt(lengths, 256, shares)
    stream = brute_order(turns)
    for k, parts in out.items():
        want = stream[256 * k : 256 * (k + 1)]
        assert all(sum(p[4] for p in parts if p[1] == q) == want.count(q) for q in range(len(lengths)))


def test_packing_of_many_sources():
    rng = random.Random(1)
    lengths = [[rng.randrange(50, 900) for _ in range(rng.randrange(1, 6))] for _ in range(300)]
    out, turns = dealt(lengths, 4096)
    served, full = np.zeros(300), turns.totals.sum()
    for k in sorted(out):
        for _, q, _, _, length in out[k]:
            served[q] += length
        assert (np.abs(served - turns.totals / full * min(full, (k + 1) * 4096)) <= packing.TURN + 2).all()


def test_packing_of_a_long_document_in_a_rare_source():
    import tracemalloc

    totals = np.asarray([10**11, 10_000, 10**11 // 3], np.int64)  # a share of 1e-7
    turns = packing.Turns(totals, totals / totals.sum(), np.asarray([0.3, 0.5, 0.7]), 4096)
    tracemalloc.start()
    pieces = list(packing.cut([(1, 1, 0, np.arange(10_000, dtype="<u4").tobytes())], turns))
    assert sum(p[2] for p in pieces) == 10_000 and len(pieces) <= 2 * (10_000 // packing.TURN + 1)
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()


def test_target_shares():
    of = packing.shares_of
    corpus = {"a": 200, "b": 300, None: 500}
    assert of(corpus, {}) == {"a": 0.2, "b": 0.3, None: 0.5}
    assert of(corpus, {"a": 0.5}) == pytest.approx({"a": 0.5, "b": 0.1875, None: 0.3125})
    assert of(corpus, {"a": 0.0, "absent": 0.7}) == pytest.approx({"a": 0.0, "b": 0.375, None: 0.625})
    assert of(corpus, {"a": 0.4, "b": 0.6}) == pytest.approx({"a": 0.4, "b": 0.6, None: 0.0})
    assert of({"a": 1, "b": 3}, {"a": 0.1, "b": 0.3}) == pytest.approx({"a": 0.25, "b": 0.75})
    assert of({"a": 1, "b": 3}, {"a": 0.0, "b": 0.0}) == {"a": 0.25, "b": 0.75}
    assert of({}, {"a": 0.5}) == {}
    for wrong in ({"a": -0.1}, {"a": 0.6, "b": 0.6}, {"a": float("nan")}):
        with pytest.raises(ValueError, match="shares"):
            of(corpus, wrong)


@pytest.mark.parametrize("targets", [{"a": 0.5}, {"a": 0.0}, {"a": 0.1, "b": 0.8}, {"a": 1.0}, {"a": 0.0, "b": 0.0}])
def test_every_window_holds_the_targets(targets):
    rng = random.Random(2)
    lengths = [[rng.randrange(1, 900) for _ in range(n)] for n in (60, 100, 160)]
    shares = packing.shares_of(dict(zip("abc", map(sum, lengths), strict=True)), targets)
    out, turns = dealt(lengths, 1024, np.asarray([shares[s] for s in "abc"]))
    given, live = np.zeros(3), np.ones(3, bool)
    for k in sorted(out):
        before = given.copy()
        for _, q, _, _, length in out[k]:
            given[q] += length
        if (given < turns.totals).all():  # no queue has run dry: the window holds the shares to a token or two
            got = (given - before) / 1024
            assert all(abs(got[q] - shares[s]) <= 2.5 / 1024 for q, s in enumerate("abc")), (k, got, shares)
        live = given < turns.totals
        zero = [q for q, s in enumerate("abc") if shares[s] == 0]
        assert all(given[q] == 0 for q in zero) or not live[[q for q in range(3) if q not in zero]].any()


def test_packing_ranks_sources_by_tokens(spark):
    rows = [(i, "w " * 3, f"many{i % 40}") for i in range(400)] + [(1000, "w " * 20_000, "huge")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    pieces = packing.pack(frame, word_tokenizer_path(), 64).collect()  # 64 queues are more than there are sources
    few = packing.pack(frame, word_tokenizer_path(), 16).collect()  # the huge source is among the 16 largest
    for size, found in ((64, pieces), (16, few)):
        total = sum(p["length"] for p in found)
        share = sum(p["length"] for p in found if p["doc_id"] == 1000) / total
        served = Counter()
        for p in found:
            if p["doc_id"] == 1000:
                served[p["sequence_id"]] += p["length"]
        assert share > 0.9 and all(served[k] > 0 for k in range(total // size))  # in the joint queue it would come all at once
        assert sum(p["doc_id"] == 1000 and p["start"] == 0 for p in found) == 1


def test_packing_of_odd_tables(docs, nothing):
    assert packing.pack(nothing, word_tokenizer_path()).count() == 0
    assert packing.pack(docs, word_tokenizer_path()).where("start = 0").count() == docs.count()


def test_token_bytes_equals_the_tokenizer(rows):
    memo = token_bytes(word_tokenizer_path())
    texts = [r[1] for r in rows] + ["it's DON'T a,b. c.. <|endoftext|>x 12 É é ́x \x1c q\r\n\x0b z", "", " ", "ǅ İ ß ſ ς Σ", "x" * 100 + " ÀÇ."]
    assert [np.frombuffer(memo.of(t), "<u4").tolist() for t in texts] == encoded(texts)


def test_token_bytes_of_other_tokenizers_and_very_long_texts(rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = [r[1] or "" for r in rows[:60]] + [" a  b", "A\n\nB", ""]
    memo, other = token_bytes(public.path("byte_bpe_50k.json")), Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert not memo.by_word and [np.frombuffer(memo.of(t), "<u4").tolist() for t in texts] == [other.encode(t, add_special_tokens=False).ids for t in texts]
    word = token_bytes(word_tokenizer_path())
    long = " ".join(texts)
    long = (long + " ") * (1_200_000 // len(long) + 1)
    assert word.by_word and np.frombuffer(word.of(long), "<u4").tolist() == encoded([long])[0]


@pytest.mark.parametrize("text", ["a <|ENDOFTEXT|> b", "a <|EndOfText|> b <|endoftext|> C.", "<|STARTOFTEXT|>x", "<| It's <|endofTEXT|>."])
def test_token_bytes_of_special_spellings(text):
    assert np.frombuffer(token_bytes(word_tokenizer_path()).of(text), "<u4").tolist() == encoded([text])[0]


# 6. Suffix dedup


def test_suffix_dedup(spark, rows, nothing):
    rng = random.Random(8)
    shared = ["".join(rng.choices("abcdef ", k=n)) for n in (99, 100, 101, 260)]
    texts = [(i, r[1]) for i, r in enumerate(rows[:40])]
    texts += [(100 + i, "".join(rng.choices("ghijk", k=rng.randrange(150))) + rng.choice(shared) + "".join(rng.choices("lmnop é", k=rng.randrange(150)))) for i in range(60)]
    texts += [(200, "a" * 500), (201, "ab" * 200), (202, ""), (203, texts[3][1]), (204, texts[5][1][:50] + "#" + texts[5][1][51:])]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removal_digests(frame).collect()}
    assert got == suffix_dedup.brute_force(texts)
    assert suffix_dedup.removal_digests(nothing).count() == 0


def test_suffix_dedup_answers_every_row(spark, tmp_path):
    rng = random.Random(12)
    x, y, z = ("".join(rng.choices("abcdef ", k=300)) for _ in range(3))
    texts = [(2, x), (2, y + x[:150]), (2, x), (None, z), (None, y), (None, "short"), (None, None), (1, y[:120] + z[100:250])]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted((2**63 - 1 if d is None else d, t or "") for d, t in texts)
    brute = suffix_dedup.brute_force([(i, t) for i, (_, t) in enumerate(order)])
    want = sorted(((None if d == 2**63 - 1 else d, *brute[i]) for i, (d, _) in enumerate(order)), key=repr)
    got = entry.queries()["op6_suffix_dedup"](spark, str(tmp_path))
    assert table(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_suffix_dedup_of_long_texts_and_awkward_rows(spark, docs):
    bounds = suffix_dedup.Bounds(part=257)
    text = "".join(random.Random(9).choices("abcdef ", k=3000))
    texts = [(1, text), (2, text[500:900] + "!" + text[100:1700])]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    data = np.frombuffer(text.encode(), np.uint8)
    windows = sorted(w for at, part in suffix_dedup.parts(data, 257) for _, _, first, many in [suffix_dedup.minimizers(part)] for a, n in zip(first, many, strict=True) for w in range(at + a, at + a + n))
    assert windows == list(range(len(text) - 99))
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.removal_digests(rows, bounds).collect()}
    assert got == {k: v[1] for k, v in suffix_dedup.brute_force(texts).items()}
    assert suffix_dedup.removal_digests(docs).count() == docs.count()


@pytest.mark.parametrize(("held", "crowd"), [(50, 2), (1 << 20, 2), (300, 4)])
def test_suffix_dedup_of_what_all_share(spark, held, crowd):
    bounds = suffix_dedup.Bounds(200, held, crowd)
    rng = random.Random(5)
    line = "".join(rng.choices("abcdef ", k=130))
    texts = [(i, "".join(rng.choices("ghijkl", k=rng.randrange(200))) + line[rng.randrange(8) : 130 - rng.randrange(8)] + "".join(rng.choices("mnopq", k=rng.randrange(200)))) for i in range(120)]
    texts += [(200 + i, texts[i % 7][1]) for i in range(30)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removal_digests(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), bounds).collect()}
    assert got == suffix_dedup.brute_force(texts)


def test_plain_doubling_gives_the_same_starts(spark):
    rng = random.Random(3)
    shared = ["".join(rng.choices("abc", k=n)) for n in (40, 33, 60)]
    texts = [(i, "".join(rng.choices("de", k=rng.randrange(30))) + rng.choice(shared) + "".join(rng.choices("fgé", k=rng.randrange(30)))) for i in range(30)] + [(50, "a" * 90), (51, None), (52, "short")]
    seen, want = set(), set()
    for doc, text in texts:
        data = (text or "").encode()
        for i in range(len(data) - 32):
            want |= {(doc, i)} if data[i : i + 33] in seen else set()
            seen.add(data[i : i + 33])
    assert set(table(suffix_dedup.doubled(spark.createDataFrame(texts, "doc_id long, text string"), 33), "doc_id", "at")) == want


# 7. Decontamination


def found_by_words(text, item):
    words, have = (re.findall(r"[^\W_]+", (t or "").lower()) for t in (item, text))
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    wanted = runs(words)
    return len(words) >= 5 and len(wanted & runs(have)) >= 0.8 * len(wanted)


def test_decontamination(spark, rows, docs, nothing):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY 1").fetchall() + [(900, None), (901, ""), (902, "two words"), (903, " ".join(f"w{i}" for i in range(300)))]
    planted = [(2000, "start " + items[0][1].upper() + " end"), (2001, items[1][1]), (2002, items[2][1][: len(items[2][1]) // 2]), (2003, "x " + items[-1][1] + " y")]
    texts = [(r[0], r[1]) for r in rows] + planted
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), benchmark).collect()}
    assert {(d, i) for d, t in texts for i, x in items if found_by_words(t, x)} <= got
    assert {(2000, 0), (2001, 1), (2003, 903)} <= got and not any(d == 2002 for d, _ in got)
    assert all(found_by_words(t, dict(items)[i]) for d, i in got for e, t in texts if d == e)
    assert decontaminate.leaks(nothing, benchmark).count() == 0 and decontaminate.leaks(docs, benchmark.where("false")).count() == 0
    assert decontaminate.leaks(docs, benchmark).count() >= 0


def test_decontamination_of_distant_halves_and_short_items(spark):
    question, answer = " ".join(f"q{i}" for i in range(20)) + "?", " ".join(f"a{i}" for i in range(20)) + "."
    apart = " ".join(f"filler{i}" for i in range(500))
    items = [(1, f"{question} {answer}"), (2, "Two words"), (3, "安全"), (4, "one. two."), (5, "!"), (6, "a b. c")]
    texts = [(10, f"{question} {apart} {answer}"), (11, f"{answer} {apart} {question}"), (12, f"{question} {apart}"), (13, f"{apart} two, WORDS"), (14, "two other words"), (15, "安全"), (16, "two one"), (17, f"one two {apart}"), (18, "c a b"), (19, None)]
    found = decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert table(found, "doc_id", "item_id") == [(10, 1), (11, 1), (13, 2), (15, 3), (17, 4)]


def test_decontamination_in_passes(spark, rows):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY 1").fetchall() + [(901, ""), (902, "two words"), (903, "!")]
    texts = [(r[0], r[1]) for r in rows] + [(2000, "start " + items[0][1].upper() + " end"), (2001, items[5][1] + " two words " + items[1][1])]
    frame, benchmark = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = ("doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap")
    rounded = lambda found: [tuple(x if x is None else round(x, 9) for x in r) for r in table(found, *key)]
    want = rounded(decontaminate.leaks(frame, benchmark))
    assert rounded(decontaminate.leaks(frame, benchmark, sum(len(t) for _, t in items) // 3)) == want and len(want) > 3


def test_block_bounds(rows):
    index = decontaminate.Index(duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY 1").fetchall())
    ids = index.doc_ids(" ".join(r[1] or "" for r in rows[:40]))
    want, half = set(), decontaminate.PASSAGE // 2
    for p in range(max(1, -(-len(ids) // half) - 1)):
        for b in range(index.blocks):
            units = range(decontaminate.BLOCK * b, decontaminate.BLOCK * (b + 1))
            bound = 0.0
            for t in set(ids[p * half : p * half + 2 * half].tolist()) - {-1}:
                own = slice(index.first[t], index.first[t + 1])
                bound += max((i for u, i in zip(index.unit[own], index.impact[own], strict=True) if u in units), default=0.0)
            if bound >= index.block_least[b] - 1e-9:
                want.add((p, b))
    assert set(index.candidates(ids, range(index.blocks))) == want and len(want) > 0


def test_wand_equals_scoring_all(rows):
    items = [(i, t) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY 1").fetchall()]
    index = decontaminate.Index(items)
    ids = index.doc_ids(" ".join(t for _, t in items[:3]))
    terms = np.unique(ids[ids >= 0])
    full = np.zeros(len(index.owner))
    for t in terms:
        full[index.unit[index.first[t] : index.first[t + 1]]] += index.impact[index.first[t] : index.first[t + 1]]
    want = {u for u in range(len(full)) if full[u] >= index.least[u] - 1e-9}
    assert {u for b in range(index.blocks) for u, _ in index.wand(terms, b)} == want and len(want) >= 3


def test_search_of_many_texts_at_once(rows, monkeypatch):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY 1").fetchall() + [(901, ""), (902, "two words"), (903, None)]
    index = decontaminate.Index(items)
    texts = [r[1] or "" for r in rows] + ["", items[0][1], "two words", " ".join(t for _, t in items[:20])]
    own = [index.doc_ids(t) for t in texts]
    want = {}
    for k, ids in enumerate(own):
        n, passage, term = index.passages(ids)
        full = np.zeros((n, len(index.owner)))
        for p, t in zip(passage.tolist(), term.tolist(), strict=True):
            full[p, index.unit[index.first[t] : index.first[t + 1]]] += index.impact[index.first[t] : index.first[t + 1]]
        for p, u in zip(*np.nonzero((full >= index.least - 1e-9) & (full > 0)), strict=True):
            item = int(index.owner[u])
            want[k, item] = max(want.get((k, item), 0.0), full[p, u])
    passed = [index.verified(ids) for ids in own]
    want = [(k, index.items[i], round(s, 9)) for (k, i), s in sorted(want.items()) if i in passed[k]]
    told = lambda: [(k, i, round(s, 9)) for k, i, s, *_ in index.search_all(texts)]
    assert told() == want and len(want) > 20
    started = time.process_time()
    told()
    searched = time.process_time()
    for t in texts:
        index.verified(index.doc_ids(t))
    assert searched - started < 5 * (time.process_time() - searched)  # searching block by block took 14 times as long as reading and verifying
    for name, value in (("PASSAGES", 3), ("CELLS", 200), ("WORDS_AT_ONCE", 50), ("COMMON", 0)):
        monkeypatch.setattr(decontaminate, name, value)
        index = decontaminate.Index(items)
        assert told() == want


# 8. Chat


def test_chat_layouts(spark):
    raws = [
        ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": null}]}', "messages", [("user", "a"), ("assistant", "")]),
        ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', "from_value", [("user", "a"), ("assistant", "b")]),
        ('{"prompt": "p<", "completion": "c\\\\"}', "prompt", [("user", "p<"), ("assistant", "c\\")]),
        ('{"instruction": "i", "input": "", "output": "o"}', "instruction_input", [("user", "i"), ("assistant", "o")]),
        ('{"instruction": "i", "input": "x", "output": "o"}', "instruction_input", [("user", "i\n\nx"), ("assistant", "o")]),
        ('{"answer": "a", "question": "q"}', "question", [("user", "q"), ("assistant", "a")]),
        ('{"id": 7, "messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant"}], "meta": {"prompt": 1}}', "messages", [("user", "a"), ("assistant", "")]),
        ('{"messages": []}', "messages", []), ('{"id": 1, "data": {"messages": [{"role": "user", "content": "a"}], "x": 1}}', "messages", [("user", "a")]),
        ('{"messages": [{"role": "user", "content": [{"type": "text", "text": "a "}, {"type": "image"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "[c]"}]}', "messages", [("user", "a b"), ("assistant", "[c]")]),
        ('{"messages": [{"role": "user", "content": "[a"}, {"role": "assistant", "content": "[{\\"text\\": 1}]"}]}', "messages", [("user", "[a"), ("assistant", '[{"text": 1}]')]),
        ('{"record": {"prompt": "p", "completion": "c"}}', "prompt", [("user", "p"), ("assistant", "c")]), ('{"messages": ["a", "b"]}', None, None), ('{"messages": [{"role": "user", "content": "a"}, 5]}', None, None),
        ('{"prompt": "p", "messages": [{"role": "user", "content": "a"}]}', None, None), ('{"data": {"other": 1}}', None, None),
        ('{"other": 1}', None, None), ("no json", None, None), (None, None, None),
    ]
    frame = spark.createDataFrame([(i, r[0]) for i, r in enumerate(raws)], "i int, raw string")
    out = chat.read_back(chat.formatted(chat.canonical(frame))).orderBy("i").collect()
    assert [r["layout"] for r in out] == [r[1] for r in raws]
    assert [r["turns"] and [tuple(t) for t in r["turns"]] for r in out] == [r[2] for r in raws]
    assert [r["read_turns"] for r in out if r["turns"]] == [r["turns"] for r in out if r["turns"]]
    assert out[2]["formatted"] == "<turn user>\np\\l</turn>\n<turn assistant>\nc\\s</turn>\n" and out[2]["loss_texts"] == ["c\\"]


def test_chat_of_very_long_texts(spark):
    n = 20_500_000
    long = F.repeat(F.lit("x"), n)
    message = lambda role, text, *names: F.struct(F.lit(role).alias(names[0]), text.alias(names[1]))
    raws = [
        F.to_json(F.struct(long.alias("prompt"), F.lit("c").alias("completion"))),
        F.to_json(F.struct(F.array(message("user", long, "role", "content"), message("assistant", F.lit("b"), "role", "content")).alias("messages"))),
    ]
    for raw, layout in zip(raws, ["prompt", "messages"], strict=True):
        out = chat.canonical(spark.range(1).select(raw.alias("raw")))
        assert [tuple(r) for r in out.select("layout", F.size("turns"), F.length(F.col("turns")[0]["text"]), F.length(F.col("turns")[1]["text"])).collect()] == [(layout, 2, n, 1)]


def test_chat_query(spark):
    frame = spark.createDataFrame([(1, 0, "user", "</turn>\n<turn x>"), (1, 1, "assistant", "\\l \\s \\"), (1, 1, "assistant", None), (2, 0, None, "a>\n"), (3, 0, "human", "x"), (None, None, "us>\ner", "y")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_digests(spark, frame).collect()}
    want = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["turns_sha256"] == want(("user", "</turn>\n<turn x>"), ("assistant", ""), ("assistant", "\\l \\s \\"))
    assert got[1]["loss_sha256"] == hashlib.sha256(b"\\l \\s \\").hexdigest() and got[1]["loss_chars"] == 7
    assert got[2]["turns_sha256"] == want(("", "a>\n")) and got[3]["turns_sha256"] == want(("human", "x")) and got[None]["turns_sha256"] == want(("us>\ner", "y"))
    twice = chat.chat_digests(spark, frame.unionByName(spark.createDataFrame([(-7, 0, "user", "own")], frame.schema))).where("conv_id = -7").collect()
    assert sorted(r["n_turns"] for r in twice) == [1, 2]
    assert got[-7]["turns_sha256"] == want(("user", chat.PROBE), ("assistant", chat.PROBE)) and len(got) == 5


# Queries and pipeline


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    key = lambda f: sorted(map(tuple, f[columns].astype(str).to_numpy().tolist()))
    assert key(got) == key(want)


def test_pipeline(spark, rows):
    import corpus_pipeline

    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    left = [(r[0], r[1]) for r in rows if any(c.isalpha() for c in r[1] or "")]
    seen, kept = set(), []
    for doc, text in sorted(left):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", text)
        if key not in seen:
            seen.add(key)
            kept.append((doc, text, fingerprint(text)))
    top = roots(range(len(kept)), [(a, b) for a in range(len(kept)) for b in range(a) if (kept[a][2] ^ kept[b][2]).bit_count() <= 3])
    want = {kept[a][0] for a in top if top[a] == a}
    want = {d for d, t, _ in kept if d in want and not any(found_by_words(t, x) for _, x in items)}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "packing"]


def test_pipeline_hands_small_batches_to_python(spark):
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for given, want in (("10000", 1000), ("0", 1000), ("50", 50)):
        spark.conf.set(name, given)
        assert int(corpus_pipeline.small_batches(spark).conf.get(name)) == want
    spark.conf.set(name, before)
    docs = spark.createDataFrame([(i, f"text {i}", None, None, 0) for i in range(3)], DOCS)
    corpus_pipeline.STAGES[1][1](spark, docs, None)
    assert int(spark.conf.get(name)) == 1000
    spark.conf.set(name, before)


def test_pipeline_decides_row_by_row(spark, rows, tmp_path):
    import corpus_pipeline

    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY 1").fetchall()
    word = lambda k: " ".join(hashlib.sha256(f"{k} {i}".encode()).hexdigest()[:9] + "z" for i in range(60))
    a, b, c, d, e = map(word, range(5))
    texts = [(3, a), (2, a), (3, b), (4, c), (4, c), (None, d), (None, d), (None, items[0][1]), (6, items[1][1]), (6, e), (6, ""), (7, None)]
    frame = spark.createDataFrame([(i, t, None, "s", 0) for i, t in texts], DOCS)
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).where("start = 0")
    assert table(got, "doc_id") == sorted([(2,), (3,), (4,), (None,), (6,)], key=repr)


def test_pipeline_of_an_empty_table_and_clashing_columns(spark, rows, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.createDataFrame([(r[0], r[1], r[2], None, r[4]) for r in rows[:30]] + [(90, None, None, None, None), (91, "", "en", "x", 0)], DOCS)
    clashing = frame.withColumns({c: F.lit("clash") for c in ("class", "id", "fp", "queue", "digest", "keep", "item_id")})
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0 and not {90, 91} & {r["doc_id"] for r in got.select("doc_id").collect()}
    docs = clashing.where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
        assert name == "packing" or set(clashing.columns) <= set(docs.columns)
