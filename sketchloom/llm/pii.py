"""Personal data by candidate gradient boosting, with DataFrame functions only.

1. Base spans: four patterns (email, ip, card, phone) with their checks.
2. High-recall generators propose further spans, which may overlap: runs of
   digits with separators, addresses whose @ or dots are spelled out, defanged
   ip numbers, long unbroken tokens and values assigned to a key or password.
3. Boosted trees score each candidate from its format and its context. What
   they learn is not in the patterns: the personal data of the corpus (base
   spans, with the text around them) is rewritten as people hide or vary it
   (spelled @ and dots, no plus, other separators), keys are made of digests,
   and both stand against look-alikes: the corpus' own plain runs of digits that
   are no base spans, and dates, prices, order and version numbers, joined words and
   rulers made of the same characters in the same places. They are fitted on a
   bounded sample (SAMPLE examples of each sort, by hash of doc_id and
   position) and are applied as one SQL expression.
4. A threshold for each kind, calibrated on the half of the sample that was not
   fitted, selects the candidates to add. Those that overlap a base span bring
   nothing new and are left out; of added ones that overlap, the higher score
   stays (then the earlier, then the longer). Base spans always stay.

Kinds are email, ip, card, phone and, among added spans only, secret.
Positions are code points, ends exclusive. Null texts count as empty; rows
with null or repeated ids are each answered on their own; no documents give
no rows. Patterns use possessive repeats, so very long runs of digits or of
dotted names neither recurse nor backtrack.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .boosting import Booster, threshold
from .common import stored, whole_text

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
AT, DOT = r"(?:@|\x20?\(at\)\x20?|\x20?\[at\]\x20?|\x20at\x20)", r"(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\x20dot\x20)"
CUE = r"(?:key|token|secret|passwor[dt]|passwd|pwd|credentials?|authorization|bearer)"
GENERATORS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++",
    "ip": r"[0-9]{1,3}+(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\x20dot\x20)\x20?[0-9]{1,3}+){3}",
    "digits": r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,22}",
    "token": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}",
    "value": rf"(?i)(?<=\b{CUE}['\"]?\x20?[:=]\x20?['\"]?)[^\s'\"]{{6,200}}+",
}
#: A text without any of these has no candidate of the generator.
MAKER_HINTS = {"email": ("@", "(at)", "[at]", " dot "), "ip": ("[.]", "(.)", "[dot]", "(dot)", " dot "), "value": ("=", ":")}
#: Examples at most of each sort to fit and calibrate on, and the precision wanted of added spans.
SAMPLE, PRECISION = 2_000, 0.995
SPAN = "struct<kind:int,first:int,last:int>"


def matches(text: Column, pattern: str, hint: Column | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if hint is None else F.when(hint, found).otherwise(F.array().cast("array<string>"))


#: Values that a running result is copied over; between chunks only their ends are.
CHUNK = 256


def running(values: Column, start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """merge over the first values, the first two, and so on. Two levels, as an array that grows value by value would be copied for each of them."""
    none = F.array().cast("array<int>")

    def along(state: Column, x: Column) -> Column:
        return let(merge(state["last"], x), lambda last: F.struct(last.alias("last"), F.concat(state["out"], F.array(last)).alias("out")))

    def one(items: Column) -> Column:
        return F.aggregate(items, F.struct(start.alias("last"), none.alias("out")), along)["out"]

    def joined(scans: Column) -> Column:
        ends = one(F.transform(scans, lambda c: F.element_at(c, -1)))
        return F.flatten(let(ends, lambda ends: F.transform(scans, lambda c, i: let(F.when(i == 0, start).otherwise(F.get(ends, i - 1)), lambda before: F.transform(c, lambda x: merge(before, x))))))

    chunks = F.transform(F.sequence(F.lit(0), F.size(values) - 1, F.lit(CHUNK)), lambda i: one(F.slice(values, i + 1, F.lit(CHUNK))))
    return F.when(F.size(values) > 0, let(chunks, joined)).otherwise(none)


def placed(found: Column, text: Column, pattern: str) -> Column:
    """array of (first, last, value, before, after): the matches with their places and neighbouring text.

    The lengths of matches and of the pieces between them give the places, so the text is not searched for each match.
    """
    none = F.array().cast("array<struct<first:int,last:int,value:string,before:string,after:string>>")

    def told(found: Column, gaps: Column) -> Column:
        lengths = F.transform(found, lambda value, i: F.length(F.get(gaps, i)) + F.length(value))
        one = lambda value, i, ends: F.struct((F.get(ends, i) - F.length(value)).alias("first"), F.get(ends, i).alias("last"), value.alias("value"), F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(2)).alias("after"))
        return let(let(lengths, lambda n: running(n, F.lit(0), lambda a, b: a + b)), lambda ends: F.transform(found, lambda value, i: one(value, i, ends)))

    both = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(F.size(found) > 0, let(both, lambda b: told(b["found"], b["gaps"]))).otherwise(none)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the check sum; 19 digits at most are looked at."""
    back = F.reverse(F.left(digits, F.lit(19)))

    def step(total: Column, i: Column) -> Column:
        d = F.coalesce(F.substring(back, i, F.lit(1)).try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), F.lit(0), step) % 10 == 0


def small_parts(value: Column) -> Column:
    """Whether all dotted parts are numbers of at most 255."""
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))


def checks(kind: str, value: Column) -> Column:
    n = F.length(digits_of(value))
    return {"email": F.lit(True), "ip": small_parts(value), "card": n.between(16, 19) & luhn(digits_of(value)), "phone": n.between(8, 15)}[kind]


FORMATS = {
    "spelled": r"(?i)\((?:at|dot)\)|\[(?:at|dot)\]| at | dot ",
    "grouped": r"^[+(]*[0-9]{0,3}[\x20.(-]*[0-9]{3}[\x20.)-]+[0-9]{3}[\x20.-][0-9]{4}$",
    "fours": r"^[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}",
    "date": r"(?:19|20)[0-9]{2}[.-](?:0?[1-9]|1[0-2])[.-]|[.-](?:0?[1-9]|1[0-2])[.-](?:19|20)[0-9]{2}",
    "price": r"^[0-9]{1,3}(?:[.\x20][0-9]{3})+(?:[.-][0-9]{2})?$",
    "hex": r"^[0-9a-fA-F]+$",
    "lower": r"[a-z]",
    "upper": r"[A-Z]",
    "turns": r"[0-9][A-Za-z][0-9]|[a-z][A-Z0-9][a-z]",
    "prefix": r"^(?:AKIA|ASIA|AIza|gh[pousr]_|sk[-_]|pk[-_]|xox[abpr]-|eyJ|glpat-)",
    "repeats": r"(.)\1{5}",
    "marks": r"[+/_=-]",
}
BEFORE = {
    "inside": r"[\p{L}0-9+(]$",
    "quote": r"['\"]$",
    "money": r"[$€£#]\x20?$|(?i)(?:no|nr|number|order|invoice|version|isbn|id)[^a-z]{0,3}$",
    "cue": r"(?i)(?:tel|phone|call|fax|mobile|card|mail|contact|ip|host)[^a-z]{0,3}$",
    "assigned": rf"(?i){CUE}['\"]?\x20?[:=]?\x20?['\"]?$",
}
COUNTED = {"plus": "+", "dots": ".", "spaces": " ", "hyphens": "-", "brackets": "(", "at": "@"}
FEATURES = ("maker", "chars", "digits", *COUNTED, *FORMATS, *BEFORE, "goes_on", "luhn", "parts", "lead", "zeros", "variety")


def features(c: Column, maker: Column) -> list[Column]:
    """FEATURES of a candidate (value, before, after) of a generator (its place among GENERATORS): format and context, as numbers."""
    value, digits = c["value"], digits_of(c["value"])
    count = lambda what: F.length(value) - F.length(F.replace(value, F.lit(what), F.lit("")))
    seen = lambda text, pattern: F.when(F.rlike(text, F.lit(pattern)), 1).otherwise(0)
    spelled = F.regexp_replace(value, r"(?i)\x20?(?:[(\[](?:\.|dot)[)\]]|\x20dot\x20)\x20?", ".")
    out = [maker, F.length(value), F.length(digits), *(count(x) for x in COUNTED.values()), *(seen(value, p) for p in FORMATS.values()), *(seen(c["before"], p) for p in BEFORE.values())]
    out += [
        seen(c["after"], r"^[\p{L}0-9]"),
        F.when(F.length(digits).between(16, 19) & luhn(digits), 1).otherwise(0),
        F.when((F.length(digits) < 13) & F.rlike(spelled, F.lit(r"^[0-9]+(?:\.[0-9]+){3}$")) & small_parts(F.regexp_replace(spelled, r"[^0-9.]", "")), 1).otherwise(0),
        F.coalesce(F.left(digits, F.lit(1)).try_cast("int"), F.lit(-1)),
        F.length(digits) - F.length(F.replace(digits, F.lit("0"), F.lit(""))),
        F.size(F.array_distinct(F.split(F.left(value, F.lit(64)), ""))),
    ]
    return [x.cast("int").alias(n) for n, x in zip(FEATURES, out, strict=True)]


def reach(base: Column) -> Column:
    """(firsts, ends): where the spans begin, sorted, and how far the spans up to each one reach."""
    ordered = F.array_sort(F.transform(base, lambda b: F.struct(b["first"].alias("first"), b["last"].alias("last"))))
    told = lambda o: F.struct(F.transform(o, lambda b: b["first"]).alias("firsts"), running(F.transform(o, lambda b: b["last"]), F.lit(-1), F.greatest).alias("ends"))
    return let(ordered, told)


def hit(base: Column, c: Column) -> Column:
    """Whether a candidate overlaps a span of reach(): bisection finds the spans that begin before it ends, of which one must reach behind its start."""
    firsts, ends = base["firsts"], base["ends"]

    def halve(s: Column, _: Column) -> Column:
        """low: so many begin before the end for certain; high: no more than so many do."""
        middle = ((s["low"] + s["high"] + 1) / 2).cast("int")
        inside = F.get(firsts, middle - 1) < c["last"]
        return F.when(s["low"] < s["high"], F.struct(F.when(inside, middle).otherwise(s["low"]).alias("low"), F.when(inside, s["high"]).otherwise(middle - 1).alias("high"))).otherwise(s)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(firsts) + F.lit(1))).cast("int"))
    number = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(firsts).alias("high")), halve)["low"]
    return F.when(F.size(firsts) == 0, False).otherwise(F.coalesce(F.get(ends, number - 1) > c["first"], F.lit(False)))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of spans), seen (the base spans with their text) and proposed (candidates with features) of every whole text."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    hints = {k: F.contains(text, F.lit(h)) for k, h in HINTS.items()}
    either = lambda marks: functools.reduce(operator.or_, (F.contains(text, F.lit(m)) for m in marks))
    looked = {k: either(marks) for k, marks in MAKER_HINTS.items()}
    looked["value"] &= F.rlike(text, F.lit(rf"(?i){CUE}['\"]?\x20?[:=]"))
    rows = rows.select("*", *(matches(text, PATTERNS[k], hints.get(k)).alias(f"m_{k}") for k in BASE), *(matches(text, p, looked.get(k)).alias(f"g_{k}") for k, p in GENERATORS.items()))
    rows = rows.select("doc_id", *(placed(F.col(f"m_{k}"), text, PATTERNS[k]).alias(k) for k in BASE), *(placed(F.col(f"g_{k}"), text, p).alias(f"p_{k}") for k, p in GENERATORS.items()))
    sound = lambda k: F.filter(k, lambda c: checks(k, c["value"]))
    span = lambda k: F.transform(sound(k), lambda c: F.struct(F.lit(KINDS.index(k)).alias("kind"), *(c[x].alias(x) for x in ("first", "last", "value", "before", "after"))))
    of = lambda i, k: F.transform(f"p_{k}", lambda c: F.struct(F.lit(i).alias("maker"), *(c[x].alias(x) for x in ("first", "last", "value", "before", "after"))))
    proposed = F.concat(*(of(i, k) for i, k in enumerate(GENERATORS)))
    rows = rows.select("doc_id", F.concat(*(span(k) for k in BASE)).alias("seen"), proposed.alias("proposed"))
    rows = rows.withColumn("base", F.transform("seen", lambda c: F.struct(c["kind"].alias("kind"), c["first"].alias("first"), c["last"].alias("last"))))
    told = lambda c: F.struct(c["first"].alias("first"), c["last"].alias("last"), *features(c, c["maker"]))
    new = let(reach(F.col("base")), lambda base: F.transform(F.filter("proposed", lambda c: ~hit(base, c)), told))
    return rows.select("doc_id", "base", "seen", new.alias("proposed"))


def examples(seen: DataFrame) -> DataFrame:
    """h, label, maker, value, before, after: base spans (kind, value, before, after, h: a hash) rewritten, keys, and look-alikes of both."""
    makers, c = list(GENERATORS), F.col
    h = F.pmod(F.xxhash64("value", "before", "h"), F.lit(2**53))
    pick = lambda n, *of: F.element_at(F.array(*(F.lit(x) if isinstance(x, str | int) else x for x in of)), (F.pmod(F.floor(c("x") / 97**n), F.lit(len(of))) + 1).cast("int"))
    part = lambda a, n: F.substring("digits", a, n)
    joined = lambda mark, *parts: F.replace(F.concat_ws("\x00", *parts), F.lit("\x00"), mark)
    rows = seen.withColumn("x", h)
    turned = pick(7, *(F.translate("value", "0123456789", to) for to in ("0123456789", "3690258147", "7418529630", "9876543210")))
    rows = rows.withColumn("value", F.when(c("kind") == 3, turned).otherwise(c("value")))  # many numbers, though the corpus may repeat few
    key = F.sha2(F.concat("value", c("x").cast("string")), 256)
    packed = F.regexp_replace(F.base64(F.unhex(key)), "=", "")
    short = F.regexp_replace("value", "@[^.]*[.](?=[^.]*[.])", "@")
    name = pick(5, c("value"), F.regexp_replace("value", "[.]?[0-9]+", ""), F.regexp_replace("value", "^[^@]*[.]", "jo"), short, F.regexp_replace(short, "[0-9]+", "smith"), F.regexp_replace(short, "^[^@]*", "bob"))
    octets = [F.pmod(F.floor(c("x") / 131**i), pick(i, 256, 100, 32, 10)).cast("string") for i in range(4)]
    rows = stored(rows.withColumns({
        "digits": digits_of(c("value")), "key": key, "packed": packed, "name": name, "octets": F.array(*octets), "wrong": F.concat(pick(8, "3", "4", "9"), F.lpad(octets[0], 2, "7")),
        "at": pick(0, " (at) ", "(at)", "[at]", " [at] ", " at ", "@"), "dot": pick(1, " (dot) ", "(dot)", "[dot]", " dot ", "."), "mark": pick(2, "-", ".", " "), "defanged": pick(3, "[.]", "(.)", "[dot]", " dot ", " [dot] "),
        "letters": F.regexp_replace(F.concat("before", F.lit("thelongwordsofalanguage"), "before"), r"[^\p{Alpha}]", ""),
        "assigned": F.concat("before", pick(1, ' token = "', ' api_key = "', " key: ", ' secret="', " password=", ' "access_token": "', "Authorization: Bearer ")),
        "ordered": F.concat("before", pick(3, "order ", "no. ", "#", "invoice nr ", "id: ", "")),
    }))
    one = lambda label, maker, value, before="before": F.struct(F.lit(label).alias("label"), F.lit(makers.index(maker)).alias("maker"), value.alias("value"), F.col(before).alias("before"), F.col("after"))
    letters = lambda a, n: F.substring("letters", a, n)
    spelled = F.when((c("at") == "@") | (c("dot") == "."), " dot ").otherwise(c("dot"))
    hidden = F.replace(pick(6, F.replace("name", F.lit("."), spelled), F.regexp_replace("name", r"[.](?=[^@]*$)", spelled)), F.lit("@"), c("at"))
    said = F.concat(pick(4, letters(1, 3), letters(1, 6), letters(1, 11), letters(2, 16)), F.lit(" at "), pick(2, "this", "the", "every", "10", "some", "another"), F.lit(" dot "), pick(3, "the", "and", "of", "in"))
    made = pick(0, F.left("key", F.lit(40)), F.left("key", F.lit(32)), c("key"), c("packed"), F.left("packed", F.lit(24)), F.concat(F.lit("sk-"), "packed"), F.concat(F.lit("ghp_"), F.left(F.regexp_replace("packed", "[+/]", "x"), F.lit(36))), F.concat(F.lit("AKIA"), F.upper(F.left(F.regexp_replace("packed", "[^A-Za-z0-9]", "Q"), F.lit(16)))))
    path = joined(pick(3, "-", "_", "/"), letters(1, 9), letters(5, 8), letters(9, 7))
    octet = lambda i: c("octets")[i]
    ip = F.array(one(1, "ip", joined(c("defanged"), *map(octet, range(4)))), one(0, "ip", joined(c("defanged"), c("wrong"), *map(octet, (1, 2, 3)))), one(0, "ip", joined(c("defanged"), *map(octet, (3, 2, 1)), c("wrong"))))
    ten = F.right("digits", F.lit(10))
    phone = [F.regexp_replace("value", r"^\+", ""), F.regexp_replace("value", r"^\+[0-9]+[\x20.-]*", ""), joined(c("mark"), F.left(ten, F.lit(3)), F.substring(ten, 4, 3), F.right(ten, F.lit(4)))]
    card = joined(pick(0, ".", "  ", ". "), part(1, 4), part(5, 4), part(9, 4), part(13, 7))
    date = joined(c("mark"), F.concat(F.lit("20"), part(3, 2)), pick(4, "01", "4", "09", "12"), F.concat(F.lit("2"), part(4, 1)))
    odd = (F.concat(part(2, 9), part(1, 2)), F.concat(date, F.lit(" "), part(2, 4)), F.concat_ws(".", part(2, 3), part(4, 3), part(5, 2)), F.concat_ws(".", part(2, 2), part(3, 3), part(5, 4), part(6, 1)), F.concat(part(1, 4), F.lit("-"), part(5, 9)), F.concat(part(1, 12), pick(1, "31", "4", "7", "907"), part(13, 2)))
    numbers = [one(0, "digits", x, "ordered") for x in odd]
    own = F.when(c("kind") == 0, F.array(one(1, "email", hidden), one(0, "email", said))).when(c("kind") == 1, ip).when(c("kind") == 2, F.array(one(1, "digits", card), one(0, "digits", F.concat(part(1, 1), F.lit("."), part(2, 18)), "ordered"), one(0, "digits", F.regexp_replace("digits", "(.)(?=(.{3})+$)", "$1."), "ordered"), *numbers)).otherwise(F.array(*(one(1, "digits", x) for x in phone), *numbers))
    ruler = F.repeat(pick(2, "-", "=-", "_", "ab", "x", "+-"), 24)
    uuid = F.regexp_replace(F.left("key", F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    plain = pick(1, letters(1, 8), "required", "optional", "None,", "string;")
    tokens = [one(1, "token", made, "assigned"), one(1, "value", F.left(made, F.lit(14)), "assigned"), one(0, "token", ruler), one(0, "token", c("letters"), "assigned"), one(0, "token", path), one(0, "token", uuid), one(0, "value", plain, "assigned")]
    return rows.select("h", F.inline(F.concat(own, F.array(*tokens))))


def fitted(rows: DataFrame, sample: int, precision: float) -> list[tuple[Booster, float]]:
    """Each kind's trees and threshold, from at most about `sample` base spans and as many other candidates."""
    spans = rows.select("doc_id", F.inline("seen"))
    others = rows.select("doc_id", F.inline("proposed")).where("maker = 2 and chars = digits")  # of the others some may be what we look for: nobody has told
    n = rows.agg(F.sum(F.size("seen")).alias("s"), F.sum(F.size(F.filter("proposed", lambda c: (c["maker"] == 2) & (c["chars"] == c["digits"])))).alias("o")).first()
    million = F.pmod(F.xxhash64("doc_id", "first", "last"), F.lit(1_000_000))
    drawn = lambda x, total: x.withColumn("h", million).where(F.col("h") < int(1_000_000 * min(1.0, 0.95 * sample / max(total or 0, 1))))
    made = examples(drawn(spans, n["s"])).select("label", "h", F.struct("value", "before", "after").alias("c"), "maker")
    made = made.select("label", "h", *features(F.col("c"), F.col("maker"))).where("label = 1 or luhn = 0 or dots > 0")  # else a card by chance
    real = drawn(others, n["o"]).select(F.lit(0).alias("label"), "h", *FEATURES)
    data = np.asarray(sorted(map(tuple, made.unionByName(real).collect())), float).reshape(-1, len(FEATURES) + 2)  # sorted: the order in which rows arrive must not matter
    y, half, x = data[:, 0], data[:, 1] % 2 == 0, data[:, 2:]
    kind, out = kinds(x), []
    for k in range(len(KINDS)):
        own, rest = half & (kind == k), ~half & (kind == k)
        model = Booster().fit(x[own], y[own])
        score = model.score(x[rest])
        least = threshold(score, y[rest], precision)
        out.append((model, max(0.5, (least + score[score < least].max(initial=0.0)) / 2) if least <= 1 else least))  # midway to the next lower score
    return out


def kinds(x: np.ndarray) -> np.ndarray:
    """kind_of for rows of features."""
    maker, luhn_ = x[:, FEATURES.index("maker")], x[:, FEATURES.index("luhn")]
    return np.select([maker == 0, maker == 1, maker >= 3, luhn_ > 0], [0, 1, 4, 2], 3)


def kind_of(c: Column) -> Column:
    """The kind of an added span, from its generator and its format."""
    return F.when(c["maker"] == 0, 0).when(c["maker"] == 1, 1).when(c["maker"] >= 3, 4).when(c["luhn"] > 0, 2).otherwise(3)


def apart(scored: Column) -> Column:
    """Of spans that overlap, the one with the highest score; then the earlier one, then the longer. Only spans of one cluster, joined by overlaps, are held against each other."""
    ordered = F.array_sort(F.transform(scored, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), s["score"].alias("score"), s["kind"].alias("kind"))))

    def chosen(cluster: Column) -> Column:
        rank = F.transform(cluster, lambda s: F.struct((-s["score"]).alias("a"), s["first"].alias("b"), (-s["last"]).alias("c"), s["kind"].alias("kind")))
        ordered = F.transform(F.array_sort(rank), lambda s: F.struct(s["kind"].alias("kind"), s["b"].alias("first"), (-s["c"]).alias("last")))
        clear = lambda kept, s: ~F.exists(kept, lambda k: (k["first"] < s["last"]) & (s["first"] < k["last"]))
        return F.aggregate(ordered, F.array().cast(f"array<{SPAN}>"), lambda kept, s: F.when(clear(kept, s), F.concat(kept, F.array(s))).otherwise(kept))

    def split(o: Column, ends: Column) -> Column:
        heads = F.filter(F.transform(o, lambda s, i: F.when((i == 0) | (s["first"] >= F.get(ends, i - 1)), i)), lambda i: i.isNotNull())
        cut = lambda heads: F.flatten(F.transform(heads, lambda at, i: chosen(F.slice(o, at + 1, F.coalesce(F.get(heads, i + 1), F.size(o)) - at))))
        return let(heads, cut)

    def both(o: Column) -> Column:
        ends = running(F.transform(o, lambda s: s["last"]), F.lit(-1), F.greatest)
        return let(ends, lambda ends: split(o, ends))

    return F.when(F.size(scored) > 0, let(ordered, both)).otherwise(F.array().cast(f"array<{SPAN}>"))


def at_least(least: float):
    return lambda score: F.when(score >= F.lit(least), score)


def find_pii(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> DataFrame:
    """doc_id, base and added: arrays of (kind, first, last), each sorted, of every document."""
    rows = stored(candidates(docs))
    models = fitted(rows, sample, precision)

    def score(c: Column) -> Column:
        """The score of a candidate that reaches its kind's threshold, else null."""
        out = F.lit(None).cast("double")
        for k, (model, least) in enumerate(models):
            if least <= 1:
                out = F.when(kind_of(c) == k, let(model.column([c[n] for n in FEATURES]), at_least(least))).otherwise(out)
        return out

    scored = F.transform("proposed", lambda c: F.struct(kind_of(c).alias("kind"), c["first"].alias("first"), c["last"].alias("last"), score(c).alias("score")))
    rows = rows.select("doc_id", "base", F.when(F.size("proposed") > 0, F.filter(scored, lambda s: s["score"].isNotNull())).otherwise(F.array()).alias("scored"))
    return rows.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(apart(F.col("scored"))).alias("added"))


def redacted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with each base or added span replaced by its kind in brackets. doc_id must be unique and not null."""
    spans = found.select("doc_id", F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["first"] < b["first"], -1).when(a["first"] > b["first"], 1).otherwise(0)).alias("spans_"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(s: Column, x: Column) -> Column:
        mark = F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), F.lit("]"))
        return F.when(x["first"] < s["at"], F.struct(F.greatest(s["at"], x["last"]).alias("at"), s["out"].alias("out"))).otherwise(F.struct(x["last"].alias("at"), F.concat(s["out"], F.substring("text", s["at"] + 1, x["first"] - s["at"]), mark).alias("out")))

    done = F.aggregate("spans_", start, add, lambda s: F.concat(s["out"], F.substring("text", s["at"] + 1, F.length("text"))))
    return docs.join(spans, "doc_id", "left").withColumn("text", F.when(F.size("spans_") > 0, done).otherwise(F.col("text"))).drop("spans_")


def listing(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["first"].cast("string"), s["last"].cast("string"))), ",")


def pii_digests(docs: DataFrame) -> DataFrame:
    found = find_pii(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    everything = F.array_sort(F.concat("base", "added"))
    return found.select(
        "doc_id", *counts, F.sha2(listing(F.col("base")), 256).alias("base_sha256"), listing(everything).alias("spans"),
        F.size("added").cast("long").alias("n_added"), F.size(everything).cast("long").alias("n_spans"),
    )
