"""Personal data by weak supervision, in DataFrame expressions only.

Candidates: all matches of four patterns (email, ip, card, phone), whether or not they pass their checks,
and two looser ones (phone numbers without a country code; secrets, long runs of letters and digits).
Three labelers vote on each: *regex* (the kind's check passes), *gazetteer* (known top-level domains,
country codes, issuer prefixes, words that name secrets) and *context* (whether the span stands on its own,
and words near it); a labeler may abstain.  Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is for each kind and how likely a pattern is personal data
(Dawid-Skene, two classes); these soft labels train a naive-Bayes span classifier over votes, length and edges.  A candidate
that the classifier gives ``accept`` or more is added; matches that pass their checks are always kept.

All pattern work is row-wise expressions: no shuffle and no Python.  Candidates are found once and written beside their
rows; votes are aggregated from there, whose values are few by construction (at most 6 kinds * 27 patterns * 9 lengths
* 2), and only these counts reach the driver.

Work grows with the text, also where one text holds very many matches: patterns are written so that Java's matcher
neither recurses nor turns quadratic; places come from running sums (``scan``); a text is cut once in chunks of ``CHUNK``
characters, and whatever is read around a match comes from a chunk or two (``between``).

Defined results: null text is empty; a text without matches has counts 0 and the hash of the empty string;
repeated rows are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ACCEPT = 0.9
KINDS = ("email", "ip", "card", "phone", "secret")
#: Stands for one separator between two characters of a span; it is not in texts (their own is replaced first).
MARK = ""
EMAIL = f"(?:(?<![A-Za-z0-9._%+{MARK}-])|\\G)[A-Za-z0-9._%+{MARK}-]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = f"[0-9][0-9{MARK}]{{11,}}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
LOCAL = r"(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
SECRET = r"(?<![0-9A-Za-z])[0-9A-Za-z]{24,}+"
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|example"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|36|38"
NAMES = "token|secret|key|password|passwd|pwd|auth|bearer"
NEAR = {"email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|credit|pay", "phone": "tel|phone|call|fax|mobile", "secret": NAMES}
GROUP, CHUNK = 256, 512


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once, however often f uses it."""
    return F.transform(F.array(c), f)[0]


def scan(items: Column, start: Column, kind: str, step: Callable) -> Column:
    """Left to right over an array with a state: ``step(state, item)`` gives the next state, and these are the result.

    ``kind`` is the state's SQL type.  An array grows by copying, so items go in groups of GROUP, each folded
    into its own small array.
    """
    return let(items, lambda x: _scan(x, start, kind, step))


def _scan(items: Column, start: Column, kind: str, step: Callable) -> Column:
    none = F.array().cast(f"array<{kind}>")

    def within(acc: Column, x: Column) -> Column:
        return let(step(acc["state"], x), lambda s: F.struct(s.alias("state"), F.concat(acc["out"], F.array(s)).alias("out")))

    def group(acc: Column, i: Column) -> Column:
        part = F.aggregate(F.slice(items, i + 1, GROUP), F.struct(acc["state"].alias("state"), none.alias("out")), within)
        return let(part, lambda p: F.struct(p["state"].alias("state"), F.concat(acc["out"], p["out"]).alias("out")))

    whole = F.aggregate(F.sequence(F.lit(0), F.size(items) - 1, F.lit(GROUP)), F.struct(start.cast(kind).alias("state"), none.alias("out")), group, lambda acc: acc["out"])
    return F.when(F.size(items) > 0, whole).otherwise(none)


def located(marked: Column, pattern: str) -> Column:
    """array<struct<s, e, hit>>: where the pattern's matches begin and end, in code points, and their texts."""
    place = F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("hit"))
    step = lambda at, x: F.struct((at["e"] + x["gap"]).alias("s"), (at["e"] + x["gap"] + F.length(x["hit"])).alias("e"), x["hit"].alias("hit"))
    pair = lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit"))
    items = lambda hits: F.zip_with(F.slice(F.split(marked, pattern, -1), 1, F.size(hits)), hits, pair)
    return let(F.regexp_extract_all(marked, F.lit(pattern), F.lit(0)), lambda hits: scan(items(hits), place, "struct<s:int,e:int,hit:string>", step))


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0))


def between(cut: Column, a: Column, b: Column) -> Column:
    """The characters a to b (exclusive) of a text in chunks, without walking through what lies before them."""
    n = F.lit(CHUNK)
    at = lambda i: F.coalesce(F.try_element_at(cut, (i + 1).cast("int")), F.lit(""))
    first, last = F.floor(a / n).cast("int"), F.floor(b / n).cast("int")
    inner = F.array_join(F.slice(cut, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    apart = F.concat(F.substring(at(first), a % n + 1, n), inner, F.substring(at(last), F.lit(1), b % n))
    return F.when(first == last, F.substring(at(first), a % n + 1, b - a)).otherwise(apart)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""
    value = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(0)).otherwise(F.lit(-1))


def _candidate(kind: str, strict: bool):
    """From a span to a candidate: kind, place, whether it is a base match, the votes and the other features."""

    def make(cut: Column):
        def one(x: Column) -> Column:
            m = F.translate(x["hit"], MARK, ".") if kind == "email" else x["hit"]
            left, right = F.lower(between(cut, F.greatest(x["s"] - 24, F.lit(0)), x["s"])), between(cut, x["e"], x["e"] + 2)
            read = F.struct(m.alias("m"), left.alias("left"), right.alias("right"), F.regexp_replace(m, "[^0-9]", "").alias("digits"))
            return let(read, lambda r: judged(x, r["m"], r["left"], r["right"], r["digits"]))

        def judged(x: Column, m: Column, left: Column, right: Column, digits: Column) -> Column:
            if kind == "email":
                ok, known = F.lit(True), m.rlike(f"(?i)\\.({DOMAINS})$")
            elif kind == "ip":
                ok = F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) < 4) & F.forall(F.split(m, r"\."), lambda p: F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 4).cast("int") <= 255)
                known = ~m.rlike(r"^0*(0|127|255)\.")
            elif kind == "card":
                ok, known = F.length(digits).between(12, 19) & luhn(F.substring(digits, 1, 20)), digits.rlike(f"^({ISSUERS})")
            elif kind == "phone":
                ok, known = F.length(digits).between(9, 15), m.rlike(r"^\+(1|7|2[07]|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(")
            else:
                ok, known = m.rlike("[0-9]") & m.rlike("[A-Za-z]"), left.rlike(f"({NAMES})[^a-z]{{0,6}}$")
            base = ok if strict else F.lit(False)
            glued = left.rlike("[0-9a-z]$") | right.rlike("^[0-9A-Za-z]")
            cue = left.rlike(f"\\b({NEAR[kind]})\\b")
            votes = (_vote(ok, ~ok), _vote(known, ~known), _vote(~glued & (cue | F.lit(kind != "secret")), glued))
            if not strict:
                votes = (_vote(ok & known, ~ok), *votes[1:])
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), base.alias("base"), *(v.alias(n) for v, n in zip(votes, ("v1", "v2", "v3"), strict=True)), F.least(F.floor((x["e"] - x["s"]) / 6), F.lit(8)).cast("int").alias("size"), (~glued).cast("int").alias("edge"))

        return one

    return make


CANDIDATE = "array<struct<kind:string,s:int,e:int,base:boolean,v1:int,v2:int,v3:int,size:int,edge:int>>"
PLACES = "array<struct<s:int,e:int,hit:string>>"


def cleaned(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), MARK, "�")


def candidates(docs: DataFrame) -> DataFrame:
    """The whole input row and the array of its text's candidates; texts without any digit or @ are not searched."""
    joined = F.regexp_replace(F.col("text"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    digits = F.regexp_replace(F.col("text"), r"(?<=[0-9])[ -](?=[0-9])", MARK)
    searched = [
        ("email", True, F.col("text").contains("@"), joined, EMAIL),
        ("ip", True, F.col("digit"), F.col("text"), IP),
        ("card", True, F.col("digit"), digits, CARD),
        ("phone", True, F.col("text").contains("+"), F.col("text"), PHONE),
        ("phone", False, F.col("digit") & F.col("text").contains("("), F.col("text"), LOCAL),
        ("secret", False, F.col("digit"), F.col("text"), SECRET),
    ]
    df = docs.select(cleaned(C.text_column()).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row")).withColumn("digit", F.col("text").rlike("[0-9]"))
    nowhere, none = F.array().cast(PLACES), F.array().cast(CANDIDATE)
    names = [f"m{i}" for i in range(len(searched))]
    df = df.withColumns({n: F.when(gate & marked.rlike(p), located(marked, p)).otherwise(nowhere) for n, (_, _, gate, marked, p) in zip(names, searched, strict=True)})
    some = F.lit(False)
    for n in names:
        some = some | (F.size(n) > 0)
    df = df.withColumn("cut", F.when(some, chunks(F.col("text"))).otherwise(F.array().cast("array<string>")))
    each = [F.when(F.size(n) > 0, F.transform(n, _candidate(kind, strict)(F.col("cut")))).otherwise(none) for n, (kind, strict, *_) in zip(names, searched, strict=True)]
    return df.select("row", F.concat(*(c.cast(CANDIDATE) for c in each)).alias("found"))


def pattern_counts(found: DataFrame) -> list:
    """How many candidates have each kind, vote pattern, size class and edge: a few thousand rows at most."""
    x = found.filter(F.size("found") > 0).select(F.explode("found").alias("x")).select("x.*")
    return x.groupBy("kind", "v1", "v2", "v3", "size", "edge").agg(F.count(F.lit(1)).alias("n")).collect()


def reliabilities(counts: list, rounds: int = 40) -> dict:
    """Dawid-Skene over vote patterns: for each kind P(personal) of each pattern, and each labeler's (sensitivity, specificity)."""
    by: dict = defaultdict(lambda: defaultdict(float))
    for r in counts:
        by[r["kind"]][r["v1"], r["v2"], r["v3"]] += r["n"]
    out = {}
    for kind, pats in by.items():
        prior, rel = 0.5, [(0.9, 0.9), (0.7, 0.7), (0.6, 0.6)]
        post: dict = {}
        for _ in range(rounds):
            for p in pats:
                a, b = prior, 1 - prior
                for v, (sens, spec) in zip(p, rel, strict=True):
                    a *= 1 if v < 0 else sens if v else 1 - sens
                    b *= 1 if v < 0 else 1 - spec if v else spec
                post[p] = a / (a + b)
            total = sum(pats.values())
            prior = (sum(n * post[p] for p, n in pats.items()) + 1) / (total + 2)
            new = []
            for j in range(3):
                # priors of the labelers' rates, so that none is judged on few votes: better than chance on both classes
                tp = sum(n * post[p] for p, n in pats.items() if p[j] == 1) + 4
                fn = sum(n * post[p] for p, n in pats.items() if p[j] == 0) + 1
                fp = sum(n * (1 - post[p]) for p, n in pats.items() if p[j] == 1) + 1
                tn = sum(n * (1 - post[p]) for p, n in pats.items() if p[j] == 0) + 4
                new.append((tp / (tp + fn), tn / (tn + fp)))
            rel = new
        out[kind] = (dict(post), rel)
    return out


def train(counts: list, accept: float = ACCEPT) -> list[str]:
    """The feature values, as keys, of which the final classifier says personal."""
    rel = reliabilities(counts)
    weight: dict = defaultdict(lambda: [1.0, 1.0])
    total: dict = defaultdict(lambda: [1.0, 1.0])
    for r in counts:
        p = rel[r["kind"]][0][r["v1"], r["v2"], r["v3"]]
        total[r["kind"]][0] += r["n"] * p
        total[r["kind"]][1] += r["n"] * (1 - p)
        for f in ("v1", "v2", "v3", "size", "edge"):
            w = weight[r["kind"], f, r[f]]
            w[0] += r["n"] * p
            w[1] += r["n"] * (1 - p)
    keys = []
    for r in counts:
        yes, no = total[r["kind"]]
        z = math.log(yes / no)
        for f in ("v1", "v2", "v3", "size", "edge"):
            a, b = weight[r["kind"], f, r[f]]
            z += math.log(a / (yes + 2)) - math.log(b / (no + 2))
        if z >= math.log(accept / (1 - accept)):
            keys.append(_key_of(r))
    return sorted(set(keys))


def _key_of(r) -> str:
    return "|".join(str(r[f]) for f in ("kind", "v1", "v2", "v3", "size", "edge"))


def apart(spans: Column) -> Column:
    """The spans, in order of their starts, less those that are not base matches and overlap one that is.

    One pass to the right finds how far the base matches before a span reach; one to the left, where the next begins.
    """
    far = (1 << 31) - 1
    reach = scan(spans, F.lit(0), "int", lambda at, x: F.when(x["base"], F.greatest(at, x["e"])).otherwise(at))
    begins = F.reverse(scan(F.reverse(spans), F.lit(far), "int", lambda at, x: F.when(x["base"], x["s"]).otherwise(at)))
    pair = F.zip_with(reach, begins, lambda a, b: F.struct(a.alias("reach"), b.alias("next")))
    each = F.zip_with(spans, pair, lambda x, p: F.struct(x.alias("x"), (x["base"] | ((p["reach"] <= x["s"]) & (p["next"] >= x["e"]))).alias("ok")))
    return F.transform(F.filter(each, lambda z: z["ok"]), lambda z: z["x"])


def label(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, text, the input row and the accepted candidates in order (``spans``), the base ones among them marked."""
    found = C.materialise(candidates(docs))  # searched once, for the counts and for the spans
    keys = train(pattern_counts(found), accept)
    key = lambda x: F.concat_ws("|", x["kind"], *(x[f].cast("string") for f in ("v1", "v2", "v3", "size", "edge")))
    known = F.array(*[F.lit(k) for k in keys]).cast("array<string>")
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    kept = F.filter("found", lambda x: x["base"] | F.array_contains(known, key(x)))
    order = F.array_sort(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), rank(x).alias("k"), x["e"].alias("e"), x["kind"].alias("kind"), x["base"].alias("base"))))
    placed = found.withColumn("kept", order)
    mixed = F.exists("kept", lambda x: ~x["base"])
    row = F.col("row")
    return placed.select(row["doc_id"].alias("doc_id"), cleaned(row["text"]).alias("text"), "row", F.when(mixed, apart(F.col("kept"))).otherwise(F.col("kept")).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    return let(chunks(text), lambda cut: _redact(cut, spans))


def _redact(cut: Column, spans: Column) -> Column:
    put = lambda x, at: F.when(x["s"] < at, F.lit("")).otherwise(F.concat(between(cut, at, x["s"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))

    def pieces(reach: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(0)), reach), 1, F.size(spans))
        end = let(F.coalesce(F.try_element_at(reach, F.lit(-1)), F.lit(0)), lambda at: between(cut, at, F.size(cut) * CHUNK))
        return F.concat(F.array_join(F.zip_with(spans, before, put), ""), end)

    return let(scan(spans, F.lit(0), "int", lambda at, x: F.greatest(at, x["e"])), pieces)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = label(C.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", *(count(k) for k in KINDS[:4]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The contract's base spans, said plainly, for tests."""
    import re

    text, out = text or "", []
    digits = lambda s: [int(c) for c in s if c.isascii() and c.isdigit()]
    check = lambda d: sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    for kind, p, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and check(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ):
        out += [(m.start(), KINDS.index(kind), m.end(), kind) for m in re.finditer(p, text) if ok(m[0])]
    return [(k, s, e) for s, _, e, k in sorted(out)]
