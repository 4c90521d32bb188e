"""Operators with exact contracts, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemill.llm import ann, common, decontaminate, lm_score, near_dedup, packing, pii, substring_dedup, suffix_dedup


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def windows_brute(texts, n):
    first = {}
    ws = {k: words(v) for k, v in texts.items()}
    for k in sorted(ws):
        for i in range(len(ws[k]) - n + 1):
            first.setdefault(tuple(ws[k][i : i + n]), k)
    out = {}
    for k, w in ws.items():
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < k:
                gone[i : i + n] = [True] * n
        out[k] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("depth", [1, 2])
def test_substring_dedup(unique, by_id, depth):
    got = {r["doc_id"]: tuple(r)[1:4] for r in substring_dedup.substring_dedup(unique, depth=depth, with_text=True).collect()}
    assert got == windows_brute(by_id, 13)


def test_substring_dedup_defined_cases(docs):
    got = substring_dedup.substring_dedup(docs).collect()
    assert len(got) == docs.count()
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] is None)
    assert len({(r["n_removed"], r["kept_sha256"]) for r in got if r["doc_id"] == 7}) == 1


@pytest.mark.parametrize("length", [200, 40])
def test_suffix_dedup(unique, by_id, length):
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix_dedup.suffix_dedup(unique, length, with_text=True).collect()}
    assert got == suffix_dedup.brute_force(by_id, length)


def lm_brute(texts, order, d=lm_score.DISCOUNT):
    low = lambda t: re.sub(rb"[A-Z]", lambda m: m[0].lower(), t)
    docs = {k: [low(w) for w in words(v)] + [None] for k, v in texts.items()}
    train = [k for k in docs if not lm_score.is_held_out(k)]
    c1 = Counter(w for k in train for w in docs[k])
    n, v, n1 = sum(c1.values()), len(c1), sum(x == 1 for x in c1.values())
    grams, seen = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    ctx = lambda w, i, m: ((m,) if i < m - 1 else ()) + tuple(w[max(0, i - m + 1) : i])
    for k in train:
        for i, x in enumerate(docs[k]):
            for m in range(2, order + 1):
                grams[m][ctx(docs[k], i, m), x] += 1
                seen[m][ctx(docs[k], i, m)] += 1
    mass = [Counter() for _ in range(order + 1)]
    for m in range(2, order + 1):
        for (c, _), x in grams[m].items():
            mass[m][c] += x - d if x >= 2 else 0
    out, unk = {}, (n1 + 0.5) / (n + 1)
    for k, w in docs.items():
        base = score = 0.0
        for i, x in enumerate(w):
            base += math.log10((c1[x] + 0.1) / (n + 0.1 * (v + 1)))
            p = (1 - unk) * c1[x] / n if c1[x] else unk
            for m in range(2, order + 1):
                c = ctx(w, i, m)
                if seen[m][c] >= 2:
                    own = grams[m][c, x]
                    p = ((own - d) / seen[m][c] if own >= 2 else 0) + (1 - mass[m][c] / seen[m][c]) * p
            score += math.log10(p)
        out[k] = (len(w), sum(x in c1 for x in w), n, base, score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_score(unique, by_id, order):
    want = lm_brute(by_id, order)
    got = {r["doc_id"]: r for r in lm_score.lm_score(unique, order).collect()}
    assert got.keys() == want.keys()
    for k, (n, known, total, base, score) in want.items():
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 10 == 0)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_lm_without_training(spark):
    held = next(i for i in range(100) if lm_score.is_held_out(i))
    r = lm_score.lm_score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"], r["score"]) == (0, 0, 3, 0.0)


@pytest.mark.parametrize("slice_words", [1_000_000, 40, 5])
def test_decontaminate(unique, by_id, benchmark, slice_words):
    """Whole items and items cut in slices of a few words give the same hits."""
    tests = {}
    for r in benchmark.collect():
        tests.setdefault(r["item_id"], []).append(r["text"])
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.decontaminate(unique, benchmark, slice_words=slice_words).collect()}
    flat = {f"{k}.{i}": t for k, ts in tests.items() for i, t in enumerate(ts)}
    want = decontaminate.brute_force(by_id, flat)
    for k, (n, hit, _, _, bad, _) in want.items():
        own = [decontaminate.brute_force({0: by_id[k]}, {x: flat[x]})[0] for x in flat]
        items = sorted({x.split(".")[0] for x, o in zip(flat, own, strict=True) if o[1]})
        assert got[k][:5] == (n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bad)
        assert slice_words < 100 or got[k][5] == sum(o[5] for o in own)


def test_proximity_matches(spark):
    """A window with its rarest words changed, and one in whose place a word is missing, is near; three words are the most."""
    item = [f"t{i}" for i in range(13)]
    odd = [item, [*item[:3], "x", *item[4:]], ["x", "y", "z", *item[3:]], ["x", "y", "z", "u", *item[4:]], item[:12] + ["x"] + item]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(odd)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in decontaminate.decontaminate(docs, spark.createDataFrame([("a", " ".join(item))], "item_id string, text string")).collect()}
    assert got == {0: (13, 0), 1: (0, 1), 2: (0, 1), 3: (0, 0), 4: (13, 1)}


ODD = [
    "a@b.cd_x@y.z a@b a..b@c.d. x@-.- 1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.4 1.1.1.99999999999999999999",
    "4111 1111 1111 1111 4111-1111-1111-1111 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1  4111  1111",
    "+1 (843) 555-7672 +12 +1234567890123456 +1 2..3(4)5-6 7 8 9. +1()2",
    "é\U0001f600 a@b.c  x@y.z  a@b.c",
    None,
    "",
    "1" * 20000,
    "a" * 20000 + "@",
    "1.1.1.1 " * 150,
    "4 " * 5000 + "4",
    "x@" + "a." * 5000 + "b",
]


def test_pii_base_spans(spark, by_id):
    rows = list(enumerate([*ODD, *by_id.values()]))
    got = pii.label(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in got.select("doc_id", pii.joined(F.filter("spans", lambda x: x["base"])).alias("s")).collect():
        assert r["s"] == ",".join(f"{k}:{a}:{b}" for k, a, b in pii.brute_force(rows[r["doc_id"]][1])), r["doc_id"]


def test_pii_random_texts(spark):
    import random

    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("aB1234567890....@@--++()  _%é", k=rng.randint(0, 60)))) for i in range(400)]
    got = pii.label(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in got.select("doc_id", pii.joined(F.filter("spans", lambda x: x["base"])).alias("s")).collect():
        assert r["s"] == ",".join(f"{k}:{a}:{b}" for k, a, b in pii.brute_force(rows[r["doc_id"]][1])), rows[r["doc_id"]]


def test_pii_redacts(spark):
    df = spark.createDataFrame([(1, "to é a@b.cd, or +1 (843) 555-7672!")], "doc_id long, text string")
    assert pii.label(df).select(pii.redact(F.col("text"), F.col("spans")).alias("t")).first()["t"] == "to é [EMAIL], or [PHONE]!"


def test_pii_very_many_matches(spark):
    """50,000 matches in one text, found, classified and redacted in time that grows with the text."""
    import time

    text = "".join(f"mail é{i} to user{i}@mail{i}.com or +1 (843) 555-{i % 10000:04d}, (212) 555-0100; " for i in range(25_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.label(df.selectExpr("doc_id", "left(text, 300) AS text")).collect()
    began = time.time()
    got = pii.label(df).select(pii.joined(F.filter("spans", lambda x: x["base"])).alias("s"), pii.redact(F.col("text"), F.col("spans")).alias("t")).first()
    assert time.time() - began < 40  # two passes of some seconds each; the quadratic form took over 300 s for 8,000
    assert got["s"] == ",".join(f"{k}:{a}:{b}" for k, a, b in pii.brute_force(text))
    want = re.sub(r"user[0-9]+@mail[0-9]+[.]com", "[EMAIL]", re.sub(r"[+]1 [(]843[)] 555-[0-9]{4}", "[PHONE]", text))
    assert got["t"] in (want, want.replace("(212) 555-0100", "[PHONE]"))


def test_pii_overlaps_and_chunks(spark):
    """Extras that overlap a base match go, and redaction is right where spans cross chunk edges."""
    rows = [(i, "x" * (pii.CHUNK - i) + " a@b.cd " + "y" * (2 * pii.CHUNK) + " 1.2.3.4") for i in range(12)]
    rows.append((99, "key " + "a1" * 20 + "@b.cd"))
    got = {r["doc_id"]: r for r in pii.label(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "spans", pii.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    for i, text in rows[:-1]:
        assert got[i]["t"] == text.replace("a@b.cd", "[EMAIL]").replace("1.2.3.4", "[IP]")
    assert [x["kind"] for x in got[99]["spans"]] == ["email"]


def test_apart_keeps_what_overlaps_no_base_match(spark):
    import random

    rng = random.Random(2)
    for _ in range(8):
        spans = sorted({(a := rng.randint(0, 200), rng.randint(1, 5), a + rng.randint(1, 12), "k", rng.random() < 0.5) for _ in range(40)})
        df = spark.createDataFrame([(spans,)], "spans array<struct<s:int,k:int,e:int,kind:string,base:boolean>>")
        got = [tuple(x) for x in df.select(pii.apart(F.col("spans")).alias("x")).first()["x"]]
        assert got == [x for x in spans if x[4] or not any(y[4] and x[0] < y[2] and y[0] < x[2] for y in spans)]


def test_near_dedup_of_repeated_ids(spark):
    """Rows of one id with unlike texts are linked through it, whichever text is the smaller."""
    rng = np.random.default_rng(1)
    a, b = ([f"{c}{i}" for i in rng.integers(0, 900, 120)] for c in "ab")
    near = lambda w: " ".join([*w[:-1], "z"])
    for first in (7, 70):
        rows = [(first, " ".join(a)), (first, " ".join(b)), (9, near(b)), (11, near(a)), (12, "other words")]
        got = {(r["doc_id"], r["class_id"]) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {(k, min(first, 9)) for k in (first, 9, 11)} | {(12, 12)}


def test_near_dedup(unique, by_id):
    want = near_dedup.brute_force(by_id)
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(unique).collect()}
    assert {k: r["class_id"] for k, r in got.items()} == want
    assert all(r["is_kept"] == (r["class_id"] == k) for k, r in got.items())


def test_near_dedup_chain_within_a_bucket(spark):
    """A chain of edits: neighbours are linked, ends are not; the class is the whole chain."""
    w = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(12):
        for j in range(3):
            w[(k * 16 + j * 5) % 200] = f"n{k}.{j}"
        rows.append((k, " ".join(w)))
    want = near_dedup.brute_force(dict(rows))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    a = rng.uniform(0.2, 9, 300)
    b = np.where(np.arange(300) < 100, a * 0.3, a)
    s = near_dedup.signatures(np.concatenate([e, e]), np.array([300, 300]), 2048, np.concatenate([a, b]))
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_packing(unique, by_id):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = packing.pack(unique, 256, ids=True).toPandas()
    for k, text in by_id.items():
        ids = np.array([*tk.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        p = rows[rows.doc_id == k].sort_values("piece")
        assert b"".join(p.ids) == ids.tobytes() and list(p.start) == list(p.length.cumsum() - p.length)
        assert len(p) == math.ceil(len(ids) / 256) and (p.length.iloc[1:] == 256).all()
        assert [zlib.crc32(x) for x in p.ids] == list(p.ids_crc32)
    at = rows.sort_values(["sequence_id", "offset"])
    assert (at.offset == at.groupby("sequence_id").length.cumsum() - at.length).all()
    assert at.groupby("sequence_id").length.sum().max() <= 256
    assert rows.sequence_id.nunique() <= math.ceil(rows.length.sum() / 256) + 2


def test_encoders_agree():
    """The rank file and the tokenizer's own file give the same ids, also on random Unicode."""
    import random

    from public_tokenizers import path
    from tokenizers import Tokenizer

    rng, slow = random.Random(4), Tokenizer.from_file(path("byte_bpe_50k.json"))
    ranges = [(0x20, 0x7E), (0x9, 0xD), (0xA0, 0x24F), (0x300, 0x36F), (0x400, 0x4FF), (0x5D0, 0x5EA), (0x660, 0x669), (0x900, 0x97F), (0x2000, 0x206F), (0x3040, 0x30FF), (0x4E00, 0x4EFF), (0x1F600, 0x1F64F), (0xE000, 0xE010), (0, 0x1F)]
    texts = ["<|endoftext|> a", "a" * 3000, " " * 3000, "don't  stop\n\n\n x", "　é\U0001f600", "1234567 ab12"]
    for _ in range(2000):
        own = rng.sample(ranges, rng.randint(1, 4))
        texts.append("".join(chr(rng.randint(*rng.choice(own))) for _ in range(rng.randint(1, 40))))
    for t in texts:
        assert list(packing.encoder()(t)) == slow.encode(t, add_special_tokens=False).ids, repr(t)


def test_plan_holds_the_histogram():
    rng = np.random.default_rng(3)
    h, report = Counter(rng.integers(1, 400, 5000).tolist()), {}
    plan = packing.plan(dict(h), 512, report)
    held = Counter()
    for cfg, n in plan:
        assert sum(s * c for s, c in cfg.items()) <= 512
        held.update({s: c * n for s, c in cfg.items()})
    n = sum(n for _, n in plan)
    assert held == h and report["sequences"] == n
    assert math.ceil(sum(s * c for s, c in h.items()) / 512) <= report["bound"] <= n <= report["bound"] * 1.001 + 1
    assert report["residual"] < 0.05
    assert packing.plan({}) == []


def test_packing_bound_is_below_every_packing():
    """Halves and thirds that do not mix: the volume says 5 sequences, the averaged prices prove 6; brute force finds 6."""
    assert packing.solve(np.array([6]), np.array([6.0]), 10).bound == pytest.approx(6, abs=0.1)
    report = {}
    assert sum(n for _, n in packing.plan({6: 4, 5: 3}, 10, report)) == 6 and report["bound"] <= 6
    rng = np.random.default_rng(8)
    for _ in range(20):
        pieces = sorted(rng.integers(2, 12, 7).tolist(), reverse=True)
        best = len(pieces)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(pieces):
                best = len(rooms)
                return
            for j, r in enumerate(rooms):
                if r >= pieces[i]:
                    place(i + 1, [*rooms[:j], r - pieces[i], *rooms[j + 1 :]])
            place(i + 1, [*rooms, 12 - pieces[i]])

        place(0, [])
        report = {}
        packing.plan(dict(Counter(pieces)), 12, report)
        assert report["bound"] <= best <= report["sequences"]


def test_ann(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((1500, 16))
    v[200:500] = v[200]  # a common vector
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0, None]), (5200, [1.0] * 4), (None, [1.0] * 16)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = ann.brute_force(np.arange(1500), v.astype(np.float32).astype(float))
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.97
    assert got[250] == [200, 201, 202, 203, 204]  # ties go to the smaller ids
    odd = [(50, [1.0, 0.0]), (50, [1.0, 0.1]), *((i, [1.0, i / 10]) for i in range(1, 8))]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(spark.createDataFrame(odd, "vec_id long, embedding array<double>")).collect()]
    want = [(50, 1, 1), (50, 2, 50), (50, 3, 2), (50, 4, 3), (50, 5, 4), (50, 1, 1), (50, 2, 2), (50, 3, 50), (50, 4, 3), (50, 5, 4)]
    assert sorted(got) == sorted(want)  # each row is a query, and finds the other one once
    huge = spark.createDataFrame([(0, [1e200, 0.0], 9), (1, [1e200, 1e200], 9), (2, [1e-200, 0.0], 9), (3, [0.0, 1e300], 9)], "vec_id long, embedding array<double>, rank int")
    got = ann.nearest(huge.withColumns({n: F.lit("odd") for n in ("row", "cell", "block", "v", "score", "query", "bound", "seen")})).orderBy("rank").collect()
    assert [(r["vec_id"], pytest.approx(r["score"])) for r in got] == [(2, 1.0), (1, 0.5**0.5), (3, 0.0)]
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r)[:3] for r in few] == [(0, 1, 1)]


def test_ann_stops_early(spark):
    """Several cells and crowded ones: recall against all rows, and far from all of them verified."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((6000, 32))
    v[3000:4500] = v[3000] + rng.standard_normal((1500, 32)) * 0.05
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_rows=700).collect()
    want, found = ann.brute_force(np.arange(6000), v), {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(found[q] & set(want[q])) / 5 for q in want]) >= 0.9
    assert np.mean([r["n_verified"] for r in got]) < 0.4 * 6000


def test_packet_numbers_at_any_size():
    """Block, shard and packet numbers fit their columns, do not meet, and packets stay in proportion from 64 GB to 100 TB."""
    per_gb = []
    for n_bytes in (64 << 30, 1 << 40, 10 << 40, 100 << 40):
        for block_bytes in (common.BLOCK_BYTES, lm_score.BLOCK_BYTES):
            blocks = common.block_count(1 << 50, n_bytes, block_bytes)
            bits = common.shard_bits(n_bytes // 2)
            wide = 2 * (1 << bits) + 1
            assert blocks < 1 << 31 and bits < 40
            common.packets([(blocks - 1, common.carried(blocks - 1, wide - 1, wide), b""), (0, (3 << 40) + (1 << bits) - 1, b"")])
            assert common.carried(blocks - 1, 0, wide) < common.carried(blocks - 2, wide - 1, wide)
        per_gb.append(blocks * (1 << bits) / (n_bytes >> 30))
        sketches = [common.Sketch(n_bytes // 6, r) for r in range(3)]
        assert all(a.first + (1 << a.shard_bits) <= b.first for a, b in zip(sketches, sketches[1:], strict=False))
    assert max(per_gb) < 4 * min(per_gb)


def test_sketch_loses_nothing():
    rng = np.random.default_rng(5)
    keys = [common.uniq(rng.integers(0, 3000, 900).astype(np.uint64)) for _ in range(4)]
    s = common.Sketch(4000, 0)
    sent = [p for b, k in enumerate(keys) for p in s.pack(b, k)]
    replies = {}
    for shard in {p[1] for p in sent}:
        for r in common.sketch_merge(common.packets([p for p in sent if p[1] == shard])).to_pylist():
            replies.setdefault(r["block"], []).append((r["block"], r["shard"], r["payload"]))
    times = Counter(np.concatenate(keys).tolist())
    for b, k in enumerate(keys):
        got = s.repeated(k, common.packets(replies[b]))
        assert all(g for x, g in zip(k.tolist(), got, strict=True) if times[x] > 1)
        assert got.mean() < 0.9
