"""Near-duplicates by DartMinHash signatures, banded joins and exact verification.

Similarity is the Jaccard similarity of the sets of ``shingle`` consecutive words (whitespace-separated,
A-Z lower-cased; a shorter document is one shingle); documents at ``threshold`` or more are linked, and linked
documents, directly or not, form a class.

1. DartMinHash: each element's darts are a fixed Poisson process over weight x rank, generated from the
   element's hash cell by cell; those under the element's weight count.  A document throws enough of them to
   hit every one of k coordinates and keeps the earliest on each; two documents share a coordinate with the
   probability of their weighted Jaccard similarity.  Elements may carry weights; the query's are all 1.
2. Documents with equal shingle sets are one class from the start, whatever their number: one of them goes on.
3. Signatures are cut in ``bands`` of ``rows`` coordinates.  Documents that share a band share a bucket.
   A bucket's members are compared with one member, not with each other: first the one that meets most others over
   all its buckets (the text that a group of copies was made from meets more of them than they meet one another;
   of like ones the smallest id), in a second round a randomly drawn one, leaving out those already in its class.  Members of buckets that still
   hold several classes then meet through their rarest shingles (prefix filtering), which loses no pair.
4. Candidates are verified on whole shingle sets, of 64-bit hashes (two unlike shingles among 10**6 of a pair share one with
   probability 3e-8); classes are connected components by minimum labels.

At similarity 0.8 a pair shares none of 24 bands of 4 coordinates with probability 3e-6.

Defined results: null, empty and all-blank texts have no shingles and are classes of their own; a null
doc_id takes no part in classes (class_id null); rows with one doc_id and different texts are linked through
that id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

SHINGLE, THRESHOLD, BANDS, ROWS, ROUNDS = 5, 0.8, 24, 4, 1
LOW = -14  # rank cells begin at [0, 2**LOW)
SIGNED = "doc_id long, set_hash long, bands array<long>"
RESULT = "doc_id long, class_id long, is_kept boolean"


def shingles(text, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, text by text, and the number of each."""
    h, counts = C.word_hashes(text, lower=True)
    w, at = C.window_hashes(h, counts, n)
    edges = np.r_[0, np.cumsum(counts)]
    doc = np.searchsorted(edges, at, "right") - 1
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = []
        for i in short.tolist():
            x = np.array([counts[i]], C.U64)
            for q in h[edges[i] : edges[i + 1]]:
                x = C.mix(x * C.U64(C.BASE) + q)
            own.append(x[0])
        w, doc = np.concatenate([w, np.array(own, C.U64)]), np.concatenate([doc, short])
    order = np.lexsort((w, doc))
    w, doc = w[order], doc[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
    return w[new], np.bincount(doc[new], minlength=len(counts))


@lru_cache(maxsize=64)
def _poisson(area: float) -> np.ndarray:
    """Distribution function of the number of darts in a cell, as 64-bit fractions."""
    p, total, out, i = exp(-area), 0.0, [], 0
    while total < 1 - 1e-15 and i < 10_000:
        total += p
        out.append(min(total, 1.0))
        i += 1
        p *= area / i
        if p < 1e-18 and i > area:
            break
    return np.array(out)


def signatures(elements: np.ndarray, counts: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """k coordinates for each set (0 for an empty set)."""
    n, doc = len(counts), np.repeat(np.arange(len(counts)), counts)
    w = np.ones(len(elements)) if weights is None else weights
    total = np.bincount(doc, w, n)
    out = np.full((n, k), np.iinfo(np.uint64).max, C.U64)
    reach = np.where(total > 0, (k * log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        live = np.zeros(n, bool)
        live[todo] = True
        _throw(out, elements, doc, w, reach, live, k)
        todo = todo[(out[todo] == np.iinfo(np.uint64).max).any(1)]
        reach[todo] *= 2
    out[total <= 0] = 0
    return out


def _throw(out, elements, doc, w, reach, live, k) -> None:
    flat = out.reshape(-1)
    far = np.where(live, reach, 0.0)[doc]
    for nu in range(max(1, int(np.ceil(np.log2(max(w.max(initial=1), 1)))) + 1)):
        w_low, w_size = (0.0, 1.0) if nu == 0 else (2.0 ** (nu - 1), 2.0 ** (nu - 1))
        j = LOW
        while True:
            r_low, r_size = (0.0, 2.0**LOW) if j == LOW else (2.0 ** (j - 1), 2.0 ** (j - 1))
            own = np.flatnonzero((far > r_low) & (w > w_low))
            if not len(own):
                break
            seed = C.U64((nu * 4096 + j - LOW + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            cell = C.mix(elements[own] ^ seed)
            number = np.searchsorted(_poisson(w_size * r_size), (cell >> C.U64(11)).astype(float) * 2.0**-53, "right")
            hit = number > 0
            own, cell, number = own[hit], cell[hit], number[hit]
            which = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
            own, cell = np.repeat(own, number), np.repeat(cell, number)
            dart = C.mix(cell + (which.astype(C.U64) + C.U64(1)) * C.U64(C.BASE))
            more = C.mix(dart ^ C.U64(0x7F4A7C15))
            if nu:
                height = w_low + w_size * ((more >> C.U64(40)).astype(float) * 2.0**-24)
                ok = height < w[own]
                own, dart, more = own[ok], dart[ok], more[ok]
            # rank in the high bits, the dart's own bits below: the least is the earliest, and names the dart
            level = C.U64(j - LOW) << C.U64(58)
            packed = level | (dart >> C.U64(6))
            at = doc[own] * k + (more & C.U64(0xFFFFFFFF)).astype(np.int64) % k
            np.minimum.at(flat, at, packed)
            j += 1


def _parts(batches):
    """Batches cut to some megabytes of text, whatever the texts' lengths."""
    for b in batches:
        for i, j in C.pieces(C.text_bytes(b["text"])[1], 2 << 20):
            yield b.slice(i, j - i)


def set_hashes(w: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A hash of each text's shingle set, null for an empty one."""
    edges, full, whole = np.r_[0, np.cumsum(counts)], counts > 0, np.zeros(len(counts), C.U64)
    if full.any():
        whole[full] = np.add.reduceat(C.mix(w ^ C.U64(0x1234567)), edges[:-1][full])
    return pa.array(C.mix(whole).view(np.int64), mask=~full)


def _signed(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    def run(batches):
        for part in _parts(batches):
            w, counts = shingles(part["text"], n)
            sig = signatures(w, counts, bands * rows).reshape(-1, bands, rows)
            key = np.zeros((len(counts), bands), C.U64) + np.arange(bands, dtype=C.U64)
            for q in range(rows):
                key = C.mix(key * C.U64(C.BASE) + sig[:, :, q])
            flat = pa.ListArray.from_arrays(np.arange(0, (len(counts) + 1) * bands, bands, dtype=np.int32), key.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([part["doc_id"], set_hashes(w, counts), flat], names=["doc_id", "set_hash", "bands"])

    return docs.select("doc_id", C.text_column().alias("text")).mapInArrow(C.tidied(run), SIGNED)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, x): the shingle sets of some texts as 64-bit hashes, by the hash of the set; one row a text."""

    def run(batches):
        for part in _parts(batches):
            w, counts = shingles(part["text"], n)
            edges = np.r_[0, np.cumsum(counts)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([set_hashes(w, counts), pa.ListArray.from_arrays(edges, w.view(np.int64))], names=["id", "x"])

    return docs.select(C.text_column().alias("text")).mapInArrow(C.tidied(run), "id long, x array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, sim) of the pairs."""
    a, b = sets.select(F.col("id").alias("a"), F.col("x").alias("xa")), sets.select(F.col("id").alias("b"), F.col("x").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", (both / (F.size("xa") + F.size("xb") - both)).alias("sim"))


def components(links: DataFrame) -> DataFrame:
    """(id, label): the least id that each id of the links is connected with, by minimum labels and shortcuts."""
    both = C.materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = C.materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = label.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = label.select(F.col("id").alias("label"), F.col("label").alias("over"))
        new = C.materialise(step.join(up, "label").select("id", "was", F.least("label", "over").alias("label")))
        if new.filter("was != label").isEmpty():
            return new.select("id", "label")
        label = new.select("id", "label")


def _sharing_rare(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of members of different classes that share one of their rarest shingles.

    With its shingles in one global order, a set of n has any partner at the threshold or above on one of its
    first n - ceil(threshold * n) + 1; rarest first, these are mostly its own.  The first common shingle must leave
    room for the overlap that the two sizes ask for, which drops most of the pairs that share only what is common
    to a whole group.  No pair is lost.
    """
    one = members.join(sets, "id")
    # shingles of one member only can match nothing; they count by their number, as the first in the order
    each = one.select("id", "label", F.size("x").alias("n"), F.explode("x").alias("s"))
    shared = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    known = each.join(shared, "s")
    own = F.col("n") - F.count(F.lit(1)).over(W.partitionBy("id"))
    place = own + F.row_number().over(W.partitionBy("id").orderBy("df", "s"))
    placed = known.select("id", "label", "s", "n", place.alias("place"))
    probe = placed.filter(F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
    # of two sets the smaller has the common shingle even earlier, as the overlap is at least 2t/(1+t) of its size
    index = placed.filter(F.col("place") <= F.col("n") - F.ceil(2 * threshold / (1 + threshold) * F.col("n") - 1e-9) + 1)
    index = index.select("s", *[F.col(c).alias(f"{c}2") for c in ("id", "label", "n", "place")])
    smaller = (F.col("n2") < F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("id2") < F.col("id")))
    overlap = F.ceil(threshold / (1 + threshold) * (F.col("n") + F.col("n2")) - 1e-9)
    room = 1 + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))  # what can still be common from here on
    pairs = probe.join(index, "s").filter((F.col("label") != F.col("label2")) & smaller & (F.col("n2") >= threshold * F.col("n") - 1e-9) & (room >= overlap))
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), is_kept (true for one document of each class)."""
    signed = C.materialise(_signed(docs, bands, rows, shingle))
    ok = signed.filter(F.col("doc_id").isNotNull() & F.col("set_hash").isNotNull())
    # equal shingle sets are one member, under the hash of the set; its least doc_id stands for it
    rep = ok.groupBy("set_hash").agg(F.min(F.struct("doc_id", "bands")).alias("m")).select(F.col("set_hash").alias("id"), F.col("m.doc_id").alias("doc_id"), F.col("m.bands").alias("bands"))
    bucket = rep.select("id", "doc_id", F.explode("bands").alias("bucket"))
    crowd = bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    member = C.materialise(bucket.join(crowd, "bucket").select("bucket", "id", "doc_id", "n"))
    meets = member.groupBy("id").agg((-F.sum("n")).alias("met"))
    first = member.join(meets, "id").groupBy("bucket").agg(F.min(F.struct("met", "doc_id", "id")).alias("m")).select("bucket", F.col("m.id").alias("first"))
    wanted = member.select("id").distinct()
    texts = docs.select("doc_id", "text").join(rep.select("id", "doc_id").join(wanted, "id").select("doc_id").distinct(), "doc_id")
    sets = C.materialise(_sets(texts, shingle).join(wanted, "id", "left_semi").dropDuplicates(["id"]))
    star = member.join(first, "bucket").filter("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    known = C.materialise(_verified(star, sets))
    # rows with one doc_id and different texts are linked through that id
    several = ok.groupBy("doc_id").agg(F.min("set_hash").alias("a"), F.max("set_hash").alias("z")).filter("a != z").select("doc_id", "a")
    same = ok.join(several, "doc_id").filter("set_hash != a").select("a", F.col("set_hash").alias("b")).distinct()
    links = C.materialise(known.filter(F.col("sim") >= threshold).select("a", "b").unionByName(same))
    label = components(links)

    def placed(left: DataFrame) -> DataFrame:
        """Members of the buckets that still hold several classes, with their classes."""
        x = left.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
        mixed = x.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("bucket")
        return C.materialise(x.join(mixed, "bucket"))

    left = placed(member.filter("n > 2").select("bucket", "id"))
    for r in range(1, rounds + 1):
        if left.isEmpty():
            break
        drawn = left.groupBy("bucket").agg(F.min_by(F.struct("id", "label"), F.xxhash64("id", F.lit(r))).alias("d"))
        pairs = left.join(drawn, "bucket").filter((F.col("label") != F.col("d.label")) & (F.col("id") != F.col("d.id")))
        pairs = pairs.select(F.least("id", "d.id").alias("a"), F.greatest("id", "d.id").alias("b")).distinct()
        got = _verified(pairs, sets).filter(F.col("sim") >= threshold).select("a", "b")
        links = C.materialise(links.unionByName(got))
        label = components(links)
        left = placed(left.drop("label"))
    if not left.isEmpty():
        pairs = _sharing_rare(left.select("id", "label").distinct(), sets, threshold)
        got = _verified(pairs, sets).filter(F.col("sim") >= threshold)
        label = components(C.materialise(links.unionByName(got.select("a", "b"))))
    # a class goes by its least doc_id; sets without a link are classes of their own
    linked = label.join(rep.select("id", "doc_id"), "id")
    least = linked.groupBy("label").agg(F.min("doc_id").alias("least"))
    by_set = rep.select("id", "doc_id").join(linked.join(least, "label").select("id", "least"), "id", "left")
    by_set = by_set.select(F.col("id").alias("set_hash"), F.coalesce("least", "doc_id").alias("class_id"))
    out = signed.select("doc_id", "set_hash").join(by_set, "set_hash", "left")
    class_id = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", class_id.alias("class_id")).withColumn("is_kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(C.table(spark, sf_dir, "documents"))


#: Pairs that share a shingle, their similarity, and classes as what each document reaches over links; for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(k, chr(1) ORDER BY k)) AS h FROM s GROUP BY 1),
r AS (SELECT h, min(n) AS n, min(doc_id) AS rep FROM n GROUP BY 1),
x AS (SELECT rep, k FROM s JOIN r ON s.doc_id = r.rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM x a JOIN x b ON a.k = b.k AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN r ra ON ra.rep = a JOIN r rb ON rb.rep = b WHERE c >= 0.8 * (ra.n + rb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT rep, rep FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, d.doc_id = coalesce(class_id, d.doc_id) AS is_kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.h = n.h LEFT JOIN c ON c.rep = r.rep
"""


def brute_force(texts: dict, threshold: float = THRESHOLD, n: int = SHINGLE) -> dict:
    """Classes by comparing all pairs that share a shingle, for tests."""
    import re

    sets = {}
    for k, v in texts.items():
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), v or ""))
        sets[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    parent = {k: k for k in sets}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    by: dict = {}
    for k, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(k)
    seen = set()
    for ks in by.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((top(a), top(b)))
                        parent[y] = x
    return {k: top(k) for k in sets}
