"""Benchmark decontamination with a distributed positional inverted index.

*Index* (``build``): documents are cut in segments of about ``SEGMENT_BYTES``; a segment holds its dictionary, the
sorted fingerprints of its words, and for each word the posting list of its positions in order.  Segments are
written as a table, once, whatever the benchmark; tokens are read from texts here and nowhere else.

*Search* (``search``), over the table of segments only, in slices of at most ``slice_words`` words of benchmark windows,
one after the other, so what a task gets is bounded whatever the benchmark:

1. the dictionaries are looked up, which gives the frequency of every benchmark term over all documents;
2. of every test window (``window`` consecutive words; a shorter item is one window) the terms are ordered by
   frequency, rarest first.  A window that keeps ``near`` words in place keeps one of its window - near + 1
   rarest, so the lists of these, less their offsets, hold all candidate alignments of it;
3. the lists of the other terms, less their offsets, are intersected with the candidates, rarest first; an
   alignment that has missed too many lists goes.  What is on all lists is an exact phrase match; what is on at
   least ``near`` lists, but not on all, is a proximity match (``n_near``; short windows have none).

Hits, of the few documents that have any, are united by document over the slices; one path serves any benchmark.

Defined results: a null text has no words; an item without words never matches; repeated items with one
item_id count once in n_items; repeated documents are judged each; empty tables give no rows, or no hits;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW, SHARE, NEAR = 13, 20, 10
SLICE_WORDS = 1_000_000  # words of the windows of a slice: some 210 MB in a task (windows and their order by frequency)
SEGMENT_BYTES = 2 << 20
SEGMENT = "segment long, ids array<long>, lengths array<int>, terms binary, ends binary, places binary"
SEGMENT_PA = pa.schema([("segment", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("terms", pa.binary()), ("ends", pa.binary()), ("places", pa.binary())])
HIT = "segment long, place int, bits binary, items array<string>, n_near long"
HIT_PA = pa.schema([("segment", pa.int64()), ("place", pa.int32()), ("bits", pa.binary()), ("items", pa.list_(pa.string())), ("n_near", pa.int64())])


# ---------------------------------------------------------------- the index


def build(docs: DataFrame) -> DataFrame:
    """The segments of the index, written: document ids and lengths, terms in order, where their lists end, and the positions."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for i, j in C.pieces(C.text_bytes(b["text"])[1], SEGMENT_BYTES):
                h, counts = C.word_hashes(b["text"].slice(i, j - i), C.NOT_ALNUM, lower=True)
                order = np.argsort(h, kind="stable")
                s = h[order]
                last = np.flatnonzero(np.r_[s[1:] != s[:-1], np.ones(min(1, len(s)), bool)])
                row = [[number], [b["doc_id"].slice(i, j - i).to_pylist()], [counts.astype(np.int32)], [s[last].tobytes()], [(last + 1).astype(np.uint32).tobytes()], [order.astype(np.uint32).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, SEGMENT_PA, strict=True)], schema=SEGMENT_PA)
                number += 1

    return C.materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_column().alias("text")).mapInArrow(C.tidied(run), SEGMENT))


class Segment:
    """A segment as read: ``postings(term)`` are the positions, in order, at which a term stands."""

    def __init__(self, terms: bytes, ends: bytes, places: bytes = b""):
        self.terms, self.ends = np.frombuffer(terms, C.U64), np.frombuffer(ends, np.uint32).astype(np.int64)
        self.places = np.frombuffer(places, np.uint32)

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the list of each of some terms begins, and its length (0: the term does not occur)."""
        if not len(self.terms) or not len(terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = self.terms[at] == terms
        begin = np.where(at > 0, self.ends[at - 1], 0)
        return begin, np.where(there, self.ends[at] - begin, 0)


# ---------------------------------------------------------------- the benchmark


@dataclass
class Tests:
    """A slice of the benchmark: terms in order; windows as rows of term numbers (-1 past a short window), their items and lengths."""

    terms: np.ndarray
    words: np.ndarray
    items: np.ndarray
    names: list[str]
    lengths: np.ndarray


def read_tests(rows: list[tuple[str, str]], window: int) -> Tests:
    """Distinct windows of each item from (name, text)."""
    names = sorted({name for name, _ in rows})
    number = {name: i for i, name in enumerate(names)}
    h, counts = C.word_hashes(pa.array([text for _, text in rows], pa.string()), C.NOT_ALNUM, lower=True)
    terms = C.uniq(h)
    at = np.searchsorted(terms, h)
    words, items = [np.zeros((0, window), np.int64)], [np.zeros(0, np.int64)]
    edges = np.r_[0, np.cumsum(counts)]
    for i, n in enumerate(counts.tolist()):
        own = at[edges[i] : edges[i + 1]]
        if n >= window:
            words.append(np.lib.stride_tricks.sliding_window_view(own, window))
        elif n:
            words.append(np.r_[own, np.full(window - n, -1)][None])
        items.append(np.full(max(n - window, 0) + 1 if n else 0, number[rows[i][0]]))
    both = np.unique(np.column_stack([np.concatenate(items), np.concatenate(words)]), axis=0)
    return Tests(terms, both[:, 1:], both[:, 0], names, (both[:, 1:] >= 0).sum(1))


def slices(benchmark: DataFrame, window: int, slice_words: int):
    """The benchmark in turn, item after item, long items in parts that overlap by a window less one word."""
    rows, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("name"), "text").filter("text IS NOT NULL AND item_id IS NOT NULL").toLocalIterator():
        a = C.LOWER[np.frombuffer(r["text"].encode(), np.uint8)]
        s, e, _ = C.word_spans(a, np.array([0, len(a)]), C.NOT_ALNUM)
        for i in range(0, max(len(s) - window, 0) + 1, slice_words):
            j = min(len(s), i + slice_words + window - 1)
            if j > i:
                rows.append((r["name"], a[s[i] : e[j - 1]].tobytes().decode()))
                held += j - i
            if held >= slice_words:
                yield read_tests(rows, window)
                rows, held = [], 0
    if rows:
        yield read_tests(rows, window)


# ---------------------------------------------------------------- the search


def frequencies(index: DataFrame, tests: Tests) -> np.ndarray:
    """How often each term occurs in all documents, from the dictionaries alone."""

    def count(batches):
        total = np.zeros(len(tests.terms), np.int64)
        for b in batches:
            for terms, ends in zip(b["terms"], b["ends"], strict=True):
                total += Segment(terms.as_py(), ends.as_py()).find(tests.terms)[1]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(tests.terms), np.int64)
    got = index.select("terms", "ends").mapInArrow(C.tidied(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a term of the slice
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out


def spread_out(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] of them, then those from begin[1] on, and so forth."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def matches(segment: Segment, counts: np.ndarray, tests: Tests, order: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alignments as (first position, window, whether all words are in place) of all windows that keep ``near`` words or more."""
    window, n_words = order.shape[1], int(counts.sum())
    begin, many = segment.find(tests.terms)
    # all postings of the benchmark's terms in one order, by term and position: lists are slices of it
    keys = np.repeat(np.arange(len(many)), many) * n_words + segment.places[spread_out(begin, many)]
    start_of = np.cumsum(many) - many
    need = np.where(tests.lengths == window, near, tests.lengths)
    starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(window - near + 1):  # the candidates: shifted lists of the rarest terms
        own = np.flatnonzero(k < tests.lengths - need + 1)
        off = order[own, k]
        term = tests.words[own, off]
        n = many[term]
        at = keys[spread_out(start_of[term], n)] - np.repeat(term, n) * n_words if len(keys) else np.zeros(0, np.int64)
        starts.append(at - np.repeat(off, n))
        windows.append(np.repeat(own, n))
    start, w = np.concatenate(starts), np.concatenate(windows)
    ok = (start >= 0) & (start + tests.lengths[w] <= n_words)
    start, w = start[ok], w[ok]
    doc = np.repeat(np.arange(len(counts)), counts)
    ok = doc[start] == doc[start + tests.lengths[w] - 1]
    both = C.uniq((w[ok] * n_words + start[ok]).astype(C.U64)).astype(np.int64)
    w, start = both // max(n_words, 1), both % max(n_words, 1)
    missed = np.zeros(len(w), np.int64)
    for k in range(window):  # intersect the lists, the rarest first
        live = k < tests.lengths[w]
        off = order[w, k]
        key = tests.words[w, off] * n_words + start + off
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        missed += live & (keys[at] != key)
        stay = missed <= tests.lengths[w] - need[w]
        start, w, missed = start[stay], w[stay], missed[stay]
    return start, w, missed == 0


def _hits(index: DataFrame, tests: Tests, near: int) -> DataFrame:
    """A row for each document that has a match, exact or not: its hit words as bits, its items and proximity matches."""
    f = np.append(frequencies(index, tests), np.iinfo(np.int64).max)  # past a short window: last
    order = np.argsort(f[tests.words], axis=1, kind="stable")

    def judge(batches):
        for b in batches:
            for x in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):  # a segment at a time
                counts = np.array(x["lengths"], np.int64)
                start, w, exact = matches(Segment(x["terms"], x["ends"], x["places"]), counts, tests, order, near)
                if not len(start):
                    continue
                n = int(counts.sum())
                doc = np.repeat(np.arange(len(counts)), counts)
                s, t = start[exact], w[exact]
                hit = np.cumsum(np.bincount(s, minlength=n + 1) - np.bincount(s + tests.lengths[t], minlength=n + 1))[:-1] > 0
                items: dict[int, set[str]] = {}
                for i, k in np.unique(np.stack([doc[s], tests.items[t]]), axis=1).T.tolist():
                    items.setdefault(i, set()).add(tests.names[k])
                n_near = np.bincount(doc[start[~exact]], minlength=len(counts))
                edges, places = np.r_[0, np.cumsum(counts)], np.unique(doc[start]).tolist()
                rows = [(x["segment"], i, np.packbits(hit[edges[i] : edges[i + 1]]).tobytes(), sorted(items.get(i, ())), int(n_near[i])) for i in places]
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), HIT_PA, strict=True)], schema=HIT_PA)

    return index.select("segment", "lengths", "terms", "ends", "places").mapInArrow(C.tidied(judge), HIT)


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, near: int = NEAR, slice_words: int = SLICE_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of every document of the index."""
    hits: DataFrame | None = None
    for tests in slices(benchmark, window, slice_words):
        got = C.materialise(_hits(index, tests, near))
        hits = got if hits is None else hits.unionByName(got)
    every = index.select("segment", F.posexplode(F.arrays_zip("ids", "lengths")).alias("place", "x")).select("segment", "place", F.col("x.ids").alias("doc_id"), F.col("x.lengths").cast("long").alias("n_words"))
    none = F.sha2(F.lit(b""), 256)
    if hits is None:
        hits = index.sparkSession.createDataFrame([], HIT)

    def unite(t: pa.Table) -> pa.Table:  # of one document, a row a slice at most
        bits, items = np.frombuffer(t["bits"][0].as_py(), np.uint8).copy(), set()
        for b, own in zip(t["bits"].to_pylist(), t["items"].to_pylist(), strict=True):
            bits |= np.frombuffer(b, np.uint8)
            items |= set(own)
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        row = {"segment": t["segment"][0].as_py(), "place": t["place"][0].as_py(), "n_hit": int(np.unpackbits(bits).sum()), "n_items": len(items), "items_sha256": digest, "n_near": sum(t["n_near"].to_pylist())}
        return pa.Table.from_pylist([row], schema=pa.schema([("segment", pa.int64()), ("place", pa.int32()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("n_near", pa.int64())]))

    found = hits.groupBy("segment", "place").applyInArrow(unite, "segment long, place int, n_hit long, n_items long, items_sha256 string, n_near long")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = every.join(found, ["segment", "place"], "left")
    bad = (n(F.col("n_hit")) > 0) & (share * n(F.col("n_hit")) >= F.col("n_words"))
    return out.select("doc_id", "n_words", *(n(F.col(c)).alias(c) for c in ("n_hit", "n_items")), F.coalesce("items_sha256", none).alias("items_sha256"), bad.alias("contaminated"), n(F.col("n_near")).alias("n_near"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, near: int = NEAR, slice_words: int = SLICE_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of every document."""
    return search(build(docs), benchmark, window, share, near, slice_words)


def brute_force(docs: dict, items: dict, window: int = WINDOW, share: int = SHARE, near: int = NEAR) -> dict:
    """The contract, said plainly, and the proximity matches, for tests."""
    import re

    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    out, tests = {}, {k: words(v) for k, v in items.items()}
    for d, text in docs.items():
        w = words(text)
        hit, found, n_near = [False] * len(w), set(), 0
        for k, t in tests.items():
            for n in {min(window, len(t))} - {0}:
                for win in {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}:
                    for i in range(len(w) - n + 1):
                        same = sum(a == b for a, b in zip(w[i : i + n], win, strict=True))
                        if same == n:
                            found.add(str(k))
                            hit[i : i + n] = [True] * n
                        n_near += n == window and near <= same < n
        out[d] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and share * sum(hit) >= len(w), n_near)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
t AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM t),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN ns ON len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM g JOIN t USING (n, k)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1),
u AS (SELECT row_number() OVER () AS win, string_split(k, ' ') AS ws FROM (SELECT DISTINCT item_id, k FROM t WHERE n = 13)),
uw AS (SELECT win, o, ws[o] AS x FROM (SELECT win, ws, unnest(range(1, 14)) AS o FROM u)),
dw AS (SELECT doc_id, p, w[p] AS x, len(w) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
al AS (SELECT doc_id, win, p - o AS s, count(*) AS same FROM dw JOIN uw USING (x) WHERE p - o >= 0 AND p - o + 13 <= n GROUP BY 1, 2, 3),
nr AS (SELECT doc_id, count(*) AS n_near FROM al WHERE same BETWEEN 10 AND 12 GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN nr ON nr.doc_id = d.doc_id
"""
