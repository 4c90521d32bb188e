"""Toxicity by a misspelling-tolerant lexicon and the context of its hits.

1. The lexicon comes from the labelled sample (labelled.py): terms and stems (beginnings of words) that
   occur in toxic documents and, but for at most one in ``odds``, nowhere else.  Terms that may be misspelled
   are kept beside stems that they begin with.  It is a trie.  A term needs more than three letters (stars of stems included),
   and a weight of toxic documents of at least MIN_DOCS and of SHARE of all that the sample has: rarer terms are left out.
2. A Levenshtein automaton of each word is intersected with the trie: the automaton's state is the row of edit
   distances to the path so far, and branches whose row exceeds the bound are cut.  A term may have one edit from FUZZY
   letters on, a stem from FUZZY_STEM (shorter ones are too near to other words); two letters that changed
   places are one edit.  Words may have any length.  Words that share no half with any
   term, nor its beginning with the middle two letters in each other's place, cannot be within one edit of it and are not walked.
3. Each hit gets a context score: a window of words around it tells quotation (quotation marks on both sides,
   words of reporting) from abuse.  Counts of plain, misspelled and quoted hits, alone and per word, go in a
   logistic regression fitted on the sample.

Defined results: null or empty text has no hits; rows with equal ids are scored each; without labels of both
kinds the score is the share of label 1 (0 without any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from . import labelled as L

THRESHOLD, STEM, MIN_DOCS, SHARE, ODDS, SIGNS, CONTEXT = 0.5, (4, 5, 6, 7), 4, 0.004, 40, 4, 6
FUZZY, FUZZY_STEM = 5, 6  # letters from which on a term, or a stem, may be misspelled
REPORTING = tuple(w.encode() for w in ("said", "says", "quote", "quoted", "wrote", "called", "dijo", "dit", "sagte"))
QUOTES = '"“”«»„'
RESULT = "doc_id long, held_out boolean, score double, predicted int, n_hits long, n_quoted long"
RESULT_PA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_hits", pa.int64()), ("n_quoted", pa.int64())])


def learn_lexicon(rows: DataFrame, share: float = SHARE) -> list[str]:
    """Terms, and stems as "beginning*", that mark toxic documents of (text, label).

    Near copies count together about as one, lest all words of a much copied document look like marks: a document weighs
    one over the number of documents of its label that are like it.  Those share its least-hashed pairs of
    neighbouring words, under most of SIGNS hashes; the second least of the SIGNS numbers is taken, so neither texts that
    share only one frequent pair lose weight, nor do copies gain it by one changed word.  No document is dropped, and no
    term but by its own counts: a term takes MIN_DOCS documents or more, which bounds their number by the sample's words.
    """
    words = F.split(F.lower(C.text_column()), r"\s+")
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))
    pairs = F.when(F.size(words) > 1, pairs).otherwise(F.transform(words, lambda w: F.xxhash64(w)))
    signs = rows.select("doc_id", "label", pairs.alias("p"))
    signs = signs.select("doc_id", "label", *[F.array_min(F.transform("p", lambda h, k=k: F.xxhash64(h, F.lit(k)))).alias(f"s{k}") for k in range(SIGNS)])
    alike = [F.count(F.lit(1)).over(W.partitionBy("label", f"s{k}")) for k in range(SIGNS)]
    weights = signs.select("doc_id", (1 / F.sort_array(F.array(*alike))[1]).alias("weight"))  # a row an id, of a bounded sample
    rows = rows.join(F.broadcast(weights), "doc_id")

    def count(batches):
        seen: dict[bytes, list[float]] = {}
        docs = [0.0, 0.0]
        for b in batches:
            data, off = C.text_bytes(b["text"])
            low = C.LOWER[data]
            for i, (y, weight) in enumerate(zip(b["label"].to_pylist(), b["weight"].to_pylist(), strict=True)):
                a = low[off[i] : off[i + 1]]
                s, e, _ = C.word_spans(a, np.array([0, len(a)]), C.NOT_ALNUM)
                raw = a.tobytes()
                words = {raw[x:z] for x, z in zip(s.tolist(), e.tolist(), strict=True)}
                docs[y] += weight
                for w in words | {w[:k] + b"*" for w in words for k in STEM if len(w) >= k and (k == len(w) or w[k] & 0xC0 != 0x80)}:
                    seen.setdefault(w, [0.0, 0.0])[y] += weight
        seen[b" docs"] = docs
        yield pa.RecordBatch.from_arrays([pa.array([k.decode("utf-8", "replace") for k in seen]), pa.array([v[1] for v in seen.values()]), pa.array([v[0] for v in seen.values()])], names=["term", "bad", "good"])

    got = rows.select("text", "label", "weight").mapInArrow(count, "term string, bad double, good double").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = got.filter(F.col("term") == " docs").first()
    if not total or not total["bad"]:
        return []
    few = max(MIN_DOCS, share * total["bad"])
    slack = 1e-9 * few  # weights are added in any order
    best = got.filter((F.col("term") != " docs") & (F.col("bad") >= few - slack) & (F.col("good") * ODDS <= F.col("bad") + slack) & (F.length("term") > 3))
    found = {r["term"] for r in best.select("term").collect()}
    stems = {t for t in found if t.endswith("*") and not any(t[:k] + "*" in found for k in range(1, len(t) - 1))}
    return sorted(stems | {t for t in found if not t.endswith("*") and (len(t) >= FUZZY or not any(t[:k] + "*" in stems for k in range(1, len(t) + 1)))})


class Trie:
    """Terms by letter; a node of a stem accepts whatever follows."""

    def __init__(self, lexicon: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.end: list[int] = [0]  # 1: a term ends here, 2: a stem does
        self.length: list[int] = [0]
        for t in lexicon:
            node = 0
            for c in t.rstrip("*"):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.end.append(0)
                    self.length.append(self.length[node] + 1)
                node = self.next[node][c]
            self.end[node] |= 2 if t.endswith("*") else 1

    def match(self, word: str, edits: int = 1, swaps: bool = False) -> int:
        """0, or 1 + the least edits (up to the bound) between the word, or its beginning for a stem, and the lexicon.

        With ``swaps``, two neighbouring letters in each other's place are one edit instead of two.
        """
        best = edits + 1
        todo = [(0, tuple(range(len(word) + 1)), "", ())]
        while todo:
            node, row, last, before = todo.pop()
            if self.end[node] & 1 and row[-1] <= min(edits, self.length[node] // FUZZY):
                best = min(best, row[-1])
            if self.end[node] & 2 and min(row) <= min(edits, self.length[node] // FUZZY_STEM):
                best = min(best, min(row))
            for c, child in self.next[node].items():
                new = [row[0] + 1]
                for k, w in enumerate(word):
                    new.append(min(new[k] + 1, row[k + 1] + 1, row[k] + (w != c)))
                    if swaps and k and w == last and word[k - 1] == c and before:
                        new[-1] = min(new[-1], before[k - 1] + 1)
                if min(new) < best and min(new) <= edits:
                    todo.append((child, tuple(new), c, row))
        return best + 1 if best <= edits else 0


def swapped(term: str, k: int) -> list[bytes]:
    """Beginnings of the term up to two neighbouring letters that changed places and lie on both sides of byte k."""
    ends = [len(term[:i].encode()) for i in range(len(term) + 1)]
    return [(term[:i] + term[i + 1] + term[i]).encode() for i in range(len(term) - 1) if ends[i] < k < ends[i + 2]]


class Matcher:
    """Words to hits: only words that share a half with a term are walked; answers are kept for words met again."""

    def __init__(self, lexicon: list[str]):
        self.trie, self.known = Trie(lexicon), {}
        self.longest = max(self.trie.length) + 2  # letters beyond these change no answer
        halves = set()
        for t in lexicon:
            b = t.rstrip("*").encode()
            k = len(b) // 2
            if len(t.rstrip("*")) < (FUZZY_STEM if t.endswith("*") else FUZZY):
                halves.add((b, 0))  # without edits a word begins with all of it
            else:
                halves.add((b[:k], 0))
                halves |= {(x, 0) for x in swapped(t.rstrip("*"), k)}
                halves |= {(b[k:], at) for at in (k - 1, k, k + 1)} | {(b[k:], at) for at in (k - 2, k + 2) if len(b) != len(t.rstrip("*"))}
        self.looks = {}
        for h, at in halves:
            self.looks.setdefault((len(h), at), []).append(np.frombuffer(h, np.uint8))
        one = np.zeros(0, C.U64)
        for key, hs in self.looks.items():
            one = np.array([C.span_hash(C.rolling(h), np.array([0]), np.array([len(h)]))[0] for h in hs], C.U64)
            self.looks[key] = C.uniq(one)

    def hits(self, a: np.ndarray, p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """For each word 0 (none), 1 (a term as it is) or 2 (misspelled)."""
        maybe = np.zeros(len(s), bool)
        for (n, at), hs in self.looks.items():
            fits = np.flatnonzero(e - s >= at + n)
            h = C.span_hash(p, s[fits] + at, s[fits] + at + n)
            k = np.minimum(np.searchsorted(hs, h), len(hs) - 1)
            maybe[fits[hs[k] == h]] = True
        out, raw = np.zeros(len(s), np.int8), a.tobytes()
        for i in np.flatnonzero(maybe).tolist():
            w = raw[s[i] : min(e[i], s[i] + 4 * self.longest)]
            got = self.known.get(w)
            if got is None:
                got = self.trie.match(w.decode("utf-8", "replace")[: self.longest], swaps=True)
                if len(self.known) < 200_000:
                    self.known[w] = got
            out[i] = got
        return out


@lru_cache(maxsize=1)
def matcher_of(lexicon: tuple[str, ...]) -> Matcher:
    """The matcher of a lexicon; one worker's tasks share it and the answers that it keeps."""
    return Matcher(list(lexicon))


def features(text, matcher: Matcher) -> np.ndarray:
    """For each text: log counts and shares of plain, misspelled and quoted hits; then the counts themselves."""
    data, off = C.text_bytes(text)
    marks = [np.frombuffer(q.encode(), np.uint8) for q in QUOTES]
    rows = [np.zeros((0, 8))]
    for i, j in C.pieces(off):
        raw = data[off[i] : off[j]]
        a, o = C.LOWER[raw], off[i : j + 1] - off[i]
        s, e, counts = C.word_spans(a, o, C.NOT_ALNUM)
        doc = np.repeat(np.arange(len(counts)), counts)
        got = matcher.hits(a, C.rolling(a), s, e) if len(s) else np.zeros(0, np.int8)
        at = np.flatnonzero(got)
        quoted = np.zeros(len(at), bool)
        for k, w in enumerate(at.tolist()):  # hits only
            lo, hi = np.searchsorted(doc, doc[w]), np.searchsorted(doc, doc[w], "right") - 1
            x, y = max(lo, w - CONTEXT), min(hi, w + CONTEXT)
            before, after = raw[s[x] : s[w]].tobytes(), raw[e[w] : e[y]].tobytes()
            both = any(q.tobytes() in before for q in marks) and any(q.tobytes() in after for q in marks)
            quoted[k] = both or any(t in a[s[x] : e[y]].tobytes().split() for t in REPORTING)
        d, n = doc[at], len(counts)
        plain = np.bincount(d[(got[at] == 1) & ~quoted], minlength=n)
        fuzzy = np.bincount(d[(got[at] == 2) & ~quoted], minlength=n)
        quote = np.bincount(d[quoted], minlength=n)
        words = np.maximum(counts, 1)
        rows.append(np.stack([np.log1p(plain), np.log1p(fuzzy), np.log1p(quote), plain / words * 20, fuzzy / words * 20, quote / words * 20, plain + fuzzy + quote, quote], 1))
    return np.concatenate(rows)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Weights (the last one the constant) by Newton's method with a small penalty."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = L.sigmoid(z @ w)
        g = z.T @ (p - y) + penalty * w
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        w -= np.clip(np.linalg.solve(h, g), -4, 4)
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = L.SAMPLE_ROWS):
    sample = C.materialise(L.with_labels(docs, L.training_labels(labels, "toxic", rows)))
    lexicon = learn_lexicon(sample)

    def measure(batches):
        matcher = matcher_of(tuple(lexicon))
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in features(b["text"], matcher)], pa.binary()), b["label"]], names=["x", "label"])

    got = sample.mapInArrow(measure, "x binary, label int").collect()  # at most `rows` rows
    x = np.array([np.frombuffer(r["x"]) for r in got]).reshape(-1, 8)[:, :6]
    y = np.array([r["label"] for r in got], float)
    w = logistic(x, y) if len(set(y)) == 2 else np.r_[np.zeros(6), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)) if len(y) else -20.0]
    return lexicon, w


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    lexicon, w = fit(docs, labels)

    def run(batches):
        matcher = matcher_of(tuple(lexicon))
        for b in batches:
            x = features(b["text"], matcher)
            p = L.sigmoid(x[:, :6] @ w[:6] + w[6])
            held = [L.is_held_out(i) for i in b["doc_id"].to_pylist()]
            cols = [b["doc_id"].cast(pa.int64()), held, p, (p >= threshold).astype(np.int32), x[:, 6].astype(np.int64), x[:, 7].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, RESULT_PA, strict=True)], schema=RESULT_PA)

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
