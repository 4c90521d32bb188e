"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

1. Random indexing over *all* documents: each of 2**``bits`` hashed words has a fixed sparse ternary index
   vector; a word's vector is the sum of the index vectors of its neighbours (two to each side).  Words are
   seen in two forms, as written and as a shape (case, digits, marks, length class), so that rare words share
   what their form tells.  The table has a fixed size, whatever the corpus; tasks add up their parts.
2. A document is the mean of its words' unit vectors in both forms, with a few pooled figures of the text.
3. A two-layer numpy network is fitted on the labelled sample (labelled.py), a part of which is kept back to
   stop in time and to calibrate the probabilities by a temperature.

Defined results: null or empty text has zero vectors and is scored like any other; rows with equal ids are
scored each; without labels of both kinds the score is the share of label 1 (0.5 without any); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import labelled as L

BITS, DIM, SPARSE, REACH, HIDDEN, THRESHOLD, SLICES = 14, 32, 4, 2, 32, 0.3, 32
FLUSH_WORDS = 500_000  # held before a pass over the table, which costs as much as some hundred thousand words
RESULT = "doc_id long, held_out boolean, score double, predicted int"
RESULT_PA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
#: Classes of bytes for a word's shape: lower, upper, digit, more than ASCII, and each mark its own.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[0x61:0x7B], SHAPE[0x41:0x5B], SHAPE[0x30:0x3A], SHAPE[0x80:] = 1, 2, 3, 1


def index_vectors(bits: int = BITS, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero parts of each hashed word's index vector."""
    rng = np.random.default_rng(11)
    return rng.integers(0, dim, (1 << bits, SPARSE)), rng.choice([-1.0, 1.0], (1 << bits, SPARSE))


def forms(a: np.ndarray, off: np.ndarray, bits: int = BITS):
    """Hashed words and hashed shapes of some texts, the words of each, and the words' spans."""
    s, e, counts = C.word_spans(a, off)
    word = C.span_hash(C.rolling(a), s, e)
    kind = SHAPE[a]
    turn = np.ones(len(a), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[s] = True
    # a shape is the sequence of classes without repeats, and the length in classes of 4 bytes
    steps = kind[turn]
    at = np.cumsum(turn)
    first, last = at[s] - 1, at[e - 1]
    shape = C.mix(C.span_hash(C.rolling(steps), first, last) + np.minimum((e - s) // 4, 6).astype(C.U64))
    cut = C.U64(64 - bits)
    return (word >> cut).astype(np.int64), (shape >> cut).astype(np.int64), word, counts, s, e


def add_contexts(table: np.ndarray, w: np.ndarray, doc: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    dim = table.shape[1]
    flat = table.reshape(-1)
    for o in range(1, REACH + 1):
        ok = doc[o:] == doc[:-o]
        x, y = w[:-o][ok], w[o:][ok]
        for a, b in ((x, y), (y, x)):
            for k in range(SPARSE):
                flat += np.bincount(a * dim + places[b, k], signs[b, k], len(flat))


def word_vectors(docs: DataFrame, bits: int = BITS, dim: int = DIM) -> np.ndarray:
    """Unit vectors of the hashed words and shapes, as (2, 2**bits, dim), from all documents."""
    places, signs = index_vectors(bits, dim)

    def part(batches):
        tables, seen = np.zeros((2, 1 << bits, dim)), False
        buffer: list[list[np.ndarray]] = [[], [], []]

        def flush():
            if buffer[0]:
                w, sh, doc = (np.concatenate(b) for b in buffer)
                add_contexts(tables[0], w, doc, places, signs)
                add_contexts(tables[1], sh, doc, places, signs)
                for b in buffer:
                    b.clear()

        n_docs, held = 0, 0
        for batch in batches:
            data, off = C.text_bytes(batch["text"])
            for i, j in C.pieces(off):
                w, sh, _, counts, _, _ = forms(data[off[i] : off[j]], off[i : j + 1] - off[i], bits)
                for b, x in zip(buffer, (w, sh, np.repeat(np.arange(n_docs, n_docs + len(counts)), counts)), strict=True):
                    b.append(x)
                n_docs, held, seen = n_docs + len(counts), held + len(w), True
                if held > FLUSH_WORDS:
                    flush()
                    held = 0
        flush()
        if seen:
            flat = tables.reshape(SLICES, -1).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"slice": pa.array(np.arange(SLICES, dtype=np.int32)), "part": pa.array([x.tobytes() for x in flat], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(float) for x in t["part"])
        return pa.table({"slice": t["slice"].slice(0, 1), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    got = docs.select("text").mapInArrow(C.tidied(part), "slice int, part binary").groupBy("slice").applyInArrow(add, "slice int, part binary").collect()  # a table of fixed size
    out = np.zeros((SLICES, (2 << bits) * dim // SLICES), np.float32)
    for r in got:
        out[r["slice"]] = np.frombuffer(r["part"], np.float32)
    out = out.reshape(2, 1 << bits, dim)
    norm = np.sqrt((out.astype(float) ** 2).sum(2, keepdims=True))
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def _means(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the rows between the edges, divided by their number."""
    n = np.diff(edges)
    out = np.zeros((len(n), *x.shape[1:]), np.float64)
    full = n > 0
    if full.any():
        out[full] = np.add.reduceat(x, edges[:-1][full], axis=0)
    return out / np.maximum(n, 1).reshape(-1, *[1] * (x.ndim - 1))


def features(text, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: pooled vectors in both forms and pooled figures."""
    data, off = C.text_bytes(text)
    bits, rows = int(vectors.shape[1]).bit_length() - 1, [np.zeros((0, 2 * vectors.shape[2] + 12))]
    for i, j in C.pieces(off):
        a, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        w, sh, word, counts, s, e = forms(a, o, bits)
        edges = np.r_[0, np.cumsum(counts)]
        doc = np.repeat(np.arange(len(counts)), counts)
        kind = SHAPE[a]
        byte = [_means((x).astype(np.float32), o) for x in (kind == 2, kind == 3, (kind > 3) & (a != 32), a == 10)]
        same = np.zeros(len(w), np.float32)
        same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        order = np.lexsort((word, doc))
        new = np.ones(len(w), np.float32)
        new[1:] = (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        length = (e - s).astype(np.float32)
        upper = (kind[s] == 2).astype(np.float32) if len(s) else np.zeros(0, np.float32)
        marked = (kind[np.maximum(e - 1, 0)] > 3).astype(np.float32) if len(e) else np.zeros(0, np.float32)
        n = np.diff(o)
        own = [*byte, _means(same, edges), _means(new, edges), _means(length, edges) / 8, _means(upper, edges), _means(marked, edges), np.log1p(counts) / 8, np.log1p(n) / 10, (n == 0).astype(float)]
        rows.append(np.hstack([_means(vectors[0][w], edges), _means(vectors[1][sh], edges), np.stack(own, 1)]))
    return np.concatenate(rows)


class Network:
    """Two layers: tanh units, then one logit; fitted by Adam on weighted log loss, best epoch of the kept-back part."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60):
        rng = np.random.default_rng(5)
        order = rng.permutation(len(y))
        back, fit = order[: len(y) // 6], order[len(y) // 6 :]
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
        z = (x - self.mean) / self.scale
        p = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.zeros(1)]
        m, v, t, best = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0, (np.inf, [q.copy() for q in p])
        for _ in range(epochs):
            for i in range(0, len(fit), 128):
                k = rng.permutation(fit)[:128] if len(fit) < 128 else fit[i : i + 128]
                h = np.tanh(z[k] @ p[0] + p[1])
                d = (L.sigmoid(h @ p[2] + p[3]) - y[k]) / len(k)
                dh = np.outer(d, p[2]) * (1 - h * h)
                g = [z[k].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
                t += 1
                for q in range(4):
                    m[q] = 0.9 * m[q] + 0.1 * g[q]
                    v[q] = 0.999 * v[q] + 0.001 * g[q] ** 2
                    p[q] -= 0.004 * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)
            rng.shuffle(fit)
            o = np.clip(L.sigmoid(np.tanh(z[back] @ p[0] + p[1]) @ p[2] + p[3]), 1e-9, 1 - 1e-9) if len(back) else np.zeros(0)
            loss = float(-np.mean(y[back] * np.log(o) + (1 - y[back]) * np.log(1 - o))) if len(back) else 0.0
            if loss < best[0]:
                best = (loss, [q.copy() for q in p])
        self.p, self.t = best[1], 1.0
        if len(back):
            self.t = L.temperature(self.logits(x[back]), y[back])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return L.sigmoid(self.logits(x) / self.t)


class Constant:
    def __init__(self, p: float):
        self.p = p

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def fit(docs: DataFrame, labels: DataFrame, rows: int = L.SAMPLE_ROWS):
    """Word vectors of all documents and the model fitted on the labelled sample."""
    vectors = word_vectors(docs)
    width = 2 * DIM + 12

    def measure(batches):
        for b in batches:
            x = features(b["text"], vectors)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b["label"]], names=["x", "label"])

    got = L.with_labels(docs, L.training_labels(labels, "quality", rows)).mapInArrow(C.tidied(measure), "x binary, label int").collect()  # at most `rows` rows
    x = np.array([np.frombuffer(r["x"]) for r in got]).reshape(-1, width)
    y = np.array([r["label"] for r in got], float)
    order = np.lexsort(x.T[::-1]) if len(y) else []
    x, y = x[order], y[order]  # the same model whatever order the rows came in
    return vectors, Network(x, y) if len(set(y)) == 2 else Constant(float(y.mean()) if len(y) else 0.5)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    vectors, model = fit(docs, labels)

    def run(batches):
        for b in batches:
            p = model.scores(features(b["text"], vectors))
            held = [L.is_held_out(i) for i in b["doc_id"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(held, pa.bool_()), pa.array(p), pa.array((p >= threshold).astype(np.int32))], schema=RESULT_PA)

    return docs.select("doc_id", "text").mapInArrow(C.tidied(run), RESULT)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    vectors, model = fit(docs, labels)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.scores(features(b["text"], vectors)) >= threshold))

    return docs.mapInArrow(C.tidied(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
