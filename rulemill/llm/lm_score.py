"""Language-model scoring with a weighted backoff automaton.

Model: n-grams of up to ``order`` tokens over lower-cased words and one end token per document,
learned from the training documents.  States are contexts; a kept n-gram (seen at least twice) is an
arc with weight max(c - D, 0) / c(context), and a failure arc leads to the shorter context with the
weight that is left, 1 - sum over arcs of (c - D) / c(context).  The last state has an arc for every
known token, (1 - u) c / N, and one for an unknown token, u = (n1 + 0.5) / (N + 1) with n1 tokens seen
once (Good-Turing), so the probabilities over known tokens and "unknown" sum to one in every state.
A document is read from left to right in one traversal: the state is the context just read; a token follows its arc,
or failure arcs until there is one, and the log10 weights met add up (``Automaton``).  An arc's weight includes the
failure arc's share of the next lower one, so the model is interpolated absolute discounting.

The automaton grows with the corpus, so no task holds all of it.  Blocks of documents (common.py) count
their n-grams; shards of the n-gram space add the counts and answer each block with the part of the
automaton that its own texts can reach:

1. a sketch tells which n-grams of two or more tokens can be kept at all;
2. shards add the counts of all words, and of the n-grams that the sketch left;
3. shards add up, for each context, the weight of its arcs;
4. each block traverses its documents.

Defined results: null or empty text is the end token alone; a null doc_id counts as training; rows with
equal ids are separate documents; with no training documents N is 0 and every token is unknown, the
base probability of which is then 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

ORDER, DISCOUNT, ADD = 2, 0.75, 0.1
BLOCK_BYTES = 16 << 20  # n-grams repeat within a block, so larger ones send less; this is what two workers' memory allows
END = C.U64(0x5851F42D4C957F2D)
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_arcs long"
HEAD = np.dtype([("n", "<i8"), ("v", "<i8"), ("n1", "<i8"), ("docs", "<i8")])


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def tokens(text) -> tuple[np.ndarray, np.ndarray]:
    """Token fingerprints of all texts, each text's end token included, and the tokens of each."""
    h, words = C.word_hashes(text, lower=True)
    counts = words + 1
    out = np.full(int(counts.sum()), END, C.U64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts) - 1] = False
    out[inner] = h
    return out, counts


def grams(tok: np.ndarray, counts: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each token the fingerprint of the n-gram that ends there (n = 1 ... order) and of its context (n = 2 ...)."""
    first = np.cumsum(counts) - counts
    g, ctx = [tok], []
    for n in range(2, order + 1):
        c = np.empty_like(tok)
        c[1:] = g[-1][:-1]
        c[first] = C.U64(n)  # the state at a document's start
        ctx.append(C.mix(c ^ C.U64(0x2545F4914F6CDD1D * n & (1 << 64) - 1)))
        g.append(C.mix(ctx[-1] * C.U64(C.BASE) + tok))
    return g, ctx


def pack_counts(x: np.ndarray) -> bytes:
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype(np.uint32).tobytes()


def unpack_counts(raw: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    x = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    big = np.flatnonzero(x == 255)
    x[big] = np.frombuffer(raw, np.uint32, len(big), at + n)
    return x, at + n + 4 * len(big)


def distinct(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the summed weight of each, and which of them each key is."""
    u, which = C.ranked(keys)
    return u, np.bincount(which, weight, len(u)).astype(np.int64), which


class Automaton:
    """States 0 (no context), 1, ...; arcs by (state, token), each with log weight, target and order; failure arcs.

    State 0 has an arc for every token; any other state without one for a token fails over, at a weight, to
    the state of the shorter context.
    """

    FEW = 12  # texts that are read one by one once no more are left

    def __init__(self, n_tokens: int, root: np.ndarray, root_to: np.ndarray, fail_weight: np.ndarray, fail: np.ndarray, keys: np.ndarray, weight: np.ndarray, to: np.ndarray, level: np.ndarray):
        order = np.argsort(keys)
        self.n, self.root, self.root_to, self.fail_weight, self.fail = n_tokens, root, root_to, fail_weight, fail
        self.keys, self.weight, self.to, self.level = np.r_[keys[order], np.iinfo(np.int64).max], weight[order], to[order], level[order]

    def traverse(self, tokens: np.ndarray, counts: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text and the orders above one that its arcs had, in one pass from left to right.

        All texts are read side by side, one token a step, each with its own state.
        """
        first = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        at, ends = first[order], counts[order]
        state, score, used = begin[order], np.zeros(len(counts)), np.zeros(len(counts), np.int64)
        live = np.searchsorted(-ends, -np.arange(int(ends.max(initial=0)) + 1), "left")  # texts longer than each step
        step = 0
        while step < len(live) and live[step] > self.FEW:
            n = live[step]
            self._read(tokens[at[:n] + step], state[:n], score[:n], used[:n])
            step += 1
        for i in range(live[step] if step < len(live) else 0):
            state[i], score[i], used[i] = self._rest(tokens[at[i] + step : at[i] + ends[i]], int(state[i]), float(score[i]), int(used[i]))
        out, arcs = np.empty(len(counts)), np.empty(len(counts), np.int64)
        out[order], arcs[order] = score, used
        return out, arcs

    def _read(self, token: np.ndarray, state: np.ndarray, score: np.ndarray, used: np.ndarray) -> None:
        todo = np.arange(len(token))
        while len(todo):
            s, t = state[todo], token[todo]
            key = s * self.n + t
            k = np.searchsorted(self.keys, key)
            hit = (self.keys[k] == key) & (s > 0)
            arc, own = k[hit], todo[hit]
            score[own] += self.weight[arc]
            used[own] += self.level[arc]
            state[own] = self.to[arc]
            end = s == 0
            own, t = todo[end], t[end]
            score[own] += self.root[t]
            state[own] = self.root_to[t]
            miss = ~hit & ~end
            own = todo[miss]
            score[own] += self.fail_weight[s[miss]]
            state[own] = self.fail[s[miss]]
            todo = own

    def _rest(self, tokens: np.ndarray, state: int, score: float, used: int) -> tuple[int, float, int]:
        keys, weight, to, level = memoryview(self.keys), memoryview(self.weight), memoryview(self.to), memoryview(self.level)
        root, root_to, fail, fail_weight = memoryview(self.root), memoryview(self.root_to), memoryview(self.fail), memoryview(self.fail_weight)
        for t in tokens.tolist():
            while state:
                key = state * self.n + t
                k = bisect_left(keys, key)
                if keys[k] == key:
                    score += weight[k]
                    used += level[k]
                    state = to[k]
                    break
                score += fail_weight[state]
                state = fail[state]
            else:
                score += root[t]
                state = root_to[t]
        return state, score, used


def lm_score(docs: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    n_rows, n_bytes = C.volume(docs)
    n_blocks = C.block_count(n_rows, n_bytes, BLOCK_BYTES)
    blocks = C.hash_blocks(docs, n_blocks)
    sketch = C.Sketch(n_bytes // 6 * (order - 1), 0)
    bits, bits_ctx = C.shard_bits(n_bytes // 2), C.shard_bits(n_bytes // 4)
    WORDS, GRAMS, CTX = 1 << 40, 2 << 40, 3 << 40  # shard numbers of the three rounds

    wide = 2 * (1 << bits) + 1

    def place(shard: int) -> int:
        """A reply's number among those that a block carries on: its sketch flags, the words' shards, the n-grams' shards."""
        return 0 if shard < 0 else 1 + shard - WORDS if shard < GRAMS else 1 + (1 << bits) + shard - GRAMS

    class Block:
        """A block's tokens, n-grams and, as far as replies go, its part of the automaton."""

        def __init__(self, t: pa.Table):
            self.id = C.block_id(t)
            self.ids = t["doc_id"].to_pylist()
            self.held = np.array([is_held_out(x) for x in self.ids], bool)
            tok, self.counts = tokens(t["text"])
            train = np.repeat(~self.held, self.counts)
            self.per = len(tok)
            g, self.ctx = grams(tok, self.counts, order)
            self.words, self.word_n, self.word_at = distinct(tok, train)
            high = np.zeros(0, C.U64) if order == 1 else g[1] if order == 2 else np.concatenate(g[1:])
            del g, tok  # of the fingerprints only the distinct ones are needed from here on
            self.high, self.high_n, self.high_at = distinct(high, np.tile(train, order - 1))

        def kept(self, replies: dict, sketch_flags: np.ndarray) -> None:
            """Counts over all training documents: of words, and of the n-grams that the sketch left (0 for others)."""
            heads, parts = [], []
            for s, a, b in [(s, *ab) for s, ab in self.cut_all(self.words)]:
                raw = replies[WORDS + s]
                heads.append(np.frombuffer(raw, HEAD, 1)[0])
                parts.append(unpack_counts(raw, b - a, HEAD.itemsize)[0])
            self.n, self.v, self.n1, self.docs = (int(sum(h[k] for h in heads)) for k in HEAD.names)
            self.word_total = np.concatenate(parts)
            self.sent = self.high[sketch_flags]
            total, owner = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for s, a, b in C.split_shards(self.sent, bits):
                x, at = unpack_counts(replies[GRAMS + s], b - a)
                total.append(x)
                owner.append(np.unpackbits(np.frombuffer(replies[GRAMS + s], np.uint8, offset=at), count=b - a).astype(bool))
            self.total = np.zeros(len(self.high), np.int64)
            self.total[sketch_flags] = np.concatenate(total)
            self.owner = np.zeros(len(self.high), bool)
            self.owner[sketch_flags] = np.concatenate(owner)
            self.context()

        def cut_all(self, keys):
            had = {s: (a, b) for s, a, b in C.split_shards(keys, bits)}
            return [(s, had.get(s, (0, 0))) for s in range(1 << bits)]

        def context(self) -> None:
            """Of each context: how often it was read in training; the contexts that can have arcs, and what this block owns of them."""
            per = self.per
            self.seen, first = [], np.cumsum(self.counts) - self.counts
            for k in range(order - 1):  # the context of an n-gram is the (n-1)-gram before it
                shorter = self.word_total[self.word_at] if not k else self.total[self.high_at[(k - 1) * per : k * per]]
                c = np.empty(per, np.int64)
                c[1:] = shorter[:-1]
                c[first] = self.docs
                self.seen.append(c)
            ctx = np.concatenate(self.ctx) if self.ctx else np.zeros(0, C.U64)
            seen = np.concatenate(self.seen) if self.seen else np.zeros(0, np.int64)
            live = np.flatnonzero(seen >= 2)
            self.live, at = C.ranked(ctx[live])
            self.ctx_at = np.full(len(ctx), -1, np.int32)
            self.ctx_at[live] = at
            self.ctx = []
            arcs, where = np.arange(len(self.high)), np.zeros(len(self.high), np.int32)
            where[self.high_at] = np.arange(len(self.high_at), dtype=np.int32)  # one place for each distinct n-gram
            own = self.owner[arcs] & (self.total[arcs] >= 2) & (self.ctx_at[where] >= 0)
            to = self.ctx_at[where[own]]
            self.sum_c = np.bincount(to, self.total[arcs[own]], len(self.live)).astype(np.int64)
            self.n_arcs = np.bincount(to, minlength=len(self.live))

        def automaton(self, held_mass: np.ndarray) -> Automaton:
            """The part of the automaton that this block's texts can reach; held_mass is the weight of a state's arcs times c(context)."""
            per, states = self.per, len(self.live) + 1
            unk = (self.n1 + 0.5) / (self.n + 1) if self.n else 1.0
            p1 = np.where(self.word_total > 0, (1 - unk) * self.word_total / max(self.n, 1), unk)
            seen, fail = np.ones(states), np.zeros(states, np.int64)
            for k in range(order - 1):
                at = self.ctx_at[k * per : (k + 1) * per]
                ok = at >= 0
                seen[1 + at[ok]] = self.seen[k][ok]
                if k:
                    fail[1 + at[ok]] = 1 + self.ctx_at[(k - 1) * per : k * per][ok]
            left = np.ones(states)
            left[1:] = 1 - held_mass / seen[1:]
            reached = []  # the state after each token, if the arc that reads it is of order k + 1
            nxt = np.zeros(per, np.int64)
            for k in range(order):
                if k < order - 1:
                    at = np.r_[self.ctx_at[k * per + 1 : (k + 1) * per], np.int32(-1)].astype(np.int64)
                    nxt = np.where(at >= 0, 1 + at, nxt)
                reached.append(nxt)
            root_to = np.zeros(len(self.words), np.int64)
            root_to[self.word_at] = reached[0]
            weight, keys, values, to, level = np.zeros(len(self.high)), [], [], [], []
            where = np.zeros(len(self.high), np.int64)
            where[self.high_at] = np.arange(len(self.high_at))  # one place for each distinct n-gram
            kept = np.flatnonzero((self.total >= 2) & (self.ctx_at[where] >= 0)) if len(where) else where
            for k in range(order - 1):
                own = kept[where[kept] // per == k]
                i, state = where[own] - k * per, 1 + self.ctx_at[where[own]].astype(np.int64)
                # a kept n-gram's last tokens are a kept n-gram too, so the next lower arc is there
                lower = p1[self.word_at[i]] if not k else weight[self.high_at[(k - 1) * per + i]]
                weight[own] = (self.total[own] - discount) / seen[state] + left[state] * lower
                keys.append(state * len(self.words) + self.word_at[i])
                values.append(weight[own])
                to.append(reached[k + 1][i])
                level.append(np.full(len(own), k + 1))
            join = lambda x, t: np.concatenate([np.zeros(0, t), *x])
            return Automaton(len(self.words), np.log10(p1), root_to, np.log10(left), fail, join(keys, np.int64), np.log10(join(values, float)), join(to, np.int64), join(level, np.int64))

        def begin(self) -> np.ndarray:
            """The state of each text before its first token: the longest live context of a document's start."""
            first, out = np.cumsum(self.counts) - self.counts, np.zeros(len(self.counts), np.int64)
            for k in range(order - 1):
                at = self.ctx_at[k * self.per + first].astype(np.int64)
                out = np.where(at >= 0, 1 + at, out)
            return out

        def pack_words(self):
            out = []
            for s, (a, b) in self.cut_all(self.words):
                head = np.array([(b - a, 0, 0, int((~self.held).sum()))], HEAD).tobytes()
                out.append((self.id, WORDS + s, head + self.words[a:b].tobytes() + pack_counts(self.word_n[a:b])))
            return out

    def first(t: pa.Table) -> pa.Table:
        b = Block(t)
        return C.packets(sketch.pack(b.id, b.high, np.flatnonzero(b.high_n > 1)))

    def second(_key, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return C.packets([])
        b = Block(t)
        flags = sketch.repeated(b.high, replies)
        u, n = b.high[flags], b.high_n[flags]
        out = b.pack_words() + [(b.id, GRAMS + s, np.int64(y - x).tobytes() + u[x:y].tobytes() + pack_counts(n[x:y])) for s, x, y in C.split_shards(u, bits)]
        return C.packets([*out, (b.id, C.carried(b.id, 0, 1), np.packbits(flags).tobytes())])

    def add(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        if shard < 0:
            return t.select(["block", "shard", "payload"])
        words = shard < GRAMS
        keys, counts, docs_ = [], [], 0
        for x in t["payload"]:
            raw = x.as_py()
            n, at = int(np.frombuffer(raw, np.int64, 1)[0]), HEAD.itemsize if words else 8
            docs_ += int(np.frombuffer(raw, HEAD, 1)["docs"][0]) if words else 0
            keys.append(np.frombuffer(raw, C.U64, n, at))
            counts.append(unpack_counts(raw, n, at + 8 * n)[0])
        blocks_ = t["block"].to_numpy()
        u, total, which = distinct(np.concatenate(keys), np.concatenate(counts))
        head = np.array([(total.sum(), (total > 0).sum(), (total == 1).sum(), docs_ if shard == WORDS else 0)], HEAD).tobytes() if words else b""
        owner = np.full(len(u), np.iinfo(np.int64).max)
        if not words:
            np.minimum.at(owner, which, np.repeat(blocks_, [len(k) for k in keys]))
        out, at = [], 0
        for b, k in zip(blocks_, keys, strict=True):
            w = which[at : at + len(k)]
            at += len(k)
            out.append((int(b), shard, head + pack_counts(total[w]) + (b"" if words else np.packbits(owner[w] == b).tobytes())))
        return C.packets(out)

    def third(_key, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return C.packets([])
        b, got = Block(t), dict(C.by_shard(replies))
        b.kept(got, np.unpackbits(np.frombuffer(got[C.carried(b.id, 0, 1)], np.uint8), count=len(b.high)).astype(bool))
        out = [(b.id, CTX + s, np.int64(y - x).tobytes() + b.live[x:y].tobytes() + pack_counts(b.sum_c[x:y]) + pack_counts(b.n_arcs[x:y])) for s, x, y in C.split_shards(b.live, bits_ctx)]
        out += [(b.id, C.carried(b.id, place(s), wide), v) for s, v in got.items()]  # carried on for the traversal
        return C.packets(out)

    def sums(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        if shard < 0:
            return t.select(["block", "shard", "payload"])
        keys, cs, arcs = [], [], []
        for x in t["payload"]:
            raw = x.as_py()
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            keys.append(np.frombuffer(raw, C.U64, n, 8))
            c, at = unpack_counts(raw, n, 8 + 8 * n)
            cs.append(c)
            arcs.append(unpack_counts(raw, n, at)[0])
        every = np.concatenate(keys)
        u, c, which = distinct(every, np.concatenate(cs))
        a = np.bincount(which, np.concatenate(arcs), len(u)).astype(np.int64)
        out, at = [], 0
        for b, k in zip(t["block"].to_numpy(), keys, strict=True):
            w = which[at : at + len(k)]
            at += len(k)
            out.append((int(b), shard, pack_counts(c[w]) + pack_counts(a[w])))
        return C.packets(out)

    def last(_key, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({f: [] for f in RESULT_NAMES}, schema=RESULT_PA)
        b, got = Block(t), dict(C.by_shard(replies))
        at_ = {-1 - s - b.id * wide: v for s, v in got.items() if s < 0}
        carried = {(WORDS - 1 + i if i <= 1 << bits else GRAMS - 1 - (1 << bits) + i): v for i, v in at_.items() if i}
        b.kept(carried, np.unpackbits(np.frombuffer(at_[0], np.uint8), count=len(b.high)).astype(bool))
        cs, arcs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, x, y in C.split_shards(b.live, bits_ctx):
            c, at = unpack_counts(got[CTX + s], y - x)
            cs.append(c)
            arcs.append(unpack_counts(got[CTX + s], y - x, at)[0])
        machine = b.automaton(np.concatenate(cs) - discount * np.concatenate(arcs))
        score, used = machine.traverse(b.word_at, b.counts, b.begin())
        first_ = np.cumsum(b.counts) - b.counts
        c1 = b.word_total[b.word_at]
        base = np.add.reduceat(np.log10((c1 + ADD) / (b.n + ADD * (b.v + 1))), first_)
        known = np.add.reduceat((c1 > 0).astype(np.int64), first_)
        return pa.table([b.ids, b.held, b.counts, known, np.full(len(b.ids), b.n), base, score, used], schema=RESULT_PA)

    one = C.regroup(C.regroup(blocks, "block", first, C.PACKET), "shard", C.sketch_merge, C.PACKET, n_blocks)
    two = C.regroup(C.cogroup(blocks, one, second, C.PACKET, n_blocks), "shard", add, C.PACKET, n_blocks)
    three = C.regroup(C.cogroup(blocks, two, third, C.PACKET, n_blocks), "shard", sums, C.PACKET, n_blocks)
    return C.cogroup(blocks, three, last, RESULT, n_blocks)


RESULT_PA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_arcs", pa.int64())])
RESULT_NAMES = RESULT_PA.names


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(C.table(spark, sf_dir, "documents"))
