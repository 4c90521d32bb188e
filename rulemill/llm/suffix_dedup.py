"""Exact repeated byte strings by distributed prefix doubling over sampled positions.

Every byte covered by a ``length``-byte string that also starts anywhere else (same document included,
overlaps count) is removed.  Prefix doubling ranks positions by their first h bytes, then by the pair of
ranks at i and i + h, drops positions once unique and stops past the threshold.  Ranking every byte
position in Spark would move tens of bytes per byte of text, so two things differ from the textbook form:

* ranks are 64-bit fingerprints, which name equal strings equally in every task;
* the first round (h = ``length``/2 + 1) ranks only *anchors*: in each window of ``length`` bytes the
  position whose h-byte string has the least fingerprint.  Two equal windows hold the same anchor at the
  same offset, so a window whose anchor is unique is unique itself, and no repeat is lost.

Rounds, each a sort of rank pairs within a shard of the rank space:

1. blocks send (rank of the anchor, rank of the whole stretch that the anchor's windows span); a shard
   sorts the pairs.  Unique anchors are done; a stretch that is there twice is repeated as a whole;
2. for the rest each window is ranked by the pair of ranks at its start and at start + length/2; a shard
   sorts these and tells which are there twice;
3. blocks remove the covered bytes.

Defined results: null or empty text has no bytes; texts shorter than ``length`` keep all; repeated rows
count as repeats of each other; an empty table gives no rows; other columns are ignored.
Fingerprints of 64 bits: with 10**9 ranks in play the chance of any clash is about 3 %.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

LENGTH = 200
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
KEPT = RESULT + ", kept binary"
AT = C.U64((1 << 28) - 1)
UNIQUE, WHOLE, ASKS, GIVES = 0, 1, 2, 3


@dataclass
class Piece:
    """Some whole texts: rolling hashes p; anchors' ranks; the first and last window start that each anchor owns."""

    base: int
    p: np.ndarray
    gram: np.ndarray
    span: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def _pieces(text, length: int) -> tuple[list[Piece], np.ndarray, np.ndarray]:
    data, off = C.text_bytes(text)
    h = length // 2 + 1
    out = []
    for i, j in C.pieces(off):
        a, n = data[off[i] : off[j]], int(off[j] - off[i])
        if n < length:
            continue
        p, inv = C.rolling(a), C.powers(n + 1, True)
        ranks = C.mix((p[h:] - p[:-h]) * inv[: n - h + 1])
        least = _least((ranks & ~AT) | np.arange(len(ranks), dtype=C.U64), length - h + 1)
        ends = off[i + 1 : j + 1] - off[i]
        inside = np.ones(n - length + 1, bool)
        for e in ends[:-1]:
            inside[max(0, e - length + 1) : e] = False
        s = np.flatnonzero(inside)
        if not len(s):
            continue
        at = (least[s] & AT).astype(np.int64)
        new = np.r_[True, (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)]
        lo = s[new]
        hi = s[np.r_[new[1:], True]]
        at = at[new]
        span = C.mix(C.mix((p[hi + length] - p[lo]) * inv[lo]) + ((at - lo) * 1_000_003 + (hi - lo)).astype(C.U64))
        out.append(Piece(int(off[i]), p, C.mix(ranks[at]), span, lo, hi))  # least ranks are small ones: mixed again, they spread over the shards
    return out, data, off


def _windows(x: Piece, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the windows that the anchors own, from the ranks of their halves, and where each starts in the piece."""
    n = x.hi[which] - x.lo[which] + 1
    s = np.repeat(x.lo[which], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    half, inv = length // 2, C.powers(len(x.p), True)
    left = C.mix((x.p[s + half] - x.p[s]) * inv[s])
    right = C.mix((x.p[s + length] - x.p[s + half]) * inv[s + half])
    return C.mix(left * C.U64(C.BASE) + right), s


def _pairs(gram: np.ndarray, span: np.ndarray):
    """Distinct pairs in order, how many of each (2 for more), and which pair each anchor has."""
    order = np.lexsort((span, gram))
    g, s = gram[order], span[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])] if len(g) else np.zeros(0, bool)
    which = np.empty(len(g), np.int64)
    which[order] = np.cumsum(new) - 1
    return g[new], s[new], np.bincount(which, minlength=int(new.sum())) > 1, which


def _all(parts: list[Piece], name: str, dtype=C.U64) -> np.ndarray:
    return np.concatenate([getattr(x, name) for x in parts]) if parts else np.zeros(0, dtype)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every document."""
    n_rows, n_bytes = C.volume(docs)
    n_blocks = C.block_count(n_rows, n_bytes)
    blocks = C.hash_blocks(docs, n_blocks)
    bits1, bits2 = C.shard_bits(n_bytes * 2 // 5), C.shard_bits(n_bytes)

    def first(t: pa.Table) -> pa.Table:
        parts, _, _ = _pieces(t["text"], length)
        g, s, twice, _ = _pairs(_all(parts, "gram"), _all(parts, "span"))
        b = C.block_id(t)
        return C.packets([(b, k, g[x:y].tobytes() + s[x:y].tobytes() + np.packbits(twice[x:y]).tobytes()) for k, x, y in C.split_shards(g, bits1)])

    def rank(t: pa.Table) -> pa.Table:
        grams, spans, twice, sizes = [], [], [], []
        for x in t["payload"]:
            raw = x.as_py()
            n = len(raw) * 8 // 129
            n += (16 * (n + 1) + (n + 8) // 8) <= len(raw)
            grams.append(np.frombuffer(raw, C.U64, n))
            spans.append(np.frombuffer(raw, C.U64, n, 8 * n))
            twice.append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 * n), count=n))
            sizes.append(n)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        g, s, w = np.concatenate(grams), np.concatenate(spans), np.concatenate(twice).astype(np.int64) + 1
        order = np.lexsort((owner, s, g))
        g, s, w = g[order], s[order], w[order]
        new_g = np.r_[True, g[1:] != g[:-1]]
        new_s = new_g | np.r_[True, s[1:] != s[:-1]]
        in_g, in_s = np.cumsum(new_g) - 1, np.cumsum(new_s) - 1
        copies, kinds = np.bincount(in_s, w)[in_s], np.bincount(in_g[new_s])[in_g]
        code = np.where(copies > 1, np.where((kinds > 1) & new_s, GIVES, WHOLE), np.where(kinds > 1, ASKS, UNIQUE))
        back = np.empty(len(code), np.uint8)
        back[order] = code
        shard, out, at = t["shard"][0].as_py(), [], 0
        for b, n in zip(t["block"].to_numpy(), sizes, strict=True):
            c = back[at : at + n]
            out.append((int(b), shard, np.packbits(np.stack([c >> 1, c & 1], 1)).tobytes()))
            at += n
        return C.packets(out)

    def codes(parts: list[Piece], got: dict) -> np.ndarray:
        g, _, _, which = _pairs(_all(parts, "gram"), _all(parts, "span"))
        flat = [np.unpackbits(np.frombuffer(got[k], np.uint8), count=2 * (y - x)).reshape(-1, 2) for k, x, y in C.split_shards(g, bits1)]
        c = np.concatenate(flat) if flat else np.zeros((0, 2), np.uint8)
        return (c[:, 0] * 2 + c[:, 1])[which], which

    def asked(parts: list[Piece], code: np.ndarray, which: np.ndarray):
        """Ranks of the undecided windows of the block: in order, whether there twice as known so far; those of each piece with their starts."""
        one = np.zeros(len(code), bool)
        if len(which):
            one[np.unique(which, return_index=True)[1]] = True
        given, own, at = [np.zeros(0, C.U64)], [], 0
        for x in parts:
            c, f = code[at : at + len(x.lo)], one[at : at + len(x.lo)]
            own.append(_windows(x, np.flatnonzero(c == ASKS), length))
            given.append(_windows(x, np.flatnonzero((c == GIVES) & f), length)[0])
            at += len(x.lo)
        asks = np.concatenate([np.zeros(0, C.U64), *(w for w, _ in own)])
        gives = np.concatenate(given)
        u, which_ = C.ranked(np.concatenate([asks, gives]))
        twice = np.bincount(which_, minlength=len(u)) > 1
        twice[which_[len(asks) :]] = True
        return u, twice, own, which_

    def second(_key, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return C.packets([])
        b, got = C.block_id(t), dict(C.by_shard(replies))
        parts, _, _ = _pieces(t["text"], length)
        code, which = codes(parts, got)
        u, twice, _, _ = asked(parts, code, which)
        out = [(b, k, u[x:y].tobytes() + np.packbits(twice[x:y]).tobytes()) for k, x, y in C.split_shards(u, bits2)]
        out += [(b, C.carried(b, k, 1 << bits1), v) for k, v in got.items()]  # what the block knows already goes on to the last round
        return C.packets(out)

    def rerank(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        if shard < 0:
            return t.select(["block", "shard", "payload"])
        keys, twice = [], []
        for x in t["payload"]:
            raw = x.as_py()
            n = len(raw) * 8 // 65
            n += (8 * (n + 1) + (n + 8) // 8) <= len(raw)
            keys.append(np.frombuffer(raw, C.U64, n))
            twice.append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 * n), count=n))
        every = np.concatenate(keys)
        every = np.concatenate([every, every[np.concatenate(twice).astype(bool)]])
        every.sort()
        found = C.uniq(every[1:][every[1:] == every[:-1]])
        out = []
        for b, k in zip(t["block"].to_numpy(), keys, strict=True):
            hit = found[np.minimum(np.searchsorted(found, k), len(found) - 1)] == k if len(found) else np.zeros(len(k), bool)
            out.append((int(b), shard, np.packbits(hit).tobytes()))
        return C.packets(out)

    def last(_key, t: pa.Table, replies: pa.Table) -> pa.Table:
        ids, n_bytes_, n_removed, n_spans, digests, kept = [], [], [], [], [], []
        if t.num_rows:
            b, got = C.block_id(t), dict(C.by_shard(replies))
            parts, data, off = _pieces(t["text"], length)
            code, which = codes(parts, {(-1 - s - b * (1 << bits1)): v for s, v in got.items() if s < 0})
            u, _, own, mine = asked(parts, code, which)
            flags = C.unpack_bits(replies, C.split_shards(u, bits2))
            starts, at, m = [np.zeros(0, np.int64)], 0, 0
            for x, (w, s) in zip(parts, own, strict=True):
                c = code[at : at + len(x.lo)]
                whole = np.flatnonzero((c == WHOLE) | (c == GIVES))
                n = x.hi[whole] - x.lo[whole] + 1
                starts.append(x.base + np.repeat(x.lo[whole], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
                starts.append(x.base + s[flags[mine[m : m + len(w)]]])
                at, m = at + len(x.lo), m + len(w)
            gone = C.cover(np.concatenate(starts), length, len(data))
            ids = t["doc_id"].to_pylist()
            for i in range(len(ids)):
                d, r = data[off[i] : off[i + 1]], gone[off[i] : off[i + 1]]
                k = d[~r].tobytes()
                n_bytes_.append(len(d))
                n_removed.append(len(d) - len(k))
                n_spans.append(int(np.count_nonzero(r[1:] & ~r[:-1])) + int(len(r) > 0 and r[0]))
                digests.append(hashlib.sha256(k).hexdigest())
                kept.append(k)
        cols = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n_bytes_, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(cols | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    one = C.regroup(C.regroup(blocks, "block", first, C.PACKET), "shard", rank, C.PACKET, n_blocks)
    two = C.regroup(C.cogroup(blocks, one, second, C.PACKET, n_blocks), "shard", rerank, C.PACKET, n_blocks)
    return C.cogroup(blocks, two, last, KEPT if with_text else RESULT, n_blocks)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(C.table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, i, substr(h, 2 * i + 1, 2) AS x, CASE WHEN 2 * i + 400 <= length(h) THEN md5(substr(h, 2 * i + 1, 400)) END AS k FROM (SELECT rid, h, unnest(range(0, length(h) // 2)) AS i FROM d)),
r AS (SELECT rid, i, x, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS twice FROM w),
c AS (SELECT rid, i, x, coalesce(max(CASE WHEN twice THEN i END) OVER (PARTITION BY rid ORDER BY i) > i - 200, false) AS gone FROM r),
s AS (SELECT rid, i, x, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), false) AS span FROM c),
a AS (SELECT rid, count(*) AS n, count(*) FILTER (WHERE gone) AS n_gone, count(*) FILTER (WHERE span) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM s GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(n_gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a USING (rid)
"""


def brute_force(texts: dict[int, str | None], length: int = LENGTH) -> dict[int, tuple]:
    """The contract, said plainly, for tests."""
    from collections import Counter

    b = {k: (v or "").encode() for k, v in texts.items()}
    n = Counter(v[i : i + length] for v in b.values() for i in range(len(v) - length + 1))
    out = {}
    for k, v in b.items():
        gone = bytearray(len(v))
        for i in range(len(v) - length + 1):
            if n[v[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        rest = bytes(x for x, g in zip(v, gone, strict=True) if not g)
        out[k] = (len(v), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(rest).hexdigest())
    return out
