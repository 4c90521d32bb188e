"""Substring dedup by word windows: a count-min prefilter, then exact grouping of what it leaves.

A window is ``window`` consecutive words of one document.  Every word covered by a window whose
word sequence also starts in a document with a smaller id is removed; windows are judged on the
input.  Three passes over blocks of documents (see common.py), in one plan:

1. each block sends its counters of a count-min sketch (rows ``depth``); a shard of cells adds the
   blocks' counters and answers which cells hold 2 or more documents.  A sketch only overestimates,
   so no window that is there twice is lost;
2. each block sends the full hashes of the windows that every row of the sketch calls repeated; a
   shard groups them exactly and answers whether a block with smaller ids has the same window
   (blocks are ranges of doc_id, so the block number stands for the id);
3. each block removes the covered words.

Defined results: null or empty text has no words, n_words 0 and the hash of the empty string; a text
of fewer than ``window`` words keeps all; rows with the same doc_id do not remove one another's words;
a null doc_id is smaller than no id, so such a row neither loses nor takes words (these rows are dealt over
blocks of their own by hash); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

WINDOW, DEPTH = 13, 2
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
KEPT = RESULT + ", kept string"


def _windows(t: pa.Table, n: int):
    """Hashes of the windows, the index of the row each lies in, its first word, and each row's number of words."""
    h, counts = C.word_hashes(t["text"])
    w, at = C.window_hashes(h, counts, n)
    doc = np.repeat(np.arange(len(counts)), counts)[at]
    return w, doc, at, counts


def _first_ids(ids: np.ndarray, w: np.ndarray, doc: np.ndarray):
    """Distinct windows, the smallest id that has each, whether two ids of this block have it, and which of them each window is."""
    u, which = C.ranked(w)
    least, most = np.full(len(u), np.iinfo(np.int64).max), np.full(len(u), np.iinfo(np.int64).min)
    np.minimum.at(least, which, ids[doc])
    np.maximum.at(most, which, ids[doc])
    return u, least, least != most, which


def substring_dedup(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text) of every document."""
    n_rows, n_bytes = C.volume(docs)
    n_blocks = C.block_count(n_rows, n_bytes)
    blocks = C.range_blocks(docs, n_blocks)
    rows = [C.Sketch(n_bytes // 6, r, load=5) for r in range(depth)]
    bits = C.shard_bits(n_bytes // 2)

    def first(t: pa.Table) -> pa.Table:
        b = C.block_id(t)
        if b < 0:
            return C.packets([])
        w, doc, _, _ = _windows(t, window)
        u, _, twice, _ = _first_ids(t["doc_id"].to_numpy(), w, doc)
        return C.packets([x for s in rows for x in s.pack(b, u, np.flatnonzero(twice))])

    def second(_key, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows or C.block_id(t) < 0:
            return C.packets([])
        w = C.uniq(_windows(t, window)[0])
        left = np.ones(len(w), bool)
        for s in rows:
            left &= s.repeated(w, replies)
        b, w2 = C.block_id(t), w[left]
        out = [(b, s, w2[x:y].tobytes()) for s, x, y in C.split_shards(w2, bits)]
        return C.packets([*out, (b, C.carried(b, 0, 1), np.packbits(left).tobytes())])

    def group(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        if shard < 0:
            return t.select(["block", "shard", "payload"])
        blocks_, keys = t["block"].to_numpy(), [np.frombuffer(x.as_py(), C.U64) for x in t["payload"]]
        every = np.concatenate(keys)
        owner = np.repeat(blocks_, [len(k) for k in keys])
        u, which = C.ranked(every)
        least = np.full(len(u), np.iinfo(np.int64).max)
        np.minimum.at(least, which, owner)
        later = least[which] < owner
        edges = np.r_[0, np.cumsum([len(k) for k in keys])]
        return C.packets([(int(b), shard, np.packbits(later[edges[i] : edges[i + 1]]).tobytes()) for i, b in enumerate(blocks_)])

    def last(_key, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _result([], [], [], [], with_text)
        n, b = t.num_rows, C.block_id(t)
        w, doc, at, counts = _windows(t, window)
        removed = np.zeros(int(counts.sum()), bool)
        if b >= 0 and len(w):
            ids = t["doc_id"].to_numpy()
            u, least, _, k = _first_ids(ids, w, doc)
            got = dict(C.by_shard(replies))
            left = np.unpackbits(np.frombuffer(got[C.carried(b, 0, 1)], np.uint8), count=len(u)).astype(bool)
            earlier = np.zeros(len(u), bool)
            earlier[left] = C.unpack_bits(replies, C.split_shards(u[left], bits))
            removed = C.cover(at[earlier[k] | (ids[doc] > least[k])], window, len(removed))
        texts, n_removed, digests, kept, lo = t["text"], [], [], [], 0
        edges = np.r_[0, np.cumsum(counts)]
        gone = np.add.reduceat(np.r_[removed, False].astype(np.int64), edges[:-1]) if n else []
        for i in range(n):
            lo, hi = edges[i], edges[i + 1]
            words = texts[i].as_py().encode().split()
            if hi > lo and gone[i]:
                words = [x for x, r in zip(words, removed[lo:hi].tolist(), strict=True) if not r]
            n_removed.append(int(hi - lo) - len(words))
            k = b" ".join(words)
            digests.append(hashlib.sha256(k).hexdigest())
            kept.append(k.decode() if with_text else "")
        return _result(t["doc_id"], counts, n_removed, digests, with_text, kept)

    one = C.regroup(C.regroup(blocks, "block", first, C.PACKET), "shard", C.sketch_merge, C.PACKET, n_blocks)
    two = C.regroup(C.cogroup(blocks, one, second, C.PACKET, n_blocks), "shard", group, C.PACKET, n_blocks)
    return C.cogroup(blocks, two, last, KEPT if with_text else RESULT, n_blocks)


def _result(ids, counts, removed, digests, with_text: bool, kept=()) -> pa.Table:
    cols = {"doc_id": pa.array(ids.to_pylist() if hasattr(ids, "to_pylist") else list(ids), pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    return pa.table(cols | ({"kept": pa.array(kept, pa.string())} if with_text else {}))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(C.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+') AS w0 FROM documents),
w AS (SELECT doc_id, CASE WHEN len(w0) = 1 AND w0[1] = '' THEN []::VARCHAR[] ELSE w0 END AS w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) < doc_id AS r FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM m WHERE r),
x AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda v, i: NOT coalesce(list_contains(ps, i), false)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN x ON x.doc_id = w.doc_id
"""
