"""Shared plumbing: table access, checkpoints, blocks of documents, packed exchanges.

Most operators here compare what *all* documents hold (n-grams, windows, byte strings).
A JVM row per token would cost far more than the texts, so documents are grouped in
*blocks* of some megabytes; a block sends each *shard* (a range of a 64-bit hash) one
packed, sorted array, and a shard answers each block with as small an array.  A frequent
token occurs once per block in such an exchange, so no key is hot, and blocks and shards
are plain shuffle keys: a lost executor costs a recomputation of its groups only.

Blocks and shards grow with the square root of the input beyond ``ROOT_BYTES`` (``scale``), so the packets
between them, blocks times shards, stay in proportion to the input; a task's memory grows with that root:
8 MB blocks at 30 GB, 32 MB at 1 TB, 320 MB at 100 TB.
"""

from __future__ import annotations

import atexit
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Base of the rolling polynomial hash (odd, 5 modulo 8) and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 384 << 10
MIN_BLOCKS, MAX_SHARD_BYTES = 24, 12 << 20
ROOT_BYTES = 64 << 30
BOUND_ROWS = 1 << 20  # rows sampled for the bounds of blocks, at most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: list[tuple[SparkSession, str]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where none is set in local mode (tests, bench)."""
    sc = spark.sparkContext
    had = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not had:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        had = tempfile.mkdtemp(prefix="rulemill-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", had)
    return had


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and go on from there; the lineage ends here.

    checkpoint() would compute df twice.  The tables go when the driver ends; a cluster's own clean-up
    of that folder takes those of a driver that was killed.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/rulemill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_remove)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove() -> None:
    for spark, path in _WRITTEN:
        jvm = getattr(spark.sparkContext, "_jvm", None)
        if jvm is None or spark.sparkContext._jsc is None:
            return  # the session has ended before
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's call that gives freed memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def tidied(run: Callable) -> Callable:
    """An Arrow function over batches whose worker, which lives on, gives its freed memory back at the end of a task."""

    def all_of(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return all_of


def text_column(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


# ---------------------------------------------------------------- blocks and shards


def volume(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def scale(n_bytes: int) -> float:
    """How much larger than at ROOT_BYTES blocks and shards are: both with the root, so packets stay in proportion."""
    return max(1.0, math.sqrt(n_bytes / ROOT_BYTES))


def block_count(n_rows: int, n_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, min(n_rows, max(MIN_BLOCKS, math.ceil(n_bytes / (block_bytes * scale(n_bytes))))))


def hash_blocks(df: DataFrame, n_blocks: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, key, text): blocks by hash, the same on every recomputation."""
    t = F.coalesce(F.col(text), F.lit(""))
    return spread(df.select(F.pmod(F.xxhash64(F.col(key), t), F.lit(n_blocks)).cast("int").alias("block"), F.col(key), t.alias("text")), n_blocks, "block")


def bounds(df: DataFrame, n_blocks: int, key: str, text: str) -> np.ndarray:
    """Keys that cut the table in ranges of about equal bytes, from a sample of at most BOUND_ROWS rows by hash."""
    some = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), (F.coalesce(F.octet_length(text), F.lit(0)) + 32).cast("long").alias("b"))
    n = df.count()
    part = min(1.0, min(BOUND_ROWS, 400 * n_blocks) / max(n, 1))
    t = some.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(part * (1 << 30))).limit(2 * BOUND_ROWS).toArrow()
    k, b = t["k"].to_numpy(), t["b"].to_numpy()
    order = np.argsort(k, kind="stable")
    k, at = k[order], np.cumsum(b[order])
    if not len(k):
        return np.zeros(0, np.int64)
    return np.unique(k[np.minimum(np.searchsorted(at, at[-1] * np.arange(1, n_blocks) / n_blocks), len(k) - 1)])


def range_blocks(df: DataFrame, n_blocks: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, key, text): every key of a block is below every key of the next one; null keys are in blocks below 0, by hash.

    Rows of one key share a block, as they must.
    """
    cuts = bounds(df, n_blocks, key, text)

    def number(batches):
        for x in batches:
            null = np.asarray(x["key"].is_null())
            block = np.searchsorted(cuts, x["key"].fill_null(0).to_numpy(), "left").astype(np.int32)
            block[null] = -1 - x["other"].to_numpy()[null]
            yield pa.RecordBatch.from_arrays([pa.array(block), x["key"], x["text"]], names=["block", key, "text"])

    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("key"), t.alias("text"), F.pmod(F.xxhash64(t), F.lit(n_blocks)).cast("int").alias("other"))
    return spread(rows.mapInArrow(number, f"block int, {key} long, text string"), n_blocks, "block")


PACKET = "block int, shard long, payload binary"
PACKET_PA = pa.schema([("block", pa.int32()), ("shard", pa.int64()), ("payload", pa.binary())])


def packets(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, PACKET_PA, strict=True)], schema=PACKET_PA)


def carried(block: int, place: int, wide: int) -> int:
    """The number, below 0, of a packet that a block sends to itself in the next round; ``wide`` places a block."""
    return -1 - block * wide - place


def shard_bits(n_bytes_total: int) -> int:
    """log2 of the shards, so that what meets in one shard stays near MAX_SHARD_BYTES (times the scale)."""
    return max(5, int(max(1, n_bytes_total // (MAX_SHARD_BYTES * scale(n_bytes_total)))).bit_length())


def filled(edges: np.ndarray) -> list[tuple[int, int, int]]:
    """(number, from, to) of the ranges between edges that are not empty."""
    return [(s, int(edges[s]), int(edges[s + 1])) for s in np.flatnonzero(np.diff(edges)).tolist()]


def split_shards(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted 64-bit keys by their top bits, empty ones left out."""
    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=U64) << U64(64 - bits)) if bits else np.zeros(0, int)
    return filled(np.r_[0, cuts, len(keys)])


def by_shard(t: pa.Table) -> Iterator[tuple[int, bytes]]:
    if not t.num_rows:  # a block that sent nothing got no reply
        return
    for i in np.argsort(t["shard"].to_numpy(), kind="stable"):
        yield t["shard"][int(i)].as_py(), t["payload"][int(i)].as_py()


def unpack_bits(replies: pa.Table, sizes: list[tuple[int, int, int]]) -> np.ndarray:
    """The flags that the shards sent for the keys of split_shards(), in their order."""
    got = dict(by_shard(replies))
    parts = [np.unpackbits(np.frombuffer(got[s], np.uint8), count=b - a) for s, a, b in sizes]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def spread(df: DataFrame, n_groups: int, key: str) -> DataFrame:
    """Dealt by key over twice as many partitions as there are groups of some megabytes, so that tasks follow the data."""
    return df.repartition(2 * n_groups, key)


def regroup(df: DataFrame, key: str, f: Callable, schema: str, n_groups: int = 0) -> DataFrame:
    return (spread(df, n_groups, key) if n_groups else df).groupBy(key).applyInArrow(f, schema)


def cogroup(blocks: DataFrame, replies: DataFrame, f: Callable, schema: str, n_blocks: int = 0) -> DataFrame:
    """Each block with its replies; ``blocks`` comes from hash_blocks or range_blocks where n_blocks is given."""
    right = spread(replies, n_blocks, "block") if n_blocks else replies
    return blocks.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(f, schema)


def block_id(t: pa.Table) -> int:
    return t["block"][0].as_py()


# ---------------------------------------------------------------- hashing of bytes


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    """A fixed odd 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    base = BASE_INV if inverse else BASE
    had = _POWERS.get(base)
    if had is None or len(had) < n:
        x = np.full(max(n, 1 << 16), base, U64)
        x[0] = 1
        had = np.multiply.accumulate(x)
        if n <= 8 << 20:
            _POWERS[base] = had
    return had[:n]


def rolling(a: np.ndarray) -> np.ndarray:
    """P with (P[e] - P[s]) * BASE**-s a hash of a[s:e], for any span."""
    out = np.zeros(len(a) + 1, U64)
    np.cumsum(byte_values()[a] * powers(len(a)), out=out[1:])
    return out


def span_hash(p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((p[e] - p[s]) * powers(len(p), True)[s])


def ordered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and which of them are the first of their kind."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x, new


def uniq(x: np.ndarray) -> np.ndarray:
    """Distinct values in order; a plain sort, which is far faster here than hashing."""
    x, new = ordered(x)
    return x[new]


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the number of each value's own."""
    order = np.argsort(x)
    s = x[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    which = np.empty(len(s), np.int32 if len(s) < 1 << 31 else np.int64)
    which[order] = np.cumsum(new) - 1
    return s[new], which


# ---------------------------------------------------------------- texts as bytes


def text_bytes(arr) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each text begins (n + 1 offsets); null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    b = arr.buffers()
    off = np.frombuffer(b[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(b[2], np.uint8)[off[0] : off[-1]] if b[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about limit bytes (one longer text stays whole)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z and all of a multi-byte character.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def word_spans(a: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside gap, and the number of them in each text."""
    n = len(a)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    word = ~gap[a]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.ones(n, bool)
    before[1:] = ~word[:-1]
    after = np.ones(n, bool)
    after[:-1] = ~word[1:]
    s = np.flatnonzero(word & (before | edge[:-1]))
    e = np.flatnonzero(word & (after | edge[1:])) + 1
    return s, e, np.diff(np.searchsorted(s, off))


def word_hashes(arr, gap: np.ndarray = SPACE, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of a string column, and the number of words of each text."""
    data, off = text_bytes(arr)
    hashes, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for i, j in pieces(off):
        a = data[off[i] : off[j]]
        a = LOWER[a] if lower else a
        s, e, c = word_spans(a, off[i : j + 1] - off[i], gap)
        hashes.append(span_hash(rolling(a), s, e))
        counts.append(c)
    return np.concatenate(hashes), np.concatenate(counts)


def window_hashes(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of n consecutive words inside one text, and the word at which each starts."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    g = np.zeros(len(h) - n + 1, U64)
    for q in range(n):
        g *= U64(BASE)
        g += h[q : len(h) - n + 1 + q]
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(doc[n - 1 :] == doc[: len(h) - n + 1])
    return mix(g[at]), at


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie inside [s, s + length) of any start."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1) if len(starts) < 64 else d.__iadd__(np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int32))
    ends = np.minimum(starts + length, n)
    d -= np.bincount(ends, minlength=n + 1)[: n + 1].astype(np.int32)
    return np.cumsum(d[:-1]) > 0


# ---------------------------------------------------------------- sparse count-min sketches


def encode_sorted(x: np.ndarray) -> bytes:
    """Sorted non-negative integers as gaps of 2, 4 or 8 bytes, whichever is the least that holds them."""
    d = np.diff(x.astype(np.int64), prepend=0)
    top = int(d.max()) if len(d) else 0
    kind = np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64
    return bytes([np.dtype(kind).itemsize]) + d.astype(kind).tobytes()


def decode_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, {2: np.uint16, 4: np.uint32, 8: np.int64}[b[0]], offset=1).astype(np.int64))


def sketch_merge(t: pa.Table) -> pa.Table:
    """A shard of the merged sketch: a cell is 'repeated' if the counters of all blocks in it sum to 2 or more.

    A block sends its non-zero cells in order, a cell with a counter of 2 or more twice; it gets back one
    bit for each cell that it sent (its distinct ones, in order).
    """
    blocks, cells = t["block"].to_numpy(), [decode_sorted(x.as_py()) for x in t["payload"]]
    every = np.concatenate(cells)
    every.sort()
    twice = uniq(every[1:][every[1:] == every[:-1]])
    shard, out = t["shard"][0].as_py(), []
    for b, c in zip(blocks, cells, strict=True):
        u = uniq(c)
        hit = np.zeros(len(u), bool)
        if len(twice):
            at = np.minimum(np.searchsorted(twice, u), len(twice) - 1)
            hit = twice[at] == u
        out.append((int(b), shard, np.packbits(hit).tobytes()))
    return packets(out)


class Sketch:
    """One row of a count-min sketch over 64-bit hashes: 2**bits cells in 2**shard_bits shards."""

    def __init__(self, n_keys: int, row: int, load: int = 6):
        self.bits = max(16, (max(1, n_keys)).bit_length() + load - 2)
        self.shard_bits = max(5, int(max(1, n_keys) // ((4 << 20) * scale(6 * n_keys))).bit_length())
        self.seed, self.first = U64(0xA0761D6478BD642F * (row + 1) & (1 << 64) - 1), row << 40

    def cells(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ self.seed) >> U64(64 - self.bits)).astype(np.int64)

    def sent(self, keys: np.ndarray, twice: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct cells in order and the counters (1, or 2 for more) of the distinct keys; twice: keys that count double."""
        u, which = ranked(self.cells(keys))
        n = np.bincount(which, minlength=len(u))
        if twice is not None:
            n[which[twice]] = 2
        return u, np.minimum(n, 2)

    def pack(self, block: int, keys: np.ndarray, twice: np.ndarray | None = None) -> list[tuple[int, int, bytes]]:
        u, n = self.sent(keys, twice)
        x = np.repeat(u, n)
        return [(block, self.first + s, encode_sorted(x[a:b] - (s << (self.bits - self.shard_bits)))) for s, a, b in self.slices(x)]

    def slices(self, x: np.ndarray) -> list[tuple[int, int, int]]:
        return filled(np.r_[0, np.searchsorted(x, np.arange(1, 1 << self.shard_bits) << (self.bits - self.shard_bits)), len(x)])

    def repeated(self, keys: np.ndarray, replies: pa.Table) -> np.ndarray:
        """For each key whether its merged counter is 2 or more: never false for a key that is there twice."""
        u, which = ranked(self.cells(keys))
        return unpack_bits(replies, [(self.first + s, a, b) for s, a, b in self.slices(u)])[which]
