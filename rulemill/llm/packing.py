"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids; each is cut in pieces of at most ``capacity`` tokens (only longer ones are
cut, and the first piece is the short one).  The pieces' lengths form a histogram of at most
``capacity`` sizes, whatever the corpus, and only that goes to the driver:

1. multiplicative weights solve the covering program "every size as often as it occurs" over
   configurations (multisets of sizes that fit) in fractions: sizes that are behind get larger prices, and a
   knapsack dynamic program prices the configurations; the averaged prices prove a lower bound;
2. uses are rounded to whole sequences, and what is left over is solved and rounded again; the last few
   sequences, at most a twentieth, are priced one by one by a knapsack over the pieces left;
3. the plan, a table of at most some thousand runs "pieces a..b of size s go to sequences q.. at offset o",
   goes back to the executors.  A piece finds its place from its rank among the pieces of its size, which
   comes from counts per (block, size), so no window spans a frequent size.

Defined results: null or empty text is the end token alone; repeated rows are packed each; an empty table
gives no rows; other columns are ignored.  The tokenizer's file is a parameter; ids equal those of the
``tokenizers`` library with that file.  The rank file of the same vocabulary encodes about four times
faster; texts with very long runs without a break, where that library is slow, go to ``tokenizers``.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: The program: phases of the first round, rounds, start sizes of a phase, price rate and the lag it is cut at.
PHASES, ROUNDS, STARTS, RATE, LAG = 60, 24, 400, 0.002, 5
RESIDUAL, SINGLES = 0.04, 600  # what may be left to be priced one by one: a share of all, and sequences
Config = tuple[tuple[int, int], ...]
CAPACITY, END_ID, MIN_BLOCKS, BLOCK_ROWS = 2048, 0, 64, 50_000
SPECIAL = "<|endoftext|>"
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"


@lru_cache(maxsize=2)
def encoder(name: str = "byte_bpe_50k"):
    """Text to ids, by the rank file where that is as good, else by the tokenizer's own file."""
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(P.path(f"{name}.json"))
    with open(P.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})

    def encode(text: str) -> list[int]:
        if LONG_RUN.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all")

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole if they fit, else full pieces after a first one with the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and the place of its document (and the ids)."""

    def run(batches):
        enc = encoder()
        for batch in batches:
            rows = []
            for d, text, row in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["row"].to_pylist(), strict=True):
                t = np.array([*enc(text or ""), END_ID], "<u4")
                for k, (s, n) in enumerate(cut(len(t), capacity)):
                    x = t[s : s + n].tobytes()
                    rows.append((d, k, s, n, zlib.crc32(x), row, *((x,) if ids else ())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("place", pa.int64()), *([("ids", pa.binary())] if ids else [])])
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(C.tidied(run), PIECES + (", ids binary" if ids else ""))


# ---------------------------------------------------------------- the plan, on the driver


def price(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack over the capacity: the largest total value in each room, and the size taken last there (-1: leave one token)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], k = best[c - 1], fit[c]
        if k:
            v = value[:k] + best[c - sizes[:k]]
            i = k - 1 - int(v[::-1].argmax())  # of equal ones the largest: small sizes stay for closing gaps
            if v[i] > best[c] + 1e-12:
                best[c], take[c] = v[i], i
    return best, take


def configuration(take: np.ndarray, sizes: np.ndarray, capacity: int, first: int) -> Config:
    """The best priced configuration among those that hold the size number ``first``: (size number, times) in order."""
    out, c = {first: 1}, capacity - int(sizes[first])
    while c > 0:
        i = int(take[c])
        if i < 0:
            c -= 1
        else:
            out[i] = out.get(i, 0) + 1
            c -= int(sizes[i])
    return tuple(sorted(out.items()))


@dataclass
class Program:
    """A fractional solution: how often each configuration is used, and the bound that its averaged prices prove."""

    use: dict[Config, float]
    bound: float


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, phases: int = PHASES) -> Program:
    """The covering program "every size as often as it occurs, in the fewest sequences", by multiplicative weights.

    A size's price is its share of the capacity times exp(rate * how far it is behind the even schedule); larger
    sizes, which are harder to place, are priced up a little.  Each phase prices configurations by one knapsack
    table and uses those that hold the sizes furthest behind, for its share of the sequences.  Prices divided by
    their best configuration's are a feasible dual; so is their average over the phases, whose value bounds every packing
    from below.
    """
    total = float((sizes * demand).sum()) / capacity
    covered, dual, use = np.zeros(len(sizes)), np.zeros(len(sizes)), {}
    for t in range(1, phases + 1):
        gap = demand * (t / phases) - covered
        lag = np.clip(gap * phases / demand, -LAG, LAG)
        y = sizes / capacity * np.exp(RATE * (lag + 2 * LAG * sizes / capacity))
        best, take = price(y, sizes, capacity)
        dual += y / best[capacity] / phases
        behind, room = np.maximum(gap, 0), total / phases
        for i in np.argsort(-behind * sizes, kind="stable")[:STARTS].tolist():
            if behind[i] <= 1e-9:
                continue
            config = configuration(take, sizes, capacity, i)
            amount = min(behind[i] / dict(config)[i], room)
            if amount <= 0:
                break
            use[config] = use.get(config, 0.0) + amount
            room -= amount
            for j, n in config:
                behind[j] -= amount * n
                covered[j] += amount * n
    return Program(use, float(dual @ demand))


def rounded(use: dict[Config, float], left: np.ndarray, rng) -> list[tuple[Config, int]]:
    """Whole sequences from a fractional solution: each use rounded up or down at random, by its fraction, within what is left."""
    out = []
    for config in sorted(use, key=lambda c: (-use[c], c)):
        n = int(use[config]) + (rng.random() < use[config] % 1)
        n = min(n, *(int(left[i]) // times for i, times in config))
        if n > 0:
            out.append((config, n))
            for i, times in config:
                left[i] -= n * times
    return out


def fullest(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """Of the pieces left, the largest and those that fill its sequence best: a bounded knapsack at the sizes as prices.

    Sets of reachable sums are bits of whole numbers, one set after each size, large sizes first.
    """
    top = max(i for i, n in enumerate(left) if n)
    room, order = capacity - sizes[top], [i for i in range(top, -1, -1) if left[i]]
    order = [i for i in order if sizes[i] <= room and left[i] - (i == top) > 0]
    mask, reach = (1 << room + 1) - 1, [1]
    for i in order:
        r, n, k = reach[-1], min(left[i] - (i == top), room // sizes[i]), 1
        while n > 0:
            step = min(k, n)
            r |= r << step * sizes[i] & mask
            n, k = n - step, 2 * k
        reach.append(r)
        if r >> room & 1:
            break
    at, out = reach[-1].bit_length() - 1, {top: 1}
    for i, before in zip(reversed(order[: len(reach) - 1]), reversed(reach[:-1]), strict=True):
        while not before >> at & 1:
            at -= sizes[i]
            out[i] = out.get(i, 0) + 1
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, report: dict | None = None) -> list[tuple[dict[int, int], int]]:
    """Configurations and how many sequences have each; together they hold the histogram exactly.

    The program is solved and rounded, and what is left is a smaller program of the same kind, until it is less than
    ``RESIDUAL`` of all and few enough sequences; the last ones are priced one by one.  ``report`` gets the bound, the
    number of sequences, and the share of those priced one by one.
    """
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    left, out, bound, volume = demand.copy(), [], 0.0, int((sizes * demand).sum())
    rng = np.random.default_rng(1)
    for k in range(ROUNDS):
        live = np.flatnonzero(left)
        todo = int((sizes * left).sum())
        if not len(live) or (k and todo <= min(RESIDUAL * volume, SINGLES * capacity)):
            break
        got = solve(sizes[live], left[live].astype(float), capacity, PHASES if not k else PHASES // 3)
        bound = bound or max(got.bound, volume / capacity)
        own = left[live]
        out += [({int(sizes[live[i]]): n for i, n in config}, times) for config, times in rounded(got.use, own, rng)]
        left[live] = own
    singles, pool, stock = 0, sizes.tolist(), left.tolist()
    while any(stock):
        config = fullest(pool, stock, capacity)
        times = min(stock[i] // n for i, n in config.items())
        out.append(({pool[i]: n for i, n in config.items()}, times))
        singles += times
        for i, n in config.items():
            stock[i] -= n * times
    if report is not None:
        n = int(sum(times for _, times in out))
        report |= {"bound": math.ceil(bound - 1e-6), "sequences": n, "residual": float(singles / max(n, 1))}
    return out


def runs(configs: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each size its runs in order of rank: first rank, per sequence, first sequence, offset in the sequence."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for cfg, n in configs:
        offset = 0
        for size, per in sorted(cfg.items(), reverse=True):
            out.setdefault(size, []).append((used.get(size, 0), per, sequence, offset))
            used[size] = used.get(size, 0) + per * n
            offset += size * per
        sequence += n
    return {s: np.array(x, np.int64) for s, x in out.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece (and its ids as little-endian 32-bit)."""
    made = C.materialise(tokenised_pieces(docs, capacity, ids))  # encoded once; ranks and places read the same rows
    n_blocks = max(MIN_BLOCKS, made.count() // BLOCK_ROWS + 1)
    made = made.withColumn("block", F.pmod("place", F.lit(n_blocks)).cast("int"))
    counts = made.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))  # for each size a row a block at most
    before = W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("n").over(before), F.lit(0))
    # new names: the two sides of a cogroup must not share columns of one origin
    first = counts.select(F.col("block").alias("of_block"), F.col("length").alias("of_length"), rank.alias("rank")).withColumnRenamed("of_block", "block")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = runs(plan(histogram, capacity))

    def place(_key, t: pa.Table, first: pa.Table) -> pa.Table:
        length, base = t["length"].to_numpy(), dict(zip(first["of_length"].to_pylist(), first["rank"].to_pylist(), strict=True))
        order = np.lexsort((t["piece"].to_numpy(), t["place"].to_numpy(), length))
        t, length = t.take(pa.array(order)), length[order]
        seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        edges = np.flatnonzero(np.r_[True, length[1:] != length[:-1], True]) if len(length) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            size = int(length[a])
            rank, r = base[size] + np.arange(b - a), table[size]
            i = np.searchsorted(r[:, 0], rank, "right") - 1
            k = rank - r[i, 0]
            seq[a:b] = r[i, 2] + k // r[i, 1]
            offset[a:b] = r[i, 3] + k % r[i, 1] * size
        return t.drop_columns(["block", "place"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + ("ids binary, " if ids else "") + "sequence_id long, offset long"
    return C.cogroup(made, first, place, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
