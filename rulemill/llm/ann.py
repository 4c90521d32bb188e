"""Nearest neighbours by cosine: low-dimensional stable projections, indexed by kd-trees.

Unit vectors are projected on ``dim`` Gaussian directions (2-stable: a projected squared distance is the
true one times a chi-square variable of ``dim`` degrees).  One kd-tree over the projections indexes every
vector.  Its top, fitted on a sample of at most ``SAMPLE_ROWS`` projections, cuts the space in cells; a cell is a
block of rows (a crowded one is several), and the rest of the tree is built in the block's task.

A query meets the vectors in the order of their projected distance and verifies each with its exact
cosine.  It stops when a vector as near as its k-th best so far would, with probability ``stop``, have been
nearer in projection than what remains (chi-square test).  This runs in two rounds:

1. each query searches its own cell, which gives a first k-th best;
2. it goes on to those cells only whose boxes the test does not rule out, and searches them from that bound.

Queries meet a block in chunks of ``QUERY_ROWS``, so a group is bounded; a block's vectors are sent once
for each chunk of the queries that reach it.  The k best of all blocks are ranked by query with a limit
before the exchange.  ``n_verified`` says how many exact cosines were computed for the query.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; neither
do those of a length other than the commonest (smallest of ties), nor rows without an id.  Rows are told apart by
number, not by id: rows with one vec_id are each a query of their own and found by each other, once.  Equal scores go
to the smaller id.  Vectors are scaled by powers of two before norms are taken, so huge and tiny
components neither overflow nor vanish.  Fewer than k candidates give fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

K, EVERY, DIM, STOP, LEAF, SEED = 5, 50, 24, 0.9, 64, 7
CELL_ROWS, QUERY_ROWS, SAMPLE_ROWS, STEP = 16_000, 4_000, 65_536, 192
FOUND = "query long, query_id long, row long, vec_id long, score double, seen long"
PLACED = "cell int, row long, vec_id long, v array<double>"


def chi_square(x: np.ndarray, dim: int) -> np.ndarray:
    """Distribution function for an even number of degrees."""
    h = np.minimum(np.asarray(x, float) / 2, 700.0)
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, dim // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


def reach(stop: float, dim: int) -> float:
    """The projected squared distance, in true ones, below which a vector lies with probability ``stop``."""
    lo, hi = 0.0, 40.0 * dim
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, dim) < stop else (lo, mid)
    return hi


def plane(d: int, dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((d, dim))


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by powers of two first, which changes no digit."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0.0))[1][:, None])
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def halved(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Kd splits at the widest side's median until no part has more than ``size`` points: their order, the parts' edges, the nodes."""
    order, cuts, nodes, todo = np.arange(len(points)), [0], [], [(0, len(points), None)]
    while todo:
        a, b, parent = todo.pop()
        own = points[order[a:b]]
        axis = int(np.argmax(own.max(0) - own.min(0))) if b - a > size else -1
        flat = axis < 0 or own[:, axis].max() == own[:, axis].min()
        if parent is not None:
            nodes[parent[0]][parent[1]] = len(nodes)
        if flat:
            nodes.append([-1, 0.0, len(cuts) - 1, -1])  # a leaf: its number
            cuts.append(b)
            continue
        m = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, axis], m)]
        nodes.append([axis, float(points[order[a + m], axis]), -1, -1])
        todo += [(a + m, b, (len(nodes) - 1, 3)), (a, a + m, (len(nodes) - 1, 2))]
    return order, np.array(cuts), nodes


def cell_of(points: np.ndarray, nodes: list) -> np.ndarray:
    """The cell of the tree's top that each point falls in."""
    out, todo = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))] if nodes else []
    while todo:
        node, own = todo.pop()
        axis, value, left, right = nodes[node]
        if axis < 0:
            out[own] = left
        elif len(own):
            low = points[own, axis] < value
            todo += [(left, own[low]), (right, own[~low])]
    return out


def gaps(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a point from boxes."""
    d = np.maximum(np.maximum(low - q, q - high), 0.0)
    return np.einsum("ij,ij->i", d, d)


class Block:
    """Some vectors under a kd-tree of their projections."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, dim: int):
        unit = units(vectors)
        points = unit @ plane(vectors.shape[1], dim)
        order, self.cuts, _ = halved(points, LEAF)
        self.rows, self.ids, self.unit, self.points, self.dim = rows[order], ids[order], unit[order], points[order], dim
        self.low = np.minimum.reduceat(self.points, self.cuts[:-1])
        self.high = np.maximum.reduceat(self.points, self.cuts[:-1])

    def search(self, row: int, u: np.ndarray, p: np.ndarray, bound: float, k: int, far: float):
        """Places and scores of the k best, given that scores below ``bound`` are of no use, and how many were verified."""
        near = gaps(p, self.low, self.high)
        leaves = np.argsort(near, kind="stable")
        near = near[leaves]
        best, score, seen, at = np.zeros(0, np.int64), np.zeros(0), 0, 0
        waiting, wait_d = np.zeros(0, np.int64), np.zeros(0)

        def limit() -> float:  # what is farther in projection fails the test
            kth = max(bound, score[k - 1]) if len(score) >= k else bound
            return far * max(2.0 - 2.0 * kth, 1e-12) if np.isfinite(kth) else np.inf

        while True:
            edge = limit()
            # leaves come in until a step's worth of points is known to be the next nearest ones
            ready = np.count_nonzero(wait_d <= (near[at] if at < len(leaves) else np.inf))
            if ready < STEP and at < len(leaves) and near[at] <= edge:
                take = leaves[at : at + 8][near[at : at + 8] <= edge]
                at += len(take)
                new = np.concatenate([np.arange(self.cuts[x], self.cuts[x + 1]) for x in take])
                gap = self.points[new] - p
                d = np.einsum("ij,ij->i", gap, gap)
                waiting, wait_d = np.concatenate([waiting, new]), np.concatenate([wait_d, d])
                continue
            safe = np.flatnonzero(wait_d <= min(edge, near[at] if at < len(leaves) else np.inf))
            if not len(safe):
                return best, score, seen
            if len(safe) > STEP:
                safe = safe[np.argpartition(wait_d[safe], STEP)[:STEP]]
            own = waiting[safe]
            own = own[self.rows[own] != row]
            s = np.einsum("ij,j->i", self.unit[own], u)
            seen += len(own)
            best, score = np.concatenate([best, own]), np.concatenate([score, s])
            top = np.lexsort((self.ids[best], -score))[:k]
            best, score = best[top], score[top]
            keep = np.ones(len(waiting), bool)
            keep[safe] = False
            waiting, wait_d = waiting[keep], wait_d[keep]


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v as doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    x = vectors.select("vec_id", v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.col("vec_id").isNotNull())
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return x.filter(~F.exists("v", bad) & F.exists("v", lambda c: c != 0.0))


def _matrix(t, d: int) -> np.ndarray:
    v = t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"]
    v = pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, in order."""
    w = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.filter(F.col("row").isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K, dim: int = DIM, stop: float = STOP, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score, n_verified of the k nearest of every row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    x = valid(vectors)
    sizes = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_verified long")
    d, n = sizes[0]["d"], sizes[0]["count"]
    far = reach(stop, dim)
    # row numbers are written with the rows, so that every later reading has the same ones
    x = C.materialise(x.filter(F.size("v") == d).select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.monotonically_increasing_id().alias("row")))

    part = min(1.0, SAMPLE_ROWS / n)
    some = x.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(part * (1 << 30))).limit(SAMPLE_ROWS).select("v").toArrow()
    _, _, nodes = halved(units(_matrix(some, d)) @ plane(d, dim), max(1, int(cell_rows * part))) if some.num_rows else (None, None, [])

    def to_cells(batches):
        for b in batches:
            v = _matrix(b, d)
            yield pa.RecordBatch.from_arrays([pa.array(cell_of(units(v) @ plane(d, dim), nodes)), b["row"], b["vec_id"], b["v"]], names=["cell", "row", "vec_id", "v"])

    def to_boxes(batches):
        low, high, count = {}, {}, {}
        for b in batches:
            p, c = units(_matrix(b, d)) @ plane(d, dim), b["cell"].to_numpy()
            for i in np.unique(c).tolist():
                own = p[c == i]
                low[i] = np.minimum(own.min(0), low.get(i, np.inf))
                high[i] = np.maximum(own.max(0), high.get(i, -np.inf))
                count[i] = count.get(i, 0) + len(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int32()), pa.array(list(count.values()), pa.int64()), pa.array([x.tolist() for x in low.values()], pa.list_(pa.float64())), pa.array([x.tolist() for x in high.values()], pa.list_(pa.float64()))], names=["cell", "n", "low", "high"])

    placed = C.materialise(x.mapInArrow(to_cells, PLACED))
    side = lambda f, name: F.array(*[f(F.col(name)[i]) for i in range(dim)]).alias(name)
    boxes = placed.mapInArrow(to_boxes, "cell int, n long, low array<double>, high array<double>").groupBy("cell").agg(F.sum("n").alias("n"), side(F.min, "low"), side(F.max, "high"))
    cells = boxes.orderBy("cell").collect()  # the tree's directory: a row a cell, n / cell_rows of them
    low, high = np.array([c["low"] for c in cells]).reshape(-1, dim), np.array([c["high"] for c in cells]).reshape(-1, dim)
    parts = np.array([-(-c["n"] // cell_rows) for c in cells])
    first, number = np.cumsum(parts) - parts, np.full(max((c["cell"] for c in cells), default=0) + 1, -1)
    number[[c["cell"] for c in cells]] = np.arange(len(cells))

    def to_blocks(batches):
        for b in batches:
            c = number[b["cell"].to_numpy()]
            block = first[c] + (C.mix(b["row"].to_numpy().astype(C.U64) + C.U64(1)) % parts[c].astype(C.U64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), b["row"], b["vec_id"], b["v"]], names=["block", "row", "vec_id", "v"])

    def routes(home: bool):
        """Each query with the blocks of its own cell, or of the others that its bound leaves."""

        def run(batches):
            for b in batches:
                own, bound = number[b["cell"].to_numpy()], b["bound"].to_numpy(zero_copy_only=False)
                p, rows, blocks = units(_matrix(b, d)) @ plane(d, dim), [], []
                for i in range(len(own)):
                    if home:
                        to = own[i : i + 1]
                    else:
                        ok = gaps(p[i], low, high) <= (far * max(2.0 - 2.0 * bound[i], 1e-12) if np.isfinite(bound[i]) else np.inf)
                        ok[own[i]] = False
                        to = np.flatnonzero(ok)
                    for c in to.tolist():
                        blocks += range(int(first[c]), int(first[c] + parts[c]))
                        rows += [i] * int(parts[c])
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), *(b[c].take(pa.array(rows, pa.int64())) for c in ("row", "vec_id", "v", "bound"))], names=["block", "row", "vec_id", "v", "bound"])

        return run

    def search(_key, t: pa.Table, q: pa.Table) -> pa.Table:
        cols = [[] for _ in range(6)]
        if t.num_rows and q.num_rows:
            block = Block(t["row"].to_numpy(), t["vec_id"].to_numpy(), _matrix(t, d), dim)
            u, bound = units(_matrix(q, d)), q["bound"].to_numpy(zero_copy_only=False)
            p = u @ plane(d, dim)
            for i, (row, vec_id) in enumerate(zip(q["row"].to_pylist(), q["vec_id"].to_pylist(), strict=True)):
                best, score, seen = block.search(row, u[i], p[i], bound[i], k, far)
                own = [*zip(block.rows[best].tolist(), block.ids[best].tolist(), score.tolist(), [0] * len(best), strict=True), (None, None, None, seen)]
                for o in own:
                    for c, value in zip(cols, (row, vec_id, *o), strict=True):
                        c.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        return pa.table([pa.array(c, f) for c, f in zip(cols, kinds, strict=True)], names=["query", "query_id", "row", "vec_id", "score", "seen"])

    blocks = placed.mapInArrow(to_blocks, "block int, row long, vec_id long, v array<double>")

    def meet(asked: DataFrame, home: bool) -> DataFrame:
        routed = C.materialise(asked.mapInArrow(routes(home), "block int, row long, vec_id long, v array<double>, bound double"))
        chunks = routed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("chunks"))
        chunks = C.materialise(chunks)
        # one row a block, n / cell_rows of them: small beside the vectors, and sent to all
        sent = blocks.join(F.broadcast(chunks), "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        queries = routed.join(F.broadcast(chunks), "block").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks").cast("long")).cast("int")).drop("chunks")
        return C.materialise(sent.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInArrow(search, FOUND))

    asked = placed.filter(F.col("vec_id") % every == 0)
    near = meet(asked.withColumn("bound", F.lit(float("-inf"))), True)
    kth = _best(near, k).filter(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("bound"))
    others = meet(asked.join(kth, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))).select("cell", "row", "vec_id", "v", "bound"), False)
    found = near.unionByName(others)
    seen = found.filter(F.col("row").isNull()).groupBy("query").agg(F.sum("seen").alias("n_verified"))
    return _best(found, k).join(seen, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "n_verified")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(C.table(spark, sf_dir, "embeddings"))


def brute_force(ids: np.ndarray, vectors: np.ndarray, every: int = EVERY, k: int = K) -> dict[int, list[int]]:
    norms = np.sqrt((vectors * vectors).sum(1))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = vectors @ vectors[i] / (norms * norms[i])
        rest = np.flatnonzero(np.arange(len(ids)) != i)
        out[int(ids[i])] = ids[rest[np.lexsort((ids[rest], -s[rest]))[:k]]].tolist()
    return out
