"""Near-duplicate embeddings: every vector against every other, in tiles, leading principal components first.

Unit vectors are turned by an orthogonal matrix, which changes no cosine: their principal components, fitted on a sample of at most
``SAMPLE_VALUES`` numbers, the widest first.  What the first components leave open is small, so most pairs are
decided by few of them.

1. Equal vectors are one from the start, with their number as weight; a group of copies of any size costs one vector.
2. Kd splits on the first ``BOX`` components cut the space in cells of near vectors (``ann.halved``); a cell is one or more tiles of about
   ``TILE_BYTES``.  Two unit vectors with cosine t are sqrt(2 - 2 t) apart, so cells whose boxes are farther apart are never compared.
   The rest are: each pair of tiles is a group of its own, no group holds more than two tiles, and tasks can be lost one by one.
3. In a pair of tiles, blocks of ``SIDE`` rows multiply their first ``LEAD`` components.  What is still to come is at most the product of the
   norms of the rest; where that cannot reach the threshold, the pair stops.  Then come twice as many components, and so on.  Within ``SLACK`` of
   the threshold the cosine of the vectors as they came decides.
4. A pair of tiles gives each vector its number of links (weighted) and one link to the least of those it hangs together with,
   never the links themselves, so a dense group costs rows in proportion to its members.  Components follow by minimum labels.

Work is quadratic in the rows but for cells that are far apart and pairs that stop early; what a task holds is not.  There are at most ``CELLS`` cells: beyond
that many tiles they grow with the table, and the directory of their boxes, which tasks get, stays at some 10 MB.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows without an
id (component_id null, kept).  Vectors link only with those of their own length.  Rows are told apart by number, so rows with
one vec_id link like any others, and each is kept if its id is the component's.  Vectors are scaled by powers of two before norms are
taken, so huge and tiny components neither overflow nor vanish.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import common as C
from .ann import cell_of, halved, units
from .near_dedup import components

THRESHOLD, SLACK = 0.95, 1e-9
BOX, LEAD, SIDE = 8, 16, 1024
SAMPLE_ROWS, SAMPLE_VALUES = 16_384, 4 << 20
TILE_BYTES, CELLS = 2 << 20, 1 << 16
RESULT = "vec_id long, n_links long, component_id long, kept boolean"


def principal(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose columns are the principal directions of the rows, the widest first."""
    centred = sample - sample.mean(0)
    return np.linalg.eigh(centred.T @ centred)[1][:, ::-1]


class Turn:
    """Vectors of the commonest length by its principal directions, others as they are."""

    def __init__(self, d: int, directions: np.ndarray):
        self.d, self.directions = d, directions

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.directions if unit.shape[1] == self.d else unit

    def box(self, unit: np.ndarray) -> np.ndarray:
        """The first components, filled up with zeros for short vectors."""
        x = self(unit)[:, :BOX]
        return np.pad(x, ((0, 0), (0, BOX - x.shape[1])))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of each length, and their matrix."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(lengths) - lengths
    for d in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == d)
        yield own, flat[start[own][:, None] + np.arange(d)]


def linked(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y (turned) have a cosine of at least the threshold; ux and uy are the same rows as they came."""
    d = x.shape[1]
    at = min(LEAD, d)
    product = x[:, :at] @ y[:, :at].T
    alive = None  # all at first; then the pairs (i, j) that go on, with their products
    while True:
        rest_x, rest_y = np.sqrt(np.einsum("ij,ij->i", x[:, at:], x[:, at:])), np.sqrt(np.einsum("ij,ij->i", y[:, at:], y[:, at:]))
        if alive is None:
            i, j = np.nonzero(product + rest_x[:, None] * rest_y[None, :] >= threshold - SLACK)
            if len(i) > product.size // 8 and at < d:  # many go on: whole blocks are faster
                to = min(2 * at, d)
                product += x[:, at:to] @ y[:, at:to].T
                at = to
                continue
            alive, value = (i, j), product[i, j]
        else:
            i, j = alive
            on = value + rest_x[i] * rest_y[j] >= threshold - SLACK
            alive, value = (i[on], j[on]), value[on]
        if at == d or not len(alive[0]):
            break
        i, j = alive
        to = min(2 * at, d)
        value = np.concatenate([value[k : k + 65_536] + np.einsum("ij,ij->i", x[i[k : k + 65_536], at:to], y[j[k : k + 65_536], at:to]) for k in range(0, len(i), 65_536)])
        at = to
    i, j = alive
    near = np.flatnonzero(np.abs(value - threshold) <= SLACK)
    value[near] = np.where(np.einsum("ij,ij->i", ux[i[near]], uy[j[near]]) >= threshold, 2.0, -2.0)
    out = np.zeros((len(x), len(y)), bool)
    ok = value >= threshold
    out[i[ok], j[ok]] = True
    return out


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that it hangs together with."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(ids: np.ndarray, weight: np.ndarray, left: np.ndarray, vectors: np.ndarray, turn: Turn, threshold: float, same: bool) -> pa.Table:
    """id, links, other of two tiles (or of one with itself): the linked rows, their links, and the least row they hang together with."""
    unit = units(vectors)
    turned = turn(unit)
    rows, columns = np.flatnonzero(left), np.flatnonzero(~left) if not same else np.flatnonzero(left)
    links, edges = np.zeros(len(ids)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a in range(0, len(rows), SIDE):
        for b in range(a if same else 0, len(columns), SIDE):
            r, c = rows[a : a + SIDE], columns[b : b + SIDE]
            hit = linked(turned[r], turned[c], unit[r], unit[c], threshold)
            if same and a == b:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            links[r] += hit @ weight[c]
            if not (same and a == b):
                links[c] += weight[r] @ hit
            i, j = np.nonzero(hit)
            label = least_labels(len(r) + len(c), i, j + len(r))
            nodes, own = np.r_[r, c], np.flatnonzero(label != np.arange(len(label)))
            edges.append((nodes[own], nodes[label[own]]))
    label = least_labels(len(ids), *(np.concatenate(x) for x in zip(*edges, strict=True)))
    on = np.flatnonzero(links > 0)
    return pa.table({"id": pa.array(ids[on]), "links": pa.array(links[on].astype(np.int64)), "other": pa.array(ids[label[on]])})


def _pairs(cells: list, threshold: float):
    """A function from rows of cells to the pairs of tiles that each row's tile is in."""
    number = {c["cell"]: k for k, c in enumerate(cells)}
    low, high = (np.array([c[k] for c in cells]).reshape(-1, BOX) for k in ("low", "high"))
    length, parts = np.array([c["d"] for c in cells]), np.array([c["parts"] for c in cells])
    first = np.cumsum(parts) - parts
    reach = 2 - 2 * threshold + SLACK

    def tiles_of(cell: int) -> np.ndarray:
        """The tiles of all cells that may hold something near this cell."""
        k = number[cell]
        gap = np.maximum(np.maximum(low - high[k], low[k] - high), 0.0)
        near = np.flatnonzero((np.einsum("ij,ij->i", gap, gap) <= reach) & (length == length[k]))
        return np.concatenate([np.arange(first[x], first[x] + parts[x]) for x in near])

    def run(batches):
        known: dict = {}
        for b in batches:
            cell = b["cell"].to_numpy()
            k = np.array([number[c] for c in cell.tolist()], np.int64)
            tile = first[k] + (C.mix(b["id"].to_numpy().astype(C.U64) + C.U64(1)) % parts[k].astype(C.U64)).astype(np.int64)
            for c in np.unique(cell).tolist():
                if c not in known:
                    known[c] = tiles_of(c)
            for t in np.unique(tile).tolist():
                own = np.flatnonzero(tile == t)
                to = known[int(cell[own[0]])]
                lo, hi = np.minimum(to, t), np.maximum(to, t)
                for at in range(0, len(to), 64):  # a batch of rows for some pairs at a time
                    x, y = lo[at : at + 64], hi[at : at + 64]
                    rows = b.take(pa.array(np.tile(own, len(x))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, len(own))), pa.array(np.repeat(y, len(own))), pa.array(np.repeat(x == t, len(own))), rows["id"], rows["w"], rows["v"]], names=["lo", "hi", "left", "id", "w", "v"])

    return run


def near_dedup(vectors: DataFrame, threshold: float = THRESHOLD, tile_bytes: int = TILE_BYTES, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    kind = vectors.schema["embedding"].dataType
    kind = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    v = F.col("embedding").cast(f"array<{kind}>")
    ok = F.col("vec_id").isNotNull() & F.coalesce((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda c: c != 0.0), F.lit(False))
    x = C.materialise(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.monotonically_increasing_id().alias("row")).withColumn("ok", ok))
    one = x.filter("ok").groupBy("v").agg(F.min("row").alias("id"), F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"))
    one = C.materialise(one.select("id", "w", "least", "v"))

    sizes = one.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    alone = x.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not sizes:
        return alone
    d, n = sizes[0]["d"], sizes[0]["count"]
    wanted = max(2, min(sample_rows, SAMPLE_VALUES // d))
    part = min(1.0, wanted / n)
    some = one.filter(F.size("v") == d).filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(part * (1 << 30))).limit(2 * wanted).select("v").toArrow()
    some = units(some["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)) if some.num_rows else np.eye(d)
    turn = Turn(d, principal(some))
    tile_rows = lambda d: max(16, tile_bytes // (8 * d))
    cell_rows = max(tile_rows(d), -(-n // cells))
    nodes = halved(turn.box(some), max(1, int(cell_rows * part)))[2]

    def to_cells(batches):
        for b in batches:
            cell = np.zeros(b.num_rows, np.int32)
            for own, m in _by_length(b["v"]):
                cell[own] = cell_of(turn.box(units(m)), nodes) if m.shape[1] == d else -m.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(cell), b["id"], b["w"], b["v"]], names=["cell", "id", "w", "v"])

    def to_boxes(batches):
        box: dict = {}
        for b in batches:
            cell = b["cell"].to_numpy()
            for own, m in _by_length(b["v"]):
                p = turn.box(units(m))
                for c in np.unique(cell[own]).tolist():
                    q = p[cell[own] == c]
                    _, count, low, high = box.get(c, (0, 0, np.inf, -np.inf))
                    box[c] = (m.shape[1], count + len(q), np.minimum(q.min(0), low), np.maximum(q.max(0), high))
        rows = [(c, k, count, low.tolist(), high.tolist()) for c, (k, count, low, high) in box.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], names=["cell", "d", "n", "low", "high"])

    placed = C.materialise(one.select("id", "w", "v").mapInArrow(to_cells, f"cell int, id long, w long, v array<{kind}>"))
    side = lambda f, name: F.array(*[f(F.col(name)[k]) for k in range(BOX)]).alias(name)
    boxes = placed.mapInArrow(to_boxes, "cell int, d int, n long, low array<double>, high array<double>").groupBy("cell", "d").agg(F.sum("n").alias("n"), side(F.min, "low"), side(F.max, "high"))
    rows = [r.asDict() for r in boxes.orderBy("cell").collect()]  # a row a cell, some CELLS of them at most (and one for each odd length)
    for r in rows:
        r["parts"] = -(-r["n"] // max(tile_rows(r["d"]), cell_rows if r["d"] == d else -(-r["n"] // cells)))

    def tiles(t: pa.Table) -> pa.Table:
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        left = t["left"].combine_chunks().to_numpy(zero_copy_only=False)
        own = t["v"].combine_chunks()
        own = pa.concat_arrays(own.chunks) if isinstance(own, pa.ChunkedArray) else own
        (_, m), *_ = _by_length(own)
        return compare(t["id"].to_numpy(), t["w"].to_numpy().astype(np.float64), left, m, turn, threshold, lo == hi)

    routed = placed.mapInArrow(_pairs(rows, threshold), f"lo long, hi long, left boolean, id long, w long, v array<{kind}>")
    found = C.materialise(routed.groupBy("lo", "hi").applyInArrow(tiles, "id long, links long, other long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    label = components(found.filter("id != other").select(F.col("id").alias("a"), F.col("other").alias("b")))

    known = one.select("id", "w", "least").join(links, "id", "left").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    known = C.materialise(known)
    first = known.groupBy("label").agg(F.min("least").alias("component_id"))
    told = known.join(first, "label").select("id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    told = one.select("id", "v").join(told, "id").select("v", "n_links", "component_id")
    rest = x.filter("ok").join(told, "v").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return rest.unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(C.table(spark, sf_dir, "embeddings"))


ORACLE_SQL = r"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT vec_id, v FROM e WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1),
reach(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM e LEFT JOIN n ON n.vec_id = e.vec_id LEFT JOIN c ON c.vec_id = e.vec_id
"""


def brute_force(rows: list[tuple], threshold: float = THRESHOLD) -> list[tuple]:
    """The rows of near_dedup() for (vec_id, vector), by the whole matrix of cosines."""
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(y is not None and np.isfinite(y) for y in v) and any(v)]
    near: dict = {k: set() for k in ok}
    for d in {len(rows[k][1]) for k in ok}:
        own = np.array([k for k in ok if len(rows[k][1]) == d])
        u = units(np.array([rows[k][1] for k in own], np.float64))
        hit = u @ u.T >= threshold
        np.fill_diagonal(hit, False)
        for a, b in zip(*np.nonzero(hit), strict=True):
            near[own[a]].add(own[b])
    out = []
    for k, (i, _) in enumerate(rows):
        if k not in near:
            out.append((i, 0, i, True))
            continue
        seen, todo = {k}, [k]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        least = min(rows[x][0] for x in seen)
        out.append((i, len(near[k]), least, i == least))
    return out
