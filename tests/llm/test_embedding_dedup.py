"""Near-duplicate embeddings against the whole matrix of cosines, and the defined cases."""

import numpy as np
import pytest

from rulemill.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ("vec_id", "n_links", "component_id", "kept")


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select(*COLUMNS).collect())


def vectors(seed: int, d: int = 24) -> list[tuple]:
    """A hot vector, a dense group of near copies, chains whose ends are far apart, pairs about the threshold, and noise."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    out = [rng.standard_normal(d)] * 1
    out += [out[0]] * 60
    centre = unit(rng.standard_normal(d))
    out += [centre + 0.03 * rng.standard_normal(d) for _ in range(80)]
    step = unit(rng.standard_normal(d))
    for _ in range(12):
        step = unit(step + 0.25 * unit(rng.standard_normal(d)))
        out.append(3 * step)
    for t in (0.90, 0.9499, 0.95001, 0.96):
        a = unit(rng.standard_normal(d))
        b = rng.standard_normal(d)
        b = unit(b - (b @ a) * a)
        out += [a, t * a + np.sqrt(1 - t * t) * b]
    out += list(rng.standard_normal((150, d)))
    order = rng.permutation(len(out))
    return [(int(k), [float(np.float32(x)) for x in out[i]]) for k, i in enumerate(order)]


@pytest.mark.parametrize("tile_bytes", [1 << 20, 6000, 100])
@pytest.mark.parametrize("d", [2, 24])
def test_against_all_pairs(spark, tile_bytes, d):
    rows = vectors(d, d)
    got = embedding_dedup.near_dedup(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(4), tile_bytes=tile_bytes)
    assert rows_of(got) == sorted(map(repr, embedding_dedup.brute_force(rows)))


def test_few_cells_and_a_small_sample(spark):
    rows = vectors(5)
    got = embedding_dedup.near_dedup(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), tile_bytes=100, cells=3, sample_rows=20)
    assert rows_of(got) == sorted(map(repr, embedding_dedup.brute_force(rows)))


def test_defined_cases(spark):
    """Nulls, zeros, non-finite components, unlike lengths, huge and tiny ones, null and repeated ids, clashing columns."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1e38, 0.0]), (3, [1e-40, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (None, None)]
    rows += [(10, [1.0, 0.0, 0.0]), (11, [2.0, 0.0, 0.0]), (12, [-1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.01]), (13, [1.0]), (14, [-1.0]), (15, [3.0]), (16, [-0.0, 2.0]), (16, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = sorted(map(repr, embedding_dedup.brute_force(rows)))
    assert rows_of(embedding_dedup.near_dedup(df)) == want
    names = ("row", "v", "ok", "id", "w", "least", "cell", "lo", "hi", "left", "links", "other", "label", "kept")
    assert rows_of(embedding_dedup.near_dedup(df.selectExpr("*", *[f"'odd' AS {n}" for n in names]))) == want
    wide = df.selectExpr("vec_id", "CAST(embedding AS array<double>) AS embedding")
    assert rows_of(embedding_dedup.near_dedup(wide)) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup.near_dedup(none).count() == 0
    only = spark.createDataFrame([(3, None, 0), (4, [0.0], 0)], SCHEMA)
    assert rows_of(embedding_dedup.near_dedup(only)) == ["(3, 0, 3, True)", "(4, 0, 4, True)"]


def test_stops_lose_no_pair():
    """Blocks in which few, many and all pairs go on, against whole products."""
    rng = np.random.default_rng(1)
    for spread in (0.05, 0.2, 1.0, 5.0):
        u = 1 + spread * rng.standard_normal((300, 70))
        u /= np.linalg.norm(u, axis=1)[:, None]
        turn = embedding_dedup.Turn(70, embedding_dedup.principal(u))
        for t in (0.5, 0.95, 0.999):
            got = embedding_dedup.linked(turn(u[:200]), turn(u[100:]), u[:200], u[100:], t)
            assert (got == (np.einsum("id,jd->ij", u[:200], u[100:]) >= t)).mean() > 1 - 1e-9
