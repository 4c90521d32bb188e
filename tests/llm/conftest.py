import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "mu", "nu", "xi", "rho"]) + str(rng.randint(0, 40)) for _ in range(n))


def texts() -> list[tuple]:
    """Documents with copies, near copies, shared passages, a hot group, odd and empty ones, ties and a null id."""
    rng = random.Random(1)
    passage = prose(rng, 45)
    base = prose(rng, 120)
    out = [base] * 30
    for k in range(25):
        w = base.split()
        w[rng.randrange(len(w))] = f"edit{k}"
        out.append(" ".join(w))
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(15)]
    out += [prose(rng, rng.randint(1, 150)) for _ in range(60)]
    out += ["", None, " \t\n", "one", "one", "word " * 4, "ab" * 400, "ab" * 400, "é" * 300 + " ñandú\x0b" + "é" * 300, "x" * 5000, "Mixed CASE words, punctuation!! " * 12, "\U0001f600 a@b.co   +1 (212) 555-0100"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(out)]
    return rows + [(7, rows[7][1], "en", "s", 1), (None, base, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(docs):
    """The same with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("block", "shard", "payload", "row", "found", "spans", "base", "extra", "label", "digit", "_key", "bucket", "x", "id", "class_id", "length", "place", "score", "set_hash", "key")
    return docs.withColumns({n: F.lit("odd") for n in names})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")


@pytest.fixture(scope="session")
def by_id(docs):
    """(id, text) of the rows with distinct ids."""
    return {r["doc_id"]: r["text"] for r in docs.filter("doc_id IS NOT NULL").collect()}


@pytest.fixture(scope="session")
def unique(spark, by_id):
    return spark.createDataFrame([(k, v, "en", "s", 1) for k, v in by_id.items()], SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def labels(spark, by_id):
    """Long documents are good; those with the passage's neighbours are not judged."""
    rows = [(k, int(len(v or "") > 300), int("edit" in (v or ""))) for k, v in by_id.items() if k % 5]
    return spark.createDataFrame([*rows, (None, 1, 1), (3, None, None), (99999, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark, by_id):
    some = [v for v in by_id.values() if v and len(v.split()) > 40]
    return spark.createDataFrame([(0, " ".join(some[60].split()[5:35])), (1, " ".join(some[0].split()[:20])), (2, "one"), (3, None), (4, "!!"), (1, some[70])], "item_id long, text string")
