"""Source divergence against plain counting, and its defined cases."""

import random

from rulemill.llm import source_audit


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def held_against_brute(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got, want = rows_of(source_audit.audit(docs, **kw)), sorted(map(repr, source_audit.brute_force(rows, **kw)))
    assert got == want
    return got


def test_against_plain_counting(spark):
    """Terms that all sources share, that one has, rare ones; ties of whole sources; A-Z alone are lower-cased."""
    rng = random.Random(3)
    rows = []
    for i in range(160):
        source = rng.choice("abcde")
        words = rng.choices(["the", "The", "é", "É", "straße", "日本", "x"], k=20) + [f"own{source}"] * 2 + [f"w{chr(97 + rng.randint(0, 25))}" for _ in range(30)]
        rows.append((" ".join(words) + "!1a2b", rng.choice(["en", "de"]), source))
    rows += [("same words here", "fr", s) for s in ("a", "b", "B", "É") for _ in range(5)]
    got = held_against_brute(spark, rows, min_docs=4)
    assert any("'own" in x for x in got)
    held_against_brute(spark, rows, min_docs=1, top=3)


def test_defined_cases(spark):
    """Nulls, blank texts, sources without terms, languages with one source or without kept terms, repeated rows, a long text."""
    rows = [("alpha beta", "en", "a")] * 12 + [(None, "en", "empty"), ("", "en", None), ("123 !!", None, None), ("alpha", None, "x"), ("rare", "la", "a"), ("word", "la", "b"), ("alone " * 3, "one", "s")]
    rows += [("Beta " * 400_000, "en", "long")]
    got = held_against_brute(spark, rows)
    assert "('la', 'a', 'pair', 'b', 0, 1)" in got and not any("'one'" in x for x in got)
    assert "('', '', 'pair', 'x', 0, 1)" in got


def test_empty_and_clashing(spark, docs, odd, empty):
    assert source_audit.audit(empty).count() == 0
    extra = odd.selectExpr("*", "'odd' AS term", "'odd' AS n", "'odd' AS d", "'odd' AS counts", "'odd' AS sources", "'odd' AS c", "'odd' AS p", "'odd' AS v")
    assert rows_of(source_audit.audit(extra, 2)) == rows_of(source_audit.audit(docs, 2))
    want = source_audit.brute_force([(r["text"], r["lang"], r["source"]) for r in docs.collect()], 2)
    assert rows_of(source_audit.audit(docs, 2)) == sorted(map(repr, want))


def test_counts_of_trillions_stay_exact(spark):
    got = spark.sql(f"SELECT {source_audit.share('c', 'n', 'v')} AS p FROM VALUES (7000000000123L, 90000000000457L, 1000000007L) AS t(c, n, v)")
    assert got.first()["p"] == 1 + 10**9 * (7000000000123 + 2) // (90000000000457 + 2 * 1000000007)
