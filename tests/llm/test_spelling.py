"""Spelling variants against comparing each word with every other, and the defined cases."""

import random

import pytest

from rulemill.llm import spelling

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select(*COLUMNS).collect())


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def crowded(seed: int) -> list[tuple]:
    """Words over three letters, so that nearly all blocks are crowded and words have many near ones; counts that tie."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abé", k=rng.choice([5, 5, 6, 6, 7, 8, 9]))) for _ in range(120)]
    words += ["abcdefgh" * k for k in (1, 2, 9)] + ["abcdefgh" * 9 + "x", "aaaaa", "aaaaaa", "aaaaaaa", "aaaaaaaa"]
    return [(i, " ".join(rng.choice(words) for _ in range(40)) + " ÀÉabc×÷Straße") for i in range(60)]


@pytest.mark.parametrize("block_words", [1, 3, 40, 512])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed, block_words):
    rows = crowded(seed)
    got = rows_of(spelling.variants(documents(spark, rows), every=7, block_words=block_words))
    assert got == sorted(map(repr, spelling.brute_force(rows, every=7)))
    assert any("None" not in x for x in got)


def test_blocks_never_exceed_the_alphabet(spark):
    """All words with one prefix and one suffix: subdivision ends with one free place."""
    rows = [(i, " ".join(f"prefix{a}{b}suffix" for a in "abcdefghij" for b in "abcdefghij")) for i in range(3)]
    dictionary = spelling.words(documents(spark, rows), every=10**9)
    sizes = [r["count"] for r in spelling.blocks(dictionary, 5).groupBy("key").count().collect()]
    assert max(sizes) <= 11
    got = {r["n_near"] for r in spelling.variants(documents(spark, rows), every=10**9, block_words=5).collect()}
    assert got == {18}


def test_chains_of_forms_lead_to_their_end(spark):
    chain = [("wordaaaaa", 3), ("wordbaaaa", 6), ("wordbbaaa", 12), ("wordbbbaa", 24), ("wordbbbba", 48), ("wordbbbbb", 96)]
    rows = [(0, " ".join(w for w, n in chain for _ in range(n)))]
    got = {r["word"]: r for r in spelling.variants(documents(spark, rows), every=10**9).collect()}
    assert {r["root"] for r in got.values()} == {"wordbbbbb"} and got["wordbbbbb"]["form"] is None
    assert [got[w]["form_n"] for w, _ in chain] == [6, 12, 24, 48, 96, None]


def test_defined_cases(spark):
    """Nulls, blanks, a null id, repeated rows, runs of one letter, a text of two million letters and a run of thousands."""
    rows = [(1, None), (2, ""), (3, " \t1 2"), (None, "hello Hello HELLO hella"), (4, "hello hella a b c")] * 3
    rows += [(5, "hellos " * 300_000 + "z" * 5000), (5, "z" * 5000), (6, "z" * 4999 + " " + "z" * 5000), (6, "z" * 4999), (7, "z" * 4999)]
    got = rows_of(spelling.variants(documents(spark, rows)))
    assert got == sorted(map(repr, spelling.brute_force(rows)))
    assert any("'hello'" in x for x in got)


def test_empty_and_clashing(docs, odd, empty):
    assert spelling.variants(empty).count() == 0
    extra = odd.selectExpr("*", "'odd' AS run", "'odd' AS word", "'odd' AS n", "'odd' AS h", "'odd' AS m", "'odd' AS kind")
    assert rows_of(spelling.variants(extra)) == rows_of(spelling.variants(docs))
    want = spelling.brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows_of(spelling.variants(docs)) == sorted(map(repr, want))
