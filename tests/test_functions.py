"""Exact cases of the column functions, and properties over random texts."""

import random

import pytest
from pyspark.sql import functions as F

from rulemill.functions import abstraction, keys, normalize
from rulemill.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("CUSTOMER-STATUS IS EQUAL TO 'A'", "CUSTOMER-STATUS = <S>"),
        ("WS-COUNT IS GREATER THAN 100", "WS-COUNT > <N>"),
        ("A = ZEROS AND B = SPACES", "A = <ZERO> AND B = <SPACE>"),
        ("WS-FIELD-01 = 1", "WS-FIELD-01 = <N>"),
        ("X = 1 *> this is a comment", "X = <N>"),
        ("x is not equal to -1.5", "X <> <N>"),
        ("  ", None),
        (None, None),
        ("A = \"O'BRIEN\"", "A = <S>"),
    ],
)
def test_predicates(spark, text, want):
    assert one(spark, normalize.norm_predicate, text) == want


@pytest.mark.parametrize(
    ("text", "want", "count"),
    [
        ("MOVE 'B' TO RESULT-CODE", "MOVE <S> TO RESULT-CODE", 1),
        ("CONTINUE", "CONTINUE", 0),
        ("continue.", "CONTINUE", 0),
        ('DISPLAY "EXEC_BLOCK_STUB". MOVE 1 TO A', "EXEC_BLOCK_STUB MOVE <N> TO A", 2),
        ("CONTINUE MOVE 1 TO A", "MOVE <N> TO A", 1),
        ('DISPLAY "COPY_STUB"', None, 0),
        ("MOVE 5 TO X PERFORM Y DISPLAY 'Z'", "MOVE <N> TO X PERFORM Y DISPLAY <S>", 3),
    ],
)
def test_actions(spark, text, want, count):
    assert one(spark, normalize.norm_action, text) == want
    assert one(spark, lambda c: normalize.statement_count(normalize.norm_action(c)), text) == count


def rule_rows(spark, rows):
    names = "rule_type string, condition_text string, subject_text string, when_text string, then_text string, else_text string"
    return keyed(spark.createDataFrame(rows, names))


def keyed(df):
    return abstraction.with_abstract_key(keys.with_canonical_key(normalize.normalize_rules(df)))


def test_rules(spark):
    rows = [
        ("IF", "X = 5 OR Y = 10 AND Z NOT = 3", None, None, "MOVE 5 TO X PERFORM Y DISPLAY 'Z'", None),
        ("EVALUATE", None, "SQLCODE", "SQLCODE = 0", "PERFORM OK-ROUTINE", None),
        ("EVALUATE", None, "SQLCODE", "OTHER", None, None),
        (None, "A = 5 AND B > 5", None, None, "MOVE A TO C", "MOVE B TO C"),
    ]
    a, b, c, d = rule_rows(spark, rows).collect()
    assert (a["then_stmt_count"], a["complexity_score"], a["has_else"]) == (3, 5, False)
    assert (b["subject_norm"], b["when_norm"], b["condition_norm"]) == ("SQLCODE", "SQLCODE = <N>", "SQLCODE = <N>")
    assert b["abstract_predicate"] == "VAR1 | WHEN | VAR1 = <N>"
    assert (c["condition_norm"], c["when_norm"], c["complexity_score"]) == ("OTHER", "OTHER", 1)
    assert (d["kind"], d["has_else"], d["else_stmt_count"]) == ("IF", True, 1)
    assert (d["abstract_predicate"], d["abstract_then"], d["abstract_else"]) == ("VAR1 = <N> AND VAR2 > <N>", "MOVE VAR1 TO VAR3", "MOVE VAR2 TO VAR3")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("CUSTOMER-STATUS = <S>", "VAR1 = <S>"),
        ("MOVE <S> TO RESULT-CODE", "MOVE <S> TO VAR1"),
        ("WS-A = WS-B AND WS-A > <N>", "VAR1 = VAR2 AND VAR1 > <N>"),
        ("MOVE", "MOVE"),
        ("F ( A , B )", "VAR1 (VAR2, VAR3)"),
        (None, None),
        (" ", None),
    ],
)
def test_abstraction(spark, text, want):
    df = spark.createDataFrame([(text,)], "c string")
    assert abstraction.with_abstract_parts(df, {"x": F.col("c")}).first()["x"] == want


def test_known_key(spark):
    f = lambda k, p, t: keys.canonical_key(k, p, t, F.lit(None).cast("string"), F.lit(False))
    assert one(spark, f, "IF", "VAR1 NOT = <S>", "DISPLAY <S> GOBACK") == "5ac8558943e0b86e647b3e797d6bef8f13731859de5202ebffcc249a1e41d893"


def test_keys_ignore_names_and_spacing(spark):
    rows = [("IF", "A  = 1", None, None, "MOVE A TO B", None), ("IF", "X-1 = 22", None, None, "MOVE X-1  TO Y", None)]
    a, b = rule_rows(spark, rows).collect()
    assert a["abstract_canonical_key"] == b["abstract_canonical_key"]
    assert a["canonical_key"] != b["canonical_key"]


def test_normalisation_is_idempotent(spark):
    rng = random.Random(4)
    words = ["A", "WS-1", "=", "IS", "EQUAL", "TO", "12", "'x'", "ZEROS", "AND", "NOT", "SPACES", "-3.5", '"q"', "<N>", "<SPACE>"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(1, 9))),) for _ in range(200)]
    df = spark.createDataFrame(rows, "c string").select(normalize.norm_predicate(F.col("c")).alias("x"))
    assert df.filter(~normalize.norm_predicate(F.col("x")).eqNullSafe(F.col("x"))).count() == 0


def test_text_functions(spark):
    assert one(spark, T.normalize_eol_tabs, "a\r\nb\rc\td") == "a\nb\nc    d"
    assert one(spark, T.normalize_characters, "“x” ‘y’ WS_FIELD@") == "\"x\" 'y' WS-FIELD "
    assert one(spark, T.drop_reference_modification, "WS-NAME(1:5)") == "WS-NAME"
    assert one(spark, T.drop_subscripts, "IF (A = 1) MOVE T(I) TO B") == "IF (A = 1) MOVE T TO B"
    assert one(spark, lambda c: T.drop_subscripts(c, True), "IF (A = 1) MOVE B") == "IF MOVE B"
    assert one(spark, T.assign_dynamic, "ASSIGN TO DYNAMIC WS-F") == "ASSIGN TO WS-F"
    assert one(spark, T.final_period, "A\n\n\n\nB  ") == "A\n\nB."
    assert one(spark, T.is_copybook, "* x\n000100 01 A.") is True
    assert one(spark, T.is_copybook, "PROGRAM-ID. X.\n01 A.") is False
    assert one(spark, lambda c: T.ellipsis(c, 5), "abcdefg") == "ab..."
    assert one(spark, lambda c: T.error_snippet(c, F.lit(2), 1), "a\nb\nc\nd") == "    1 | a\n    2 | b\n    3 | c"
    assert one(spark, T.system_name, "a.cbl") == "unknown"
    assert one(spark, T.guard_blank, " ")["reason"] == "raw blank"


def test_copybook_lines_and_headers(spark):
    assert one(spark, T.is_copybook, "a\n" * 7 + "* b\n\n05 C.") is True
    assert one(spark, T.is_copybook, "a\n" * 8 + "05 C.") is False
    assert one(spark, T.is_copybook, "01 A.\n" + "a\n" * 9 + "id division.") is False
    assert one(spark, lambda c: T.is_copybook(c, ("PROCEDURE DIVISION",), 1), "* n\n01 A.\nid division.") is True
    assert one(spark, lambda c: T.is_copybook(c, first=1), "* n\na\n05 C.") is False
    assert one(spark, T.weak_signal, "working-storage section") is False
    assert one(spark, lambda c: T.weak_signal(c, ("DIVISION.",)), "working-storage section") is True
