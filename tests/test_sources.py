"""Cleaning, parsing and the whole rule pipeline over small source files."""

import os

import pytest

from rulemill.operators import cleaning, parse_stage, rules, structure
from rulemill.plans.pipeline import Pipeline
from rulemill.sources import corpus
from rulemill.streaming import incremental

HEAD = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. DEMO.\n       PROCEDURE DIVISION.\n"
BODY = """           IF WS-STATUS = "A"
              MOVE 1 TO WS-X
           ELSE
              DISPLAY "NO" *> a note
           END-IF.
           EVALUATE WS-CODE
              WHEN 1
              WHEN 2 PERFORM P-1
              WHEN OTHER MOVE 0 TO WS-X
           END-EVALUATE.
"""


def code(body: str) -> str:
    return cleaning.clean(HEAD + body).content


@pytest.mark.parametrize("raw", [None, "", "  \n "])
def test_blank(raw):
    got = cleaning.clean(raw)
    assert (got.content, got.looks_foreign, got.reason) == ("", False, "raw blank")


def test_cleaning_cases():
    assert cleaning.clean("This is an English sentence without code").reason == "Weak COBOL signal"
    assert cleaning.clean("<html> PROCEDURE DIVISION program words").reason == "Looks like HTML"
    assert "\r" not in cleaning.clean(HEAD + "           MOVE 1 TO A\r\n").content
    assert code("           MOVE 1 TO A").endswith("TO A.")
    sql = code("           EXEC SQL\n              SELECT X FROM T\n           END-EXEC.\n           MOVE 1 TO A.\n")
    assert 'DISPLAY "EXEC_BLOCK_STUB".' in sql and "SELECT" not in sql and "MOVE 1 TO A" in sql
    copy = code("           COPY BOOK1.\n           MOVE 1 TO COPY-STATUS.\n")
    assert "CONTINUE." in copy and "BOOK1" not in copy and "MOVE 1 TO COPY-STATUS" in copy
    assert "," not in code("           ADD A, B, C GIVING D.\n")
    assert ".." not in code('           DISPLAY "X"..\n')
    numbered = "".join(f"{n:06d} {x}\n" for n, x in ((100, "IDENTIFICATION DIVISION."), (200, "PROGRAM-ID. D."), (300, "PROCEDURE DIVISION."), (400, "MOVE 1 TO A.")))
    got = cleaning.clean(numbered + "000150* a comment\n").content
    assert "000100" not in got and "comment" not in got and "MOVE 1 TO A" in got
    assert "PROCESS-ORDER" in code("       PROCESS-ORDER.\n") and "PROCESS-ORDER" not in cleaning.clean(HEAD + "       PROCESS-ORDER.\n", parity=True).content


def test_continuation():
    assert cleaning.join_continuation('MOVE "AB', '   "CD" TO X') == 'MOVE "ABCD" TO X'
    assert cleaning.join_continuation("MOVE A", "   TO X") == "MOVE A TO X"


@pytest.mark.parametrize(
    ("source", "status"),
    [
        (b"\xff\xfe", "IO_ERROR"),
        (b"      * only a comment\n", "EMPTY_AFTER_CLEAN"),
        (b"       01 A.\n          05 B PIC X.\n", "SKIPPED_COPYBOOK"),
        (b"       IDENTIFICATION DIVISION.\n       FUNCTION-ID. F.\n", "SKIPPED_FUNCTION_UNIT"),
        ((HEAD + BODY).encode(), "VALID"),
        ((HEAD + "           END-IF.\n").encode(), "PARSER_ERROR"),
        ((HEAD + '           DISPLAY "X.\n').encode(), "LEXER_ERROR"),
        (b"", "EMPTY_AFTER_CLEAN"),
        (None, "EMPTY_AFTER_CLEAN"),
    ],
)
def test_status(source, status):
    got = parse_stage.parse_source(source)
    assert got["status"] == status
    assert (got["candidates"] == []) == (status != "VALID")


def test_procedure_only_fallback():
    got = parse_stage.parse_source(b"       IDENTIFICATION DIVISION.\n       ENVIRONMENT DIVISION. ELSE.\n       PROCEDURE DIVISION.\n           IF A = 1 MOVE 1 TO B.\n")
    assert (got["status"], got["parse_mode"], len(got["rules"])) == ("VALID", "PROCEDURE_ONLY", 1)


def test_extraction():
    got = parse_stage.parse_source((HEAD + BODY).encode())
    assert [c["kind"] for c in got["candidates"]] == ["IF", "EVALUATE"]
    first, one, two, other = got["rules"]
    assert (first["condition_text"], first["then_text"], first["else_text"]) == ('WS-STATUS = "A"', "MOVE 1 TO WS-X", 'DISPLAY "NO"')
    assert (one["when_text"], one["then_text"], one["end_line"]) == ("WS-CODE = 1", "PERFORM P-1", two["end_line"])
    assert (other["when_text"], other["is_when_other"], other["when_index"]) == ("OTHER", True, 2)
    assert all(r["raw_snippet"] for r in got["rules"])


def test_nesting_and_periods():
    text = code("           IF A = 1 IF B = 2 MOVE 1 TO C ELSE MOVE 2 TO C END-IF\n           ELSE MOVE 3 TO C.\n           IF D = 1 NEXT SENTENCE ELSE GO TO X.\n")
    rules_ = structure.extract(text, "FULL")[1]
    assert [r["condition_text"] for r in rules_] == ["A = 1", "B = 2", "D = 1"]
    assert [r["else_text"] for r in rules_] == ["MOVE 3 TO C", "MOVE 2 TO C", "GO TO X"]


def test_helpers():
    assert structure.split_also("A ALSO B ALSO C") == ["A", "B", "C"] and structure.split_also(None) == []
    assert structure.build_predicate(["S1", "S2"], ["W1", "W2"], False) == "S1 = W1 AND S2 = W2"
    assert structure.build_predicate([], ["W"], False) is None
    assert structure.build_predicate(["TRUE"], ["A > 1"], True) == "A > 1"
    assert structure.strip_comment("MOVE 1 TO X *> note") == "MOVE 1 TO X"
    assert structure.strip_comment('DISPLAY "EXEC BLOCK STUB"') == "EXEC_BLOCK_STUB"
    assert structure.context_snippet("WS-X", "WHEN OTHER A") == "EVALUATE WS-X\n    WHEN OTHER A\nEND-EVALUATE"
    assert structure.context_snippet(None, "B") == "B" and structure.context_snippet("X", " ") is None


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "src/x-cobol/shop").mkdir(parents=True)
    (tmp_path / "src/x-cobol/shop/A.CBL").write_text(HEAD + BODY)
    (tmp_path / "src/x-cobol/shop/b.cob").write_text(HEAD + BODY.replace("WS-", "XX-"))
    (tmp_path / "src/x-cobol/shop/c.cpy").write_text("       01 A.\n")
    (tmp_path / "src/x-cobol/shop/d.cbl").write_bytes(b"\xff\xfe")
    return tmp_path


def test_pipeline(spark, tree):
    p = Pipeline(spark, str(tree / "src"), str(tree / "out"))
    steps = {r["step_name"]: r for r in p.run().collect()}
    assert {r["batch_status"] for r in steps.values()} == {"COMPLETED"} and steps["programs"]["write_count"] == 3
    assert {r["status"] for r in p.table("parse_results").collect()} == {"VALID", "IO_ERROR"}
    assert p.table("extracted").count() == 8 and p.table("canonical").count() == 6 and p.table("abstract").count() == 3
    assert p.table("abstract").agg({"occurrences": "sum"}).first()[0] == 8
    assert p.table("labels").count() + p.table("rejected").count() == 3
    assert rules.kind_summary(p.table("candidates")).first().asDict() == {"total": 4, "ifs": 2, "evaluates": 2}
    assert p.run(resume=True).count() == len(steps)  # nothing is done again
    (tree / "src/x-cobol/shop/e.cbl").write_text(HEAD + BODY)
    q = Pipeline(spark, str(tree / "src"), str(tree / "out"), import_mode="incremental")
    q.run(["programs"])
    assert q.table("programs").count() == 4


def test_missing_folders(spark, tmp_path):
    assert corpus.scan(spark, str(tmp_path)).count() == 0


def test_stream_takes_each_file_once(spark, tree):
    where = [str(tree / x) for x in ("parsed", "marks")]
    for _ in range(2):
        incremental.import_new(spark, str(tree / "src/x-cobol"), "XCOBOL", *where)
    assert spark.read.parquet(where[0]).count() == 3


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b",\nc'), ("2", None)], "k string, v string")
    corpus.write_csv(df, str(tmp_path / "x"), ["k"])
    assert sorted(os.listdir(tmp_path / "x"))
    assert [tuple(r) for r in corpus.read_csv(spark, str(tmp_path / "x")).orderBy("k").collect()] == [("1", 'a "b",\nc'), ("2", None)]
