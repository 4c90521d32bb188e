"""Relational, audit, label and report operators, with nulls and empty tables."""

import json

import pytest

from rulemill.operators import audit, labels, relational, reports
from rulemill.schemas import METRIC


def test_relational(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    assert [tuple(r) for r in relational.duplicates(df, ["k"]).collect()] == [(1, 2)]
    assert relational.mixed_keys(df, ["k"], ["v"]).count() == 1
    assert relational.missing(df, df.filter("k = 1"), ["k"]).count() == 1
    assert relational.upsert(df, df.filter("k = 2"), ["k"]).count() == 3
    assert relational.insert_missing(df.filter("k = 1"), df, ["k"]).count() == 3
    assert relational.differs(df, spark.createDataFrame([(2, None)], "k int, w string"), ["k"], "v", "w").count() == 2
    assert {r["k"]: r["pct"] for r in relational.share_of_total(df, ["k"]).collect()} == {1: 66.67, 2: 33.33}
    assert relational.exists_by(df, "v", "A", ignore_case=True) and not relational.exists_by(df, "v", "A")
    assert relational.delete_by(df, "v", "a").count() == 2
    empty = df.filter("false")
    assert relational.share_of_total(empty, ["k"]).count() == 0 and relational.top_k(empty, ["k"], ["v"], 2).count() == 0


def test_shares_round_away_from_zero(spark):
    df = spark.range(1).selectExpr("1.005D AS a", "2.675D AS b")
    assert tuple(df.select(*[relational.exact2(df[c]) for c in "ab"]).first()) == (1.01, 2.68)


def test_kappa(spark):
    rows = [(s, e, "f1", r) for s, (a, b) in enumerate([(1, 1), (2, 3), (5, 5), (4, 2), (3, 3)]) for e, r in (("E1", a), ("E2", b))]
    got = reports.kappa_pairs(spark.createDataFrame(rows, "sample_no int, evaluator string, question string, rating int")).first()
    po = sum(1 - abs(a - b) / 4 for a, b in [(1, 1), (2, 3), (5, 5), (4, 2), (3, 3)]) / 5
    pe = sum((1 - abs(a - b) / 4) for a in (1, 2, 5, 4, 3) for b in (1, 3, 5, 2, 3)) / 25
    assert got["kappa"] == pytest.approx((po - pe) / (1 - pe))


def test_stability(spark):
    run = lambda *v: spark.createDataFrame(list(enumerate(v)), "k int, p string")
    got = reports.stability([run("a", "b", "c"), run("a", "b", "x"), run("a", "y", "x")], "k", "p").first()
    assert (got["total"], got["r1_r2"], got["r1_r3"], got["r2_r3"], got["all_runs"], got["pct_all_runs"]) == (3, 2, 1, 2, 1, 33.33)


def test_ratings(spark):
    raw = spark.createDataFrame([(" 1 ", "E1", "x", "5", "5", "4", "5", "4,75", " "), ("31", "E9", "", "6", "x", "4", "5", "1", "k")], "sample_no string, evaluator string, erfahrung string, f1 string, f2 string, f3 string, f4 string, mittelwert string, kommentar string")
    typed = relational.typed_ratings(raw)
    assert typed.first()["sample_no"] == 1 and float(typed.first()["mittelwert"]) == 4.75 and typed.first()["kommentar"] is None
    assert [r["broken"] for r in relational.rating_violations(typed).collect()] == ["sample_no"]
    assert reports.mean_mismatches(typed).count() == 1


def test_audit_on_nothing(spark):
    norm = spark.createDataFrame([], "kind string, condition_norm string, subject_norm string, when_norm string, then_norm string, else_norm string, has_else boolean, canonical_key string")
    assert {r["status"] for r in audit.normalized(norm).collect()} == {"OK"}
    assert {r["status"] for r in audit.battery(norm).collect()} == {audit.CALM}
    metrics = spark.createDataFrame([], METRIC)
    assert audit.unfinished_steps(metrics).first()["status"] == "OK" and reports.runtimes(metrics).count() == 0


def test_audit_finds(spark):
    names = "kind string, condition_norm string, subject_norm string, when_norm string, then_norm string, else_norm string, has_else boolean, canonical_key string"
    rows = [("IF", "A = <N", None, None, "X COPY Y", None, True, None), ("EVALUATE", "B", "S", "MOVE X", "EXEC_BLOCK_STUBX", " ", False, "k")]
    got = {r["check_id"]: r["violations"] for r in audit.normalized(spark.createDataFrame(rows, names)).collect()}
    assert got == {"C-15": 1, "C-16": 0, "C-17": 0, "C-18": 1, "C-19": 1, "C-20": 0, "C-21": 1, "C-22": 0, "C-27": 1}


def test_parse_audit(spark):
    programs = spark.createDataFrame([(1,), (2,)], "program_id long")
    results = spark.createDataFrame([(1, "VALID"), (1, "VALID")], "program_id long, status string")
    assert {r["check_id"]: r["violations"] for r in audit.parse_results(programs, results).collect()} == {"C-01": 0, "C-02": 1, "C-03": 1}


PATTERNS = "abstract_canonical_key string, kind string, has_else boolean, abstract_predicate string, abstract_then string, abstract_else string, occurrences long"


def patterns(spark):
    return spark.createDataFrame([("k1", "IF", False, "VAR1 = <N>", "PERFORM VAR2", None, 3), ("k2", "IF", True, "VAR1 = <N>", "MOVE <N> TO VAR1", None, 2), ("k3", "IF", False, "VAR1 = <S>", "DISPLAY <S>", None, 1)], PATTERNS)


def excerpts(spark):
    return spark.createDataFrame([(k, 1, f"IF A = {k}") for k in ("k1", "k2", "k3")], "abstract_canonical_key string, rank int, raw_snippet string")


def test_labels(spark):
    got, rejected = labels.label(patterns(spark), excerpts(spark))
    assert {r["abstract_canonical_key"]: r["pattern"] for r in got.collect()} == {"k1": "CONTROL_FLOW_TEMPLATE", "k3": "IDIOM_PATTERN"}
    assert [tuple(r) for r in rejected.collect()] == [("k2", "missing else")]
    again, _ = labels.label(patterns(spark), excerpts(spark), done=got)
    assert again.count() == 0


def test_guardrails_retry_then_reject(spark):
    def careless(row):
        fixed = "Correct this" in row["prompt"] and row["abstract_canonical_key"] == "k1"
        return json.dumps({"output": [{"content": [{"text": json.dumps({"title": "Fine" if fixed else "Uses VAR1", "rule_summary": "s", "pattern": "OTHER", "confidence": 1})}]}]})

    got, rejected = labels.label(patterns(spark), excerpts(spark), labeler=careless)
    assert [r["abstract_canonical_key"] for r in got.collect()] == ["k1"]
    assert dict(map(tuple, rejected.collect())) == {"k2": "missing else", "k3": "internal tokens"}


def test_transient_errors_are_tried_again():
    seen = []

    def flaky(row):
        seen.append(1)
        if len(seen) < 3:
            raise labels.TransientError
        return "ok"

    assert labels.call(flaky, {}, pause=0) == "ok" and len(seen) == 3
    seen.clear()
    assert labels.call(lambda r: (_ for _ in ()).throw(labels.TransientError()), {}, pause=0) is None


def test_one_pass_audits_find_what_they_look_for(spark):
    """Against the checks taken one by one over rows with a broken key, a mixed one, rows without keys and bad abstract texts."""
    rows = [("a" * 64, "IF", True, "b" * 64, "VAR1 = <N>", "x", None, 2), ("a" * 64, "EVALUATE", True, "b" * 64, "VAR1 = <N>", "x", None, 3), ("short", "IF", False, "c" * 64, " ", "x", None, 1), (None, "IF", False, None, None, None, None, 7), ("d" * 64, "IF", False, "e" * 64, "VAR = 1", "x", None, 4)]
    df = spark.createDataFrame(rows, "canonical_key string, kind string, has_else boolean, abstract_canonical_key string, abstract_predicate string, abstract_then string, abstract_else string, weight long")
    got = lambda x: {r["check_id"]: (r["violations"], r["status"]) for r in x.collect()}
    assert got(audit.canonical_stage(df, "weight")) == {"C-24": (1, "FAIL"), "C-25": (0, "OK"), "C-26": (0, "OK"), "C-28": (1, "FAIL")}
    assert got(audit.abstract_stage(df, "weight")) == {"C-29": (0, "OK"), "C-30": (0, "OK"), "C-31": (1, "FAIL"), "C-32": (1, "FAIL"), "C-33": (0, "OK")}
    assert got(audit.canonical_stage(df)) == got(audit.canonical_stage(df, "weight"))
    assert {v for v, _ in got(audit.abstract_stage(df.filter("false"))).values()} == {0}
    plan = audit.abstract_stage(df, "weight")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange") <= 4 and "NestedLoop" not in plan
