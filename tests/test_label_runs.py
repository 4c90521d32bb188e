"""Labelling without paying twice, runs side by side, and what a failing step leaves."""

import json
import os
import sys
import time

import pytest
from pyspark import cloudpickle

from rulemill.operators import audit, exchange, labels, reports
from rulemill.plans.pipeline import Pipeline

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests
HEAD = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. P.\n       PROCEDURE DIVISION.\n"
BODY = "           IF WS-A = 1 MOVE 1 TO WS-B END-IF.\n           IF WS-C > 2 PERFORM P-1 ELSE STOP RUN END-IF.\n           IF WS-D NUMERIC DISPLAY WS-D END-IF.\n"


class Labeler:
    """Notes every call as a file in a folder; fails as it is told to."""

    def __init__(self, folder, kind="OTHER", flaky=False, deadly=None, slow=0.0):
        self.folder, self.kind, self.flaky, self.deadly, self.slow = str(folder), kind, flaky, deadly, slow
        os.makedirs(self.folder, exist_ok=True)

    def __call__(self, row):
        began = time.time()
        name = f"{self.folder}/{time.time_ns()}-{os.getpid()}-{id(row)}"
        if self.deadly and self.deadly in row["prompt"]:
            os._exit(1)
        time.sleep(self.slow)
        with open(name, "w") as f:
            json.dump({"prompt": row["prompt"], "began": began, "ended": time.time()}, f)
        if self.flaky and not os.path.exists(f"{self.folder}.passed"):
            open(f"{self.folder}.passed", "w").close()
            raise labels.TransientError("again")
        text = json.dumps({"title": "A title", "rule_summary": "Says so.", "pattern": self.kind, "confidence": 0.5})
        return json.dumps({"output": [{"type": "reasoning"}, {"content": [{"text": text}]}]})

    def calls(self):
        return [json.load(open(f"{self.folder}/{f}")) for f in sorted(os.listdir(self.folder))]


def asked(labeler):
    return sorted(c["prompt"] for c in labeler.calls())


def prompts(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, prompt string")


def test_equal_prompts_are_asked_once_and_answers_kept(spark, tmp_path):
    labeler = Labeler(tmp_path / "calls")
    make = lambda **kw: exchange.Exchange(spark, str(tmp_path / "answers"), labeler, pause=0.01, tasks=2, **kw)
    got = make(batch=3).ask(prompts(spark, ["a", "b", "a", "c", "d", "e", "f", "g"])).collect()
    assert len(got) == 8 and all(r["response"] for r in got) and asked(labeler) == [*"abcdefg"]
    assert make().ask(prompts(spark, ["a", "g", "h"])).count() == 3 and asked(labeler) == [*"abcdefgh"]
    # another attempt, run or model is another question
    make().ask(prompts(spark, ["a"]), 2)
    make(run_id="run_2").ask(prompts(spark, ["a"]))
    make(model="other").ask(prompts(spark, ["a"]))
    assert asked(labeler).count("a") == 4


def test_passing_failures_are_tried_again_and_others_not_stored(spark, tmp_path):
    labeler = Labeler(tmp_path / "calls", flaky=True)
    work = exchange.Exchange(spark, str(tmp_path / "answers"), labeler, pause=0.01, tasks=1, in_flight=1)
    assert work.ask(prompts(spark, ["a"])).first()["response"] and asked(labeler) == ["a", "a"]

    def refuses(row):
        raise ValueError(row)

    none = exchange.Exchange(spark, str(tmp_path / "answers"), refuses, tasks=1)
    assert none.ask(prompts(spark, ["b"])).first()["response"] is None and none.answers().count() == 1


def test_a_killed_run_is_taken_up(spark, tmp_path):
    texts = [f"prompt {k}" for k in range(40)]
    first = Labeler(tmp_path / "first", deadly="prompt 7")
    with pytest.raises(Exception):  # noqa: B017 - the worker is gone
        exchange.Exchange(spark, str(tmp_path / "answers"), first, tasks=1, batch=4, in_flight=1).ask(prompts(spark, texts))
    second = Labeler(tmp_path / "second")
    work = exchange.Exchange(spark, str(tmp_path / "answers"), second, tasks=1, batch=4, in_flight=1)
    kept = work.answers().count()
    assert work.ask(prompts(spark, texts)).filter("response IS NULL").count() == 0
    assert len(asked(second)) == 40 - kept and len(set(asked(second))) == 40 - kept


def test_calls_at_a_time_and_a_second_are_bounded(spark, tmp_path):
    labeler = Labeler(tmp_path / "calls", slow=0.05)
    began = time.time()
    exchange.Exchange(spark, str(tmp_path / "answers"), labeler, tasks=1, in_flight=3, per_second=20).ask(prompts(spark, [str(k) for k in range(20)]))
    calls = labeler.calls()
    at_once = max(sum(c["began"] <= x["began"] < c["ended"] for c in calls) for x in calls)
    assert at_once <= 3 and time.time() - began > 19 / 20


@pytest.fixture
def source(tmp_path):
    (tmp_path / "src/genapp").mkdir(parents=True)
    (tmp_path / "src/genapp/a.cbl").write_text(HEAD + BODY)
    return tmp_path


def test_runs_stand_side_by_side_and_ask_once(spark, source):
    out = str(source / "out")
    workers = {r: Labeler(source / r, kind) for r, kind in (("run_1", "OTHER"), ("run_2", "OTHER"), ("run_3", "IDIOM_PATTERN"))}
    for run, labeler in workers.items():
        Pipeline(spark, str(source / "src"), out, labeler=labeler, run_id=run, pause=0.01).run(resume=True)
    p = Pipeline(spark, str(source / "src"), out, labeler=workers["run_2"], run_id="run_2")
    assert {r["run_id"]: r["count"] for r in p.table("labels").groupBy("run_id").count().collect()} == dict.fromkeys(workers, 3)
    got = {(r["run_a"], r["run_b"]): (r["total"], r["agree"], r["pct"]) for r in reports.agreement(p.table("labels"), "abstract_canonical_key", "pattern").collect()}
    assert got == {("run_1", "run_2"): (3, 3, 100.0), ("run_1", "run_3"): (3, 0, 0.0), ("run_2", "run_3"): (3, 0, 0.0), (None, None): (3, 0, 0.0)}
    before = {r: asked(w) for r, w in workers.items()}
    assert all(len(x) == len(set(x)) == 3 for x in before.values())
    p.run(["labels"])  # the same run once more: nothing is asked, nothing is lost
    assert {r: asked(w) for r, w in workers.items()} == before and p.table("labels").count() == 9
    assert p.own("labels").count() == 3 and p.table("rejected").count() == 0


def test_a_failing_step_leaves_its_row(spark, source, monkeypatch):
    p = Pipeline(spark, str(source / "src"), str(source / "out"))
    monkeypatch.setattr(p, "_canonical", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        p.run()
    rows = {r["step_name"]: r["batch_status"] for r in p.table("metrics").collect()}
    assert rows["canonical"] == rows["Job"] == "FAILED" and rows["normalized"] == "COMPLETED" and "abstract" not in rows
    assert audit.unfinished_steps(p.table("metrics")).first()["violations"] > 0
    q = Pipeline(spark, str(source / "src"), str(source / "out"))
    assert {r["step_name"] for r in q.run(resume=True).collect()} == {"canonical", "abstract", "labels"}
    assert {r["batch_status"] for r in q.table("metrics").filter("step_name = 'Job'").collect()} == {"FAILED", "COMPLETED"}


def test_response_shapes(spark):
    label = json.dumps({"title": "t", "rule_summary": "s", "pattern": "OTHER", "confidence": 1})
    shapes = [
        ({"output_text": label}, "t"), ({"output": [{"content": [{"text": label}]}]}, "t"), ({"output": [{"type": "reasoning"}, {"content": [{"text": label}]}]}, "t"),
        ({"output": [{"content": [{"text": " "}, {"refusal": "x"}, {"text": label}]}]}, "t"), ({"output_text": " ", "output": [{"content": []}, {"content": [{"text": label}]}]}, "t"),
        ({"output_text": 3, "output": ["x", None, {"content": "y"}, {"content": [{"text": 4}, {"text": label}]}]}, "t"), ({"output": label}, None), ({}, None), ([], None),
    ]
    rows = [(k, json.dumps(s), w) for k, (s, w) in enumerate(shapes)] + [(99, "not json", None), (98, None, None)]
    df = spark.createDataFrame(rows, "k int, r string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", labels.parse_response(df["r"])["title"].alias("got")).collect())


def test_agreement_of_any_runs(spark):
    rows = [("r1", 1, "a"), ("r2", 1, "a"), ("r1", 2, "a"), ("r2", 2, None), ("r1", 3, "a"), ("r1", 4, "b"), ("r2", 4, "c"), ("r2", 4, "d")]
    got = [tuple(r) for r in reports.agreement(spark.createDataFrame(rows, "run_id string, k int, p string"), "k", "p").collect()]
    assert sorted(got, key=str) == [("r1", "r2", 2, 1, 50.0), (None, None, 2, 1, 50.0)]
    assert reports.agreement(spark.createDataFrame([], "run_id string, k int, p string"), "k", "p").count() == 0


def test_counts_are_those_of_the_tables(spark, source):
    (source / "src/genapp/bad.cbl").write_bytes(b"\xff")
    p = Pipeline(spark, str(source / "src"), str(source / "out"))
    for row in p.run().collect():
        assert row["write_count"] == p.own(row["step_name"]).count(), row
    metrics = {r["step_name"]: r for r in p.table("metrics").collect()}
    assert (metrics["candidates"]["read_count"], metrics["candidates"]["write_count"], metrics["candidates"]["filter_count"]) == (2, 3, 1)
    assert metrics["abstract"]["read_count"] == metrics["normalized"]["write_count"] and metrics["Job"]["write_count"] == sum(r["write_count"] for n, r in metrics.items() if n != "Job")


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_refreshed_programs_leave_what_a_whole_run_leaves(spark, source):
    folder = source / "src/genapp"
    for k in range(6):
        (folder / f"p{k}.cbl").write_text(HEAD + BODY.replace("WS-A = 1", f"WS-A = {k} OR WS-K{k} > 2"))
    p = Pipeline(spark, str(source / "src"), str(source / "out"), buckets=16)
    steps = ["programs", "parsed", "parse_results", "candidates", "extracted", "normalized", "canonical", "abstract"]
    p.run(steps)
    (folder / "p1.cbl").write_text(HEAD + "           IF NEW-1 = 2 GOBACK END-IF.\n")
    (folder / "p2.cbl").write_text(HEAD + "           END-IF.\n")
    changed = p._programs().filter("path LIKE '%p1.cbl' OR path LIKE '%p2.cbl'")
    before = files(source / "out/extracted")
    p.refresh(changed)
    touched = {f"bucket={b}/" for b in p.by_program("extracted").touched(changed.selectExpr("id AS program_id"))}
    assert all(any(t in f for t in touched) for f in before ^ files(source / "out/extracted")) and before & files(source / "out/extracted")
    q = Pipeline(spark, str(source / "src"), str(source / "whole"), buckets=16)
    q.run(steps)
    for name in steps[2:]:
        rows = lambda x: sorted(map(repr, map(tuple, x.select(*sorted(x.columns)).collect())))
        assert rows(p.table(name)) == rows(q.table(name)), name
    assert p.table("canonical").count() == q.table("canonical").count() > 3


def test_a_run_ends_beyond_its_skip_limit(spark, source, monkeypatch):
    from rulemill.operators import parse_stage
    from rulemill.plans.pipeline import SkipLimitError

    (source / "src/genapp/b.cbl").write_text(HEAD + BODY)
    steps = ["programs", "parsed", "parse_results"]

    def breaks(content, parity=False):
        raise RecursionError("too deep")

    monkeypatch.setattr(parse_stage, "parse_source", lambda c, parity=False, f=parse_stage.parse_source: f(c, parity) if c is None else breaks(c))
    for module in (parse_stage,):
        cloudpickle.register_pickle_by_value(module)
    try:
        with pytest.raises(SkipLimitError):
            Pipeline(spark, str(source / "src"), str(source / "out"), skip_limit=1).run(steps)
        p = Pipeline(spark, str(source / "src"), str(source / "out2"), skip_limit=2)
        got = {r["step_name"]: r["process_skip_count"] for r in p.run(steps).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(parse_stage)
    assert got == {"programs": 0, "parsed": 2, "parse_results": 0}
    assert {r["message"] for r in p.table("parse_results").collect()} == {"Unforeseen RecursionError: too deep"}
