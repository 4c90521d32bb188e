"""Tables that are brought up to date in place: what is rewritten, what stays, and what a broken write leaves."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from rulemill.operators import incremental, rules
from rulemill.sources import manifest
from rulemill.sources.buckets import Buckets

SCHEMA = "program_id long, line int, text string"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(df):
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


@pytest.fixture
def table(spark, tmp_path):
    t = Buckets(spark, str(tmp_path / "t"), "program_id", 8)
    t.write(spark.createDataFrame([(p, k, f"{p}.{k}") for p in range(40) for k in range(3)] + [(None, 0, "none")], SCHEMA))
    return t


def test_only_the_bucket_of_a_program_is_rewritten(spark, table):
    before = files(table.path)
    b = table.touched(spark.createDataFrame([(7,)], "program_id long"))
    assert table.replace(spark.createDataFrame([(7, 9, "again")], SCHEMA), spark.createDataFrame([(7,)], "program_id long")) == b
    after = files(table.path)
    own = lambda x: {f for f in x if f"bucket={b[0]}/" in f}
    assert before - own(before) == after - own(after) and not own(before) & own(after)
    got = table.read().collect()
    assert [tuple(r) for r in got if r["program_id"] == 7] == [(7, 9, "again")] and len(got) == 121 - 3 + 1


def test_programs_without_rows_and_emptied_buckets(spark, table):
    every = spark.createDataFrame([*[(p,) for p in range(40)], (None,)], "program_id long")
    assert table.replace(spark.createDataFrame([], SCHEMA), every.filter("program_id IS NULL")) and table.read().count() == 120
    table.replace(spark.createDataFrame([(1, 1, "only")], SCHEMA), every)
    assert [tuple(r) for r in table.read().collect()] == [(1, 1, "only")]
    assert len({os.path.dirname(f) for f in files(table.path)}) == 1


def test_a_broken_write_leaves_the_old_rows(spark, table):
    before, names = rows_of(table.read()), files(table.path)
    new = spark.createDataFrame([(p, 0, "x") for p in range(40)], SCHEMA).withColumn("text", F.when(F.col("program_id") == 39, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        table.replace(new, spark.range(40).toDF("program_id"))
    assert rows_of(table.read()) == before and files(table.path) == names


def test_only_named_buckets_are_listed(table):
    plan = table.read([1, 3])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[bucket#\d+ IN \(1,3\)\]", plan)


def raw(rng, n):
    kinds = ["IF A = {0}", "B > {0} AND C = 1", "NOT D", ""]
    return [(rng.choice(["IF", "EVALUATE"]), rng.choice(kinds).format(rng.randint(0, 3)) or None, "S", "OTHER", rng.choice(["MOVE 1 TO A", "STOP RUN", "PERFORM P-1", None]), rng.choice([None, "GOBACK"])) for _ in range(n)]


def test_weights_stand_for_rows(spark, tmp_path):
    """Rows counted before the text work give the same table as each row on its own."""
    rng = random.Random(4)
    schema = ", ".join(f"{c} string" for c in rules.RULE_COLUMNS)
    base, added = raw(rng, 80), raw(rng, 20)
    frame = lambda xs: spark.createDataFrame(xs, schema)
    table = incremental.canonical(spark, str(tmp_path / "m"), 4)
    table.rebuild(rules.keyed_distinct(frame(base)), "weight")
    table.apply(rules.keyed_distinct(frame(added)), rules.keyed_distinct(frame(base[:30])), "weight")
    assert rows_of(table.read()) == rows_of(rules.canonical(rules.keyed(frame(base[30:] + added))))


@pytest.mark.parametrize("level", ["canonical", "abstract"])
def test_merged_tables_equal_rebuilt_ones(spark, tmp_path, level):
    rng = random.Random(1)
    schema = ", ".join(f"{c} string" for c in rules.RULE_COLUMNS)
    keyed = lambda xs: rules.keyed(spark.createDataFrame(xs, schema))
    have = raw(rng, 120)
    table = getattr(incremental, level)(spark, str(tmp_path / "m"), 8)
    table.rebuild(keyed(have))
    for step in range(3):
        removed = rng.sample(have, 40) if step < 2 else list(have)
        added = raw(rng, 30) if step < 2 else []
        for x in removed:
            have.remove(x)
        have += added
        buckets = table.apply(keyed(added), keyed([*removed, *removed[:1], ("IF", "NEVER = 1", None, None, "NOTHING", None)]) if step == 2 else keyed(removed))
        assert buckets
        want = getattr(rules, level)(keyed(have))
        assert rows_of(table.read()) == rows_of(want)
    assert table.read().count() == 0 and table.apply(keyed([]), keyed([])) == []


def test_a_delta_reads_its_buckets_only(spark, tmp_path):
    schema = ", ".join(f"{c} string" for c in rules.RULE_COLUMNS)
    table = incremental.canonical(spark, str(tmp_path / "m"), 16)
    table.rebuild(rules.keyed(spark.createDataFrame(raw(random.Random(2), 200), schema)))
    before = files(tmp_path)
    one = rules.keyed(spark.createDataFrame(raw(random.Random(3), 1), schema))
    delta = incremental.counted(one, "canonical_key", incremental.CANONICAL)
    plan = table.plan(delta, [4])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = 4", plan)
    (b,) = table.apply(one, one.filter("false"))
    assert all(f"bucket={b}/" in f for f in before ^ files(tmp_path))


def test_import_reads_new_and_changed_files_only(spark, tmp_path):
    """An unchanged manifest row is believed: what stands in its file now is not read."""
    folder = tmp_path / "corpus" / "genapp" / "sub"
    folder.mkdir(parents=True)
    for name in "abcd":
        (folder / f"{name}.cbl").write_text(f"old {name}")
    (folder / "x.txt").write_text("no source")
    work = manifest.Import(spark, str(tmp_path / "corpus"), str(tmp_path / "out"))
    assert work.update() == {"new": 4}
    content = lambda: {r["path"][-5]: bytes(r["content"]).decode() for r in work.programs().collect()}
    assert content() == {x: f"old {x}" for x in "abcd"}
    seen = os.stat(folder / "a.cbl")
    (folder / "a.cbl").write_text("NEW a")
    os.utime(folder / "a.cbl", ns=(seen.st_atime_ns, seen.st_mtime_ns))
    (folder / "b.cbl").write_text("longer than before")
    (folder / "c.cbl").unlink()
    (folder / "e.cbl").write_text("new e")
    assert work.update() == {"same": 2, "changed": 1, "vanished": 1, "new": 1}
    assert content() == {"a": "old a", "b": "longer than before", "d": "old d", "e": "new e"}
    before = files(tmp_path / "out" / "programs")
    assert work.update() == {"same": 4} and files(tmp_path / "out" / "programs") == before
    assert manifest.Import(spark, str(tmp_path / "none"), str(tmp_path / "out2")).update() == {}


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "genapp").mkdir()
    (tmp_path / "genapp" / "a.cbl").write_text("x")
    plan = manifest.listed(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]
