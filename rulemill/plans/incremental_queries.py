"""Queries of tables that are brought up to date in place: replaced buckets, merged rebuilds, manifests; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental, reports, rules
from ..sources import manifest
from ..sources.buckets import Buckets, scratch
from .rule_queries import ABST, CANON, RULES_SRC, source
from .table_queries import read

_COUNT = 16


def _rules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rules; those that come (changed ones anew, others once more); those that go (removed ones, and changed ones as they were)."""
    every = source(spark, d)
    changed = every.filter("program_id % 7 = 1").withColumn("then_text", F.lit("STOP RUN."))
    return every, changed.unionByName(every.filter("program_id % 7 = 2")), every.filter("program_id % 7 IN (0, 1)")


def _merged(make, spark, d):
    # equal raw rules first, so that the text work sees each once
    every, added, removed = (rules.keyed_distinct(x) for x in _rules(spark, d))
    table = make(spark, scratch(spark), _COUNT)
    table.rebuild(every, "weight")
    table.apply(added, removed, "weight")
    return table.read()


def _replaced(spark, d):
    """Stage rows by program: programs of every fifth number extracted again, to one row each; of those behind them, to none."""
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("program_id"), F.col("l_linenumber").alias("start_line"), F.col("l_returnflag").alias("then_text"))
    table = Buckets(spark, scratch(spark), "program_id", _COUNT)
    table.write(rows)
    again = read(spark, d, "orders").select(F.col("o_orderkey").alias("program_id")).filter("program_id % 5 < 2")
    table.replace(again.filter("program_id % 5 = 0").select("program_id", F.lit(1).alias("start_line"), F.lit("again").alias("then_text")), again)
    return table.read()


def _changes(spark, d):
    """Two listings of the same files: of the second some are gone, longer, or touched, and some are new."""
    x = read(spark, d, "documents").select(F.concat(F.lit("/src/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").cast("long").alias("length"), F.timestamp_seconds("doc_id").alias("modified"), "doc_id")
    k = F.col("doc_id") % 11
    new = x.filter(k != 1).withColumns({"length": F.col("length") + F.when(k == 2, 1).otherwise(0), "modified": F.when(k == 3, F.timestamp_seconds(F.col("doc_id") + 1)).otherwise(F.col("modified"))})
    return manifest.compared(x.filter(k != 0).drop("doc_id"), new.drop("doc_id"))


def _agreement(spark, d):
    """Five runs of labels: each differs from the first where its number divides the part's, and the last lacks some."""
    x = read(spark, d, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("r"))
    v = (F.col("p_size") + F.when(F.col("p_partkey") % (F.col("r") + 1) == 0, F.col("r")).otherwise(0)) % 5
    rows = x.filter("r < 5 OR p_partkey % 9 > 0").select("p_partkey", F.concat(F.lit("run_"), "r").alias("run_id"), v.cast("string").alias("pattern"))
    return reports.agreement(rows, "p_partkey", "pattern")


_AFTER = f"""src AS (SELECT * REPLACE (CASE WHEN program_id % 7 = 1 THEN 'STOP RUN.' ELSE then_text END AS then_text) FROM ({RULES_SRC}lineitem) WHERE program_id % 7 <> 0
UNION ALL SELECT * FROM ({RULES_SRC}lineitem) WHERE program_id % 7 = 2)"""
_BEFORE = f"src AS ({RULES_SRC}lineitem)"

QUERIES = {
    "merged_canonical": lambda s, d: _merged(incremental.canonical, s, d),
    "merged_abstract": lambda s, d: _merged(incremental.abstract, s, d),
    "replaced_programs": _replaced,
    "manifest_changes": _changes,
    "run_agreement": _agreement,
}
ORACLE_SQL = {
    "merged_canonical": f"WITH {CANON.replace(_BEFORE, _AFTER)} SELECT * FROM canon",
    "merged_abstract": f"WITH {ABST.replace(_BEFORE, _AFTER)} SELECT * FROM pats",
    "replaced_programs": "SELECT l_orderkey AS program_id, l_linenumber AS start_line, l_returnflag AS then_text FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 < 2) UNION ALL SELECT o_orderkey, 1, 'again' FROM orders WHERE o_orderkey % 5 = 0",
    "manifest_changes": "SELECT '/src/' || doc_id AS path, CASE doc_id % 11 WHEN 0 THEN 'new' WHEN 1 THEN 'vanished' WHEN 2 THEN 'changed' WHEN 3 THEN 'changed' ELSE 'same' END AS change FROM documents",
    "run_agreement": """WITH x AS (SELECT p_partkey, r, (p_size + CASE WHEN p_partkey % (r + 1) = 0 THEN r ELSE 0 END) % 5 AS v FROM part CROSS JOIN generate_series(1, 5) g(r) WHERE p_partkey % 9 > 0),
y AS (SELECT 'run_' || a.r AS run_a, 'run_' || b.r AS run_b, a.v = b.v AS same FROM x a JOIN x b ON a.p_partkey = b.p_partkey AND a.r < b.r UNION ALL SELECT NULL, NULL, min(v) = max(v) FROM x GROUP BY p_partkey)
SELECT run_a, run_b, count(*) AS total, count(*) FILTER (WHERE same) AS agree, cast(round(cast(100.0 * count(*) FILTER (WHERE same) / count(*) AS decimal(18,6)), 2) AS double) AS pct FROM y GROUP BY 1, 2""",
}
