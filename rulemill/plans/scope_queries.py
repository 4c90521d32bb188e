"""Queries of the table forms of scopes and of line state, over programs made from part, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import line_state, scopes
from .table_queries import read

#: A program for each part n: k nested IFs, closed by END-IF (even n) or by the ELSE of the next outer one (odd n), then an EVALUATE.
_TEXT = """array_join(flatten(array(
  array('PROGRAM-ID. P.', 'PROCEDURE DIVISION.'),
  transform(sequence(1, k), i -> concat('IF L', i, ' > ', n)),
  array(concat('MOVE 1 TO M', k)),
  flatten(transform(sequence(k, 1, -1), i -> filter(array(concat('ELSE ADD ', i, ' TO S'), IF(n % 2 = 0, 'END-IF', NULL)), x -> x IS NOT NULL))),
  array('.', 'EVALUATE TRUE', concat('WHEN A = ', n), concat('WHEN B = ', n), concat('DISPLAY ', n), 'WHEN OTHER', 'STOP RUN', 'END-EVALUATE.'))), '\\n')"""


#: Programs of a task: some megabytes of texts, so that its rows of tokens are sorted in memory.
PROGRAMS = 10_000


def _nested_programs(spark: SparkSession, d: str) -> DataFrame:
    """Dealt by id while they are numbers only; the texts are made behind the exchange, which is the only one."""
    x = read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    x = x.repartition(max(1, math.ceil(x.count() / PROGRAMS)), "id")
    return x.select("id", F.col("id").alias("n"), (F.col("id") % 7 + 1).cast("int").alias("k")).select("id", F.expr(_TEXT).alias("text"))


def _scope_rules(spark, d):
    got = scopes.extract(_nested_programs(spark, d), snippets=False).rules
    return got.select(F.col("id").alias("program_id"), "rule_type", "start_line", "end_line", "condition_text", "then_text", "else_text", "when_index")


def _scope_candidates(spark, d):
    got = scopes.extract(_nested_programs(spark, d)).candidates
    return got.select(F.col("id").alias("program_id"), "kind", "start_line", "end_line", F.length("snippet").alias("size"))


#: Lines for each part n: a COPY and an EXEC block before the PROCEDURE DIVISION and in it, a comment, a literal over several lines.
_LINES = """array_join(flatten(array(
  array(concat('COPY A', n, '.'), 'EXEC SQL'), transform(slice(sequence(0, 5), 1, CAST(n % 5 AS INT)), i -> concat('X', i)), array('END-EXEC.', 'PROCEDURE DIVISION.', concat('       MOVE ', n, ' TO A')),
  array('EXEC CICS'), transform(slice(sequence(0, 5), 1, CAST(n % 4 AS INT)), i -> 'COPY Y.'), array('END-EXEC.', '      * COPY NOTE', '       COPY B.', '           DISPLAY "AB'),
  transform(sequence(0, CAST(n % 3 AS INT)), i -> concat('      -    "CD', n)), array('           TO B.'))), '\n')"""


def _folded(spark, d):
    x = read(spark, d, "part").select(F.col("p_partkey").alias("n")).select(F.col("n").alias("id"), F.expr(_LINES).alias("text"))
    return line_state.folded(x)


_PROGRAM = "p AS (SELECT p_partkey AS n, (p_partkey % 7 + 1)::INT AS k, p_partkey % 2 = 0 AS ended, CASE WHEN p_partkey % 2 = 0 THEN 2 * (p_partkey % 7 + 1) ELSE p_partkey % 7 + 1 END::INT AS e FROM part)"
_NEST = "array_to_string(list_transform(range({0}, k + 1), lambda j: 'IF L' || j || ' > ' || n), '{1}') || '{1}MOVE 1 TO M' || k || '{1}' || array_to_string(list_transform(list_reverse(range({0}, k + 1)), lambda j: 'ELSE ADD ' || j || ' TO S' || CASE WHEN ended THEN '{1}END-IF' ELSE '' END), '{1}')"
_LEVELS = "i AS (SELECT *, unnest(range(1, k + 1))::INT AS i FROM p)"
_END = "CASE WHEN ended THEN 3 + k + 2 * (k - i) + 2 ELSE 3 + k + (k - i) + 1 END::INT"

QUERIES = {
    "scope_rules": _scope_rules,
    "scope_candidates": _scope_candidates,
    "folded_lines": _folded,
}
ORACLE_SQL = {
    "scope_rules": f"""WITH {_PROGRAM}, {_LEVELS}
SELECT n AS program_id, 'IF' AS rule_type, (2 + i)::INT AS start_line, {_END} AS end_line, 'L' || i || ' > ' || n AS condition_text,
  CASE WHEN i < k THEN {_NEST.format('i + 1', ' ')} ELSE 'MOVE 1 TO M' || k END AS then_text, 'ADD ' || i || ' TO S' AS else_text, NULL::INT AS when_index FROM i
UNION ALL SELECT n, 'EVALUATE', 6 + k + e, 8 + k + e, 'A = ' || n, 'DISPLAY ' || n, NULL, 0 FROM p
UNION ALL SELECT n, 'EVALUATE', 7 + k + e, 8 + k + e, 'B = ' || n, 'DISPLAY ' || n, NULL, 1 FROM p
UNION ALL SELECT n, 'EVALUATE', 9 + k + e, 10 + k + e, 'OTHER', 'STOP RUN', NULL, 2 FROM p""",
    "scope_candidates": f"""WITH {_PROGRAM}, {_LEVELS}
SELECT n AS program_id, 'IF' AS kind, (2 + i)::INT AS start_line, {_END} AS end_line, length({_NEST.format('i', ' ')})::INT AS size FROM i
UNION ALL SELECT n, 'EVALUATE', 5 + k + e, 11 + k + e, 13 + 2 * (1 + 9 + length(n::VARCHAR)) + 1 + 8 + length(n::VARCHAR) + 1 + 10 + 1 + 8 + 1 + 12 FROM p""",
    "folded_lines": """SELECT p_partkey AS id, 'PROCEDURE DIVISION.' || chr(10) || 'MOVE ' || p_partkey || ' TO A' || chr(10) || '           DISPLAY "EXEC_BLOCK_STUB".' || chr(10) || '           CONTINUE.' || chr(10)
  || '    DISPLAY "AB' || repeat('CD' || p_partkey, (p_partkey % 3 + 1)::INT) || chr(10) || '    TO B.' AS text FROM part""",
}
