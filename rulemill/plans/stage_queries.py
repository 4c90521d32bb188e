"""Queries of the parse stage, its checks and the labelling inputs over generated programs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize
from ..operators import audit, labels, parse_stage, reports
from ..operators import relational as R
from ..sources import corpus
from .rule_queries import RULES_SRC, pct, source
from .table_queries import read

_c = F.col
_HEAD = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. P.\n       PROCEDURE DIVISION.\n"
#: What the program of each kind of part looks like, and what its parse result is.
VARIANTS = (
    (_HEAD + "           IF A = 1\n              IF B = 2 MOVE 1 TO C.\n", "VALID", "FULL"),
    ("       01 A.\n          05 B PIC X.\n", "SKIPPED_COPYBOOK", "FULL"),
    ("       IDENTIFICATION DIVISION.\n       FUNCTION-ID. F.\n", "SKIPPED_FUNCTION_UNIT", "FULL"),
    ("      * nothing but a comment\n", "EMPTY_AFTER_CLEAN", "FULL"),
    (_HEAD + "           END-IF.\n", "PARSER_ERROR", "FULL"),
    ("       IDENTIFICATION DIVISION.\n       ELSE.\n       PROCEDURE DIVISION.\n           IF A = 1 STOP RUN.\n", "VALID", "PROCEDURE_ONLY"),
)
_K = len(VARIANTS)


def _programs(spark: SparkSession, d: str) -> DataFrame:
    kind = (_c("p_partkey") % _K).cast("int")
    text = F.element_at(F.array(*[F.lit(t) for t, _, _ in VARIANTS]), kind + 1)
    path = F.concat(F.lit("/src/"), _c("p_partkey").cast("string"), F.lit(".cbl"))
    return read(spark, d, "part").select(_c("p_partkey").alias("id"), path.alias("path"), F.lit("GENAPP").alias("source_type"), text.cast("binary").alias("content"))


def _parsed(spark, d):
    return parse_stage.parse(_programs(spark, d), partitions=spark.sparkContext.defaultParallelism)


def _status(column: int) -> str:
    return "CASE p_partkey % " + str(_K) + "".join(f" WHEN {i} THEN '{v[column]}'" for i, v in enumerate(VARIANTS)) + " END"


_ID = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. P.\n"
_PD = "       PROCEDURE DIVISION.\n"
_OUT = "IDENTIFICATION DIVISION.\nPROGRAM-ID. P.\n"
#: Sources with {n} for the part's number, and what the cleaning leaves of them (O-36 to O-61).
SOURCES = (
    # directives, metadata, comments, a COPY and an EXEC block before and in the PROCEDURE DIVISION
    (_ID + "       CBL LIST\n       AUTHOR. A{n}.\n      * note\n       COPY BOOK{n}.\n           EXEC SQL SELECT {n}\n           END-EXEC.\n" + _PD + "           COPY MORE.\n           EXEC CICS SEND\n           END-EXEC.\n           STOP RUN.\n",
     _OUT + "\nPROCEDURE DIVISION.\n           CONTINUE.\n           DISPLAY \"EXEC_BLOCK_STUB\".\n    STOP RUN."),
    # a literal and a statement that go on in the next line; sequence numbers before column 7
    (_ID + _PD + "000100     DISPLAY \"AB\n000200-    \"CD{n}\".\n           ADD 1\n      -    TO C{n}.\n",
     _OUT + "PROCEDURE DIVISION.\n    DISPLAY \"ABCD{n}\".\n    ADD 1 TO C{n}."),
    # STRING blocks, ACCEPT and SET ENVIRONMENT, subscripts and reference modification, runs of dots
    (_ID + _PD + "           STRING A{n}\n             INTO B.\n           ACCEPT X FROM ENVIRONMENT \"E{n}\".\n           SET ENVIRONMENT Y.\n           MOVE T(1) TO U(2:{n})..\n           IF (A = {n}) STOP RUN.\n",
     _OUT + "PROCEDURE DIVISION.\n           CONTINUE.\n    ACCEPT X.\n\n    MOVE T TO U.\n    IF (A = {n}) STOP RUN."),
    # a missing PROGRAM-ID and DATA DIVISION; functions of the configuration, a SCREEN SECTION
    ("       IDENTIFICATION DIVISION.\n       ENVIRONMENT DIVISION.\n       CONFIGURATION SECTION.\n       FUNCTION ALL{n} INTRINSIC.\n       01 W PIC 9.\n       SCREEN SECTION.\n       01 S{n}.\n" + _PD + "           STOP RUN.\n",
     "IDENTIFICATION DIVISION.\n       PROGRAM-ID. DUMMY.\nENVIRONMENT DIVISION.\nCONFIGURATION SECTION.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n01 W PIC 9.\nPROCEDURE DIVISION.\n    STOP RUN."),
)


def _numbered(spark, d, texts) -> DataFrame:
    n = _c("p_partkey").cast("string")
    each = F.array(*[F.replace(F.lit(t), F.lit("{n}"), n) for t in texts])
    text = F.element_at(each, (_c("p_partkey") % len(texts)).cast("int") + 1)
    return read(spark, d, "part").select(_c("p_partkey").alias("id"), F.concat(F.lit("/src/"), n).alias("path"), F.lit("GENAPP").alias("source_type"), text.cast("binary").alias("content"))


def _cleaned(spark, d):
    return parse_stage.cleaned(_numbered(spark, d, [t for t, _ in SOURCES])).select("id", "content")


_NESTED = _HEAD + """           IF A = {n}
              IF B = 2
                 MOVE 1 TO C
              ELSE
                 MOVE 2 TO C
              END-IF
           ELSE
              EVALUATE TRUE
                 WHEN D > {n} PERFORM P-1
                 WHEN OTHER
                    IF E = 3 STOP RUN END-IF
              END-EVALUATE
           END-IF.
"""


def _nested(spark, d):
    got = parse_stage.rules(parse_stage.parse(_numbered(spark, d, [_NESTED]), partitions=spark.sparkContext.defaultParallelism))
    return got.select("program_id", "rule_type", "start_line", "end_line", "condition_text", "then_text", "else_text")


_N = "p_partkey::VARCHAR"
_INNER = "'IF B = 2 MOVE 1 TO C ELSE MOVE 2 TO C END-IF'"
_NESTED_SQL = f"""SELECT p_partkey AS program_id, 'IF' AS rule_type, 4::INT AS start_line, 16::INT AS end_line, 'A = ' || {_N} AS condition_text, {_INNER} AS then_text, 'EVALUATE TRUE WHEN D > ' || {_N} || ' PERFORM P-1 WHEN OTHER IF E = 3 STOP RUN END-IF END-EVALUATE' AS else_text FROM part
UNION ALL SELECT p_partkey, 'IF', 5, 9, 'B = 2', 'MOVE 1 TO C', 'MOVE 2 TO C' FROM part
UNION ALL SELECT p_partkey, 'EVALUATE', 12, 12, 'D > ' || {_N}, 'PERFORM P-1', NULL FROM part
UNION ALL SELECT p_partkey, 'EVALUATE', 13, 14, 'OTHER', 'IF E = 3 STOP RUN END-IF', NULL FROM part
UNION ALL SELECT p_partkey, 'IF', 14, 14, 'E = 3', 'STOP RUN', NULL FROM part"""
_CLEANED_SQL = "SELECT p_partkey AS id, replace(CASE p_partkey % " + str(len(SOURCES)) + "".join(f" WHEN {i} THEN '{out}'" for i, (_, out) in enumerate(SOURCES)) + f" END, '{{n}}', {_N}) AS content FROM part"


def _candidates(spark, d):
    return parse_stage.candidates(_parsed(spark, d)).select("program_id", "parse_mode", "kind", "start_line", "end_line", F.length("snippet").alias("size"))


def _statistics(spark, d):
    return parse_stage.statistics(_parsed(spark, d)).select("status", "files", "ifs", "files_with_if", "ifs_per_file")


def _valid(spark, d):
    x = _parsed(spark, d)
    return corpus.valid_programs(_programs(spark, d), parse_stage.results(x)).select("id", "path")


def _errors(spark, d):
    p = _programs(spark, d).withColumnRenamed("id", "program_id")
    return audit.parser_errors(parse_stage.results(_parsed(spark, d)), p).select("program_id", "line_no", "offending_token", "path")


def _rule_candidates(spark, d):
    kind = F.when(_c("l_linenumber") == 7, "LOOP").otherwise("IF")
    return read(spark, d, "lineitem").select(_c("l_orderkey").alias("program_id"), kind.alias("kind"), _c("l_linenumber").alias("start_line"), (_c("l_linenumber") + (_c("l_partkey") % 4).cast("int") - 1).alias("end_line"))


def _audit_s3(spark, d):
    results = read(spark, d, "orders").filter("o_orderkey % 9 > 0").select(_c("o_orderkey").alias("program_id"), F.when(_c("o_orderstatus") == "F", "VALID").otherwise("PARSER_ERROR").alias("status"))
    x = _rule_candidates(spark, d)
    return audit.candidates(x).unionByName(audit.candidates_of_invalid(x, results))


def _audit_s2(spark, d):
    o = read(spark, d, "orders").select(_c("o_orderkey").alias("program_id"))
    results = o.filter("program_id % 7 > 0").unionByName(o.filter("program_id % 11 = 0"))
    return audit.parse_results(o, results)


def _enums(spark, d):
    kind = F.when(_c("event_type") == "click", "evaluate x").when(_c("event_type") == "view", "if")
    mode = F.when(_c("event_type") == "click", " procedure_only ").when(_c("event_type") == "view", "odd")
    return read(spark, d, "events").select(normalize.safe_kind(kind).alias("kind"), normalize.safe_mode(mode).alias("mode")).groupBy("kind", "mode").agg(R.count_rows().alias("n"))


def _patterns(spark, d):
    empty = F.lit(None).cast("string")
    cols = {"abstract_canonical_key": F.concat(F.lit("k"), _c("p_partkey").cast("string")), "kind": F.lit("IF"), "has_else": _c("p_size") % 2 == 0, "abstract_predicate": F.when(_c("p_size") % 5 > 0, "VAR1 = <N>"), "abstract_then": F.when(_c("p_size") % 7 > 0, "PERFORM VAR2"), "abstract_else": F.when(_c("p_size") % 3 > 0, "STOP RUN").otherwise(empty), "occurrences": _c("p_size").cast("long")}
    return read(spark, d, "part").select(*[v.alias(k) for k, v in cols.items()])


_PATTERNS_SQL = "pats AS (SELECT 'k' || p_partkey::VARCHAR AS abstract_canonical_key, 'IF' AS kind, p_size % 2 = 0 AS has_else, CASE WHEN p_size % 5 > 0 THEN 'VAR1 = <N>' END AS abstract_predicate, CASE WHEN p_size % 7 > 0 THEN 'PERFORM VAR2' END AS abstract_then, CASE WHEN p_size % 3 > 0 THEN 'STOP RUN' END AS abstract_else, p_size::BIGINT AS occurrences FROM part)"


def _examples(spark, d):
    text = F.concat(F.lit("*> EXEC BLOCK STUB.\nIF A = "), _c("ps").cast("string"))
    x = read(spark, d, "lineitem").filter("l_partkey % 3 > 0 AND l_linenumber <= 3").select(_c("l_partkey").alias("k"), _c("l_linenumber").alias("ps")).distinct()
    return x.select(F.concat(F.lit("k"), _c("k").cast("string")).alias("abstract_canonical_key"), _c("ps").alias("rank"), text.alias("raw_snippet"))


def _prompts(spark, d):
    return labels.prompts(_patterns(spark, d), _examples(spark, d)).select("abstract_canonical_key", "prompt")


def _incomplete(spark, d):
    return labels.incomplete(_patterns(spark, d)).groupBy("reason").agg(R.count_rows().alias("n"))


def _missing_predicate(spark, d):
    return corpus.missing_predicate(_patterns(spark, d)).select("abstract_canonical_key", "occurrences")


def _offline(spark, d):
    got, _ = labels.label(_patterns(spark, d), _examples(spark, d))
    return got.groupBy("pattern", "title").agg(R.count_rows().alias("n"))


def _type_share(spark, d):
    return R.share_of_total(source(spark, d), ["rule_type"], "rules")


def _glued(spark, d):
    return audit.glued_and_separate(read(spark, d, "lineitem").select(F.when(_c("l_linenumber") == 1, "EXEC_BLOCK_STUB EXEC_BLOCK_STUB").when(_c("l_linenumber") == 2, "EXEC_BLOCK_STUBexec_block_stub").alias("then_norm"), F.when(_c("l_linenumber") == 3, "X").alias("else_norm")))


def _sample_join(spark, d):
    ratings = read(spark, d, "labels").select(_c("doc_id").alias("sample_no"))
    return audit.one("C-58", "Exp", R.missing(ratings, read(spark, d, "documents").filter("n_chars % 2 = 0").select(_c("doc_id").alias("sample_no")), ["sample_no"]))


_B = "cast(count(*) AS bigint)"
_one = "SELECT '{0}' AS check_id, '{1}' AS stage, cast({2} AS bigint) AS violations, CASE WHEN {2} = 0 THEN 'OK' ELSE 'FAIL' END AS status{3}"
_PROMPT_SQL = f"""WITH {_PATTERNS_SQL}, ex AS (SELECT DISTINCT 'k' || l_partkey::VARCHAR AS k, l_linenumber AS r FROM lineitem WHERE l_partkey % 3 > 0 AND l_linenumber <= 3),
n AS (SELECT k, r, row_number() OVER (PARTITION BY k ORDER BY r) AS i FROM ex),
t AS (SELECT k, string_agg('Example ' || i::VARCHAR || ':' || chr(10) || 'IF A = ' || r::VARCHAR, chr(10) || chr(10) ORDER BY i) AS x FROM n GROUP BY k)
SELECT abstract_canonical_key, concat('{labels.INSTRUCTIONS.replace("'", "''")}', chr(10), 'kind: IF', chr(10), 'has_else: ', has_else::VARCHAR, chr(10), 'predicate: ', coalesce(abstract_predicate, '<EMPTY>'), chr(10), 'then: ', coalesce(abstract_then, '<EMPTY>'), chr(10), 'else: ', coalesce(abstract_else, '<EMPTY>'), chr(10), chr(10), x) AS prompt FROM pats JOIN t ON k = abstract_canonical_key"""
_REASON = "CASE WHEN abstract_predicate IS NULL THEN 'missing predicate' WHEN abstract_then IS NULL THEN 'missing then' WHEN has_else AND abstract_else IS NULL THEN 'missing else' WHEN NOT has_else AND abstract_else IS NOT NULL THEN 'unexpected else' END"

QUERIES = {
    "parse_status": lambda s, d: reports.parse_status(parse_stage.results(_parsed(s, d))),
    "cleaned_sources": _cleaned,
    "nested_rules": _nested,
    "parse_statistics": _statistics,
    "parser_errors": _errors,
    "valid_programs": _valid,
    "rule_candidates": _candidates,
    "audit_s2": _audit_s2,
    "audit_s3": _audit_s3,
    "safe_enums": _enums,
    "prompt_assembly": _prompts,
    "incomplete_patterns": _incomplete,
    "missing_predicate": _missing_predicate,
    "offline_labels": _offline,
    "rule_type_share": _type_share,
    "stub_comparison": _glued,
    "sample_join": _sample_join,
}
ORACLE_SQL = {
    "parse_status": f"SELECT {_status(1)} AS status, {_status(2)} AS parse_mode, {_B} AS n, {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM part GROUP BY 1, 2",
    "cleaned_sources": _CLEANED_SQL,
    "nested_rules": _NESTED_SQL,
    "parse_statistics": f"WITH x AS (SELECT {_status(1)} AS status, CASE p_partkey % {_K} WHEN 0 THEN 2 ELSE 0 END AS ifs FROM part) SELECT status, {_B} AS files, cast(sum(ifs) AS bigint) AS ifs, cast(count(*) FILTER (WHERE ifs > 0) AS bigint) AS files_with_if, cast(round(cast(avg(ifs) AS decimal(18,6)), 2) AS double) AS ifs_per_file FROM x GROUP BY 1",
    "parser_errors": f"SELECT p_partkey AS program_id, 4::INT AS line_no, 'END-IF' AS offending_token, '/src/' || p_partkey::VARCHAR || '.cbl' AS path FROM part WHERE p_partkey % {_K} = 4",
    "valid_programs": f"SELECT p_partkey AS id, '/src/' || p_partkey::VARCHAR || '.cbl' AS path FROM part WHERE p_partkey % {_K} IN (0, 5)",
    "rule_candidates": f"SELECT p_partkey AS program_id, 'FULL' AS parse_mode, 'IF' AS kind, 4::INT AS start_line, 5::INT AS end_line, 36::INT AS size FROM part WHERE p_partkey % {_K} = 0 UNION ALL SELECT p_partkey, 'FULL', 'IF', 5, 5, 20 FROM part WHERE p_partkey % {_K} = 0 UNION ALL SELECT p_partkey, 'PROCEDURE_ONLY', 'IF', 4, 4, 17 FROM part WHERE p_partkey % {_K} = 5",
    "audit_s2": _one.format("C-01", "S2", "(SELECT abs(count(*) - (SELECT count(*) FILTER (WHERE o_orderkey % 7 > 0) + count(*) FILTER (WHERE o_orderkey % 11 = 0) FROM orders)) FROM orders)", "")
    + " UNION ALL " + _one.format("C-02", "S2", "(SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 > 0)", "")
    + " UNION ALL " + _one.format("C-03", "S2", "(SELECT count(*) FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 11 = 0)", ""),
    "audit_s3": _one.format("C-06", "S3", "count(*) FILTER (WHERE l_linenumber = 7)", " FROM lineitem") + " UNION ALL " + _one.format("C-07", "S3", "count(*) FILTER (WHERE l_linenumber < 1 OR l_partkey % 4 = 0)", " FROM lineitem")
    + " UNION ALL " + _one.format("C-05", "S3", "count(*) FILTER (WHERE o_orderkey IS NULL OR o_orderstatus <> 'F')", " FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 9 > 0) ON o_orderkey = l_orderkey"),
    "safe_enums": f"SELECT CASE WHEN event_type = 'click' THEN 'EVALUATE' ELSE 'IF' END AS kind, CASE WHEN event_type = 'click' THEN 'PROCEDURE_ONLY' ELSE 'FULL' END AS mode, {_B} AS n FROM events GROUP BY 1, 2",
    "prompt_assembly": _PROMPT_SQL,
    "incomplete_patterns": f"WITH {_PATTERNS_SQL} SELECT {_REASON} AS reason, {_B} AS n FROM pats WHERE {_REASON} IS NOT NULL GROUP BY 1",
    "missing_predicate": f"WITH {_PATTERNS_SQL} SELECT abstract_canonical_key, occurrences FROM pats WHERE abstract_predicate IS NULL",
    "offline_labels": f"WITH {_PATTERNS_SQL} SELECT 'CONTROL_FLOW_TEMPLATE' AS pattern, 'Selects a routine by a condition' AS title, {_B} AS n FROM pats WHERE {_REASON} IS NULL AND abstract_canonical_key IN (SELECT 'k' || l_partkey::VARCHAR FROM lineitem WHERE l_partkey % 3 > 0 AND l_linenumber <= 3)",
    "rule_type_share": f"SELECT rule_type, cast(count(*) AS bigint) AS rules, {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM ({RULES_SRC}lineitem) GROUP BY 1",
    "stub_comparison": "SELECT cast(count(*) FILTER (WHERE l_linenumber = 2) AS bigint) AS glued, cast(count(*) FILTER (WHERE l_linenumber = 1) AS bigint) AS separate FROM lineitem",
    "sample_join": _one.format("C-58", "Exp", "count(*)", " FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars % 2 = 0)"),
}
