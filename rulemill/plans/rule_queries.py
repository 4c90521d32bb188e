"""Queries of the rule operators over a synthetic rule table, with their SQL.

The driver's tables hold no source code; rule texts are made from lineitem by the same SELECT on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, normalize
from ..functions.abstraction import RESERVED
from ..functions.normalize import COUNTED_VERBS, OPERATOR_WORDS
from ..operators import audit, reports, rules
from ..operators.relational import count_rows

Q = "chr(39)"
QTY, LINE = "cast(cast(l_quantity AS int) AS varchar(9))", "cast(l_linenumber AS varchar(9))"
COND = f"""CASE l_partkey % 6
  WHEN 0 THEN concat('l-quantity  is greater than ', {QTY}, ' AND L-FLAG EQUAL TO ', {Q}, l_returnflag, {Q})
  WHEN 1 THEN 'WS-TOTAL IS NOT EQUAL TO ZEROS OR NOT WS-NAME = SPACES'
  WHEN 2 THEN concat('  WS-FIELD-0', {LINE}, ' IS LESS THAN OR EQUAL TO -', {QTY}, '.5 *> note ', l_returnflag)
  WHEN 3 THEN concat('STATUS-', l_linestatus, ' = "', l_returnflag, '" AND WS-COUNT IS GREATER THAN OR EQUAL TO ', {LINE})
  WHEN 4 THEN 'WS-A EQUAL WS-B AND NOT ( WS-C LESS THAN 10 )'
  ELSE 'SQLCODE IS EQUAL TO 100' END"""
#: The same rule rows in Spark and in the SQL that they are held against.
RULES_SRC = f"""SELECT l_orderkey AS program_id, l_linenumber AS start_line, l_linenumber + 3 AS end_line,
  CASE WHEN l_linenumber % 4 = 0 THEN 'EVALUATE' ELSE 'IF' END AS rule_type,
  CASE WHEN l_linenumber % 4 <> 0 THEN {COND} END AS condition_text,
  CASE WHEN l_linenumber % 4 = 0 THEN concat('L-STATUS-', l_linestatus) END AS subject_text,
  CASE WHEN l_linenumber % 4 = 0 THEN CASE WHEN l_partkey % 11 = 0 THEN 'OTHER' ELSE {COND} END END AS when_text,
  CASE l_suppkey % 5
    WHEN 0 THEN concat('MOVE ', {LINE}, ' TO WS-CODE-', cast(l_linenumber % 3 AS varchar(9)), ' PERFORM PARA-', l_linestatus)
    WHEN 1 THEN concat('DISPLAY "EXEC_BLOCK_STUB". CONTINUE MOVE ', {Q}, l_returnflag, {Q}, ' TO WS-B')
    WHEN 2 THEN 'CONTINUE.'
    WHEN 3 THEN concat('COMPUTE WS-X = WS-Y * 2 + 1 ADD 1 TO WS-CNT  CALL ', {Q}, 'SUB', {Q}, ' USING WS-X')
    ELSE 'DISPLAY "COPY_STUB" GO TO EXIT-PARA' END AS then_text,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('DISPLAY ', {Q}, 'X', {Q}) WHEN l_linenumber % 5 = 0 THEN 'SET WS-EOF TO TRUE' END AS else_text,
  concat('rule ', cast(l_orderkey AS varchar(19)), '/', {LINE}) AS raw_snippet
FROM """


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RULES_SRC + "{lineitem}", lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


# ------------------------------------------------------------ the same functions as SQL


def _re(x: str, pattern: str, to: str) -> str:
    p, t = pattern.replace("'", "''"), to.replace("'", "''")
    return f"regexp_replace({x}, '{p}', '{t}', 'g')"


def sql_trim(x: str) -> str:
    return _re(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def sql_squeeze(x: str) -> str:
    return _re(x, r"\s+", " ")


def sql_literals(x: str) -> str:
    number = r"(^|[^A-Z0-9_-])[+-]?[0-9]+(\.[0-9]+)?([^A-Z0-9_-]|$)"  # the edges are consumed, so twice
    x = _re(_re(x, r'"[^"]*"("[^"]*")*', "<S>"), r"'[^']*'('[^']*')*", "<S>")
    x = _re(_re(x, number, r"\1<N>\3"), number, r"\1<N>\3")
    x = _re(_re(x, r"\bZERO(S|ES)?\b", "<ZERO>"), r"\bSPACES?\b", "<SPACE>")
    return sql_trim(sql_squeeze(x))


def sql_predicate(x: str) -> str:
    t = sql_squeeze(f"upper({sql_trim(f'split_part({x}, ' + chr(39) + '*>' + chr(39) + ', 1)')})")
    for a, b in OPERATOR_WORDS:
        t = f"replace({t}, '{a}', '{b}')"
    return f"nullif({sql_literals(t)}, '')"


def sql_action(x: str) -> str:
    t = sql_squeeze(f"upper({sql_trim(x)})")
    u = _re(t, r"\bDISPLAY\s+[\"']EXEC_BLOCK_STUB[\"']\s*\.?", " EXEC_BLOCK_STUB ")
    u = _re(_re(u, r"\bDISPLAY\s+[\"']COPY_STUB[\"']\s*\.?", ""), r"\bCONTINUE\b\.?\s*", "")
    u = sql_literals(sql_trim(sql_squeeze(u)))
    return f"CASE WHEN regexp_matches({t}, '^CONTINUE\\s*\\.?$') THEN 'CONTINUE' ELSE nullif({u}, '') END"


def sql_occurrences(x: str, needle: str) -> str:
    return f"coalesce((length({x}) - length(replace({x}, '{needle}', ''))) // {len(needle)}, 0)"


def sql_statements(x: str) -> str:
    return "(" + " + ".join(sql_occurrences(f"(' ' || {x} || ' ')", f" {v} ") for v in COUNTED_VERBS) + ")"


TOKEN = r"<(?:N|S|ZERO|SPACE)>|>=|<=|<>|[=(),.:+*/]|[^\s=(),.:+*/<>-]+(?:-+[^\s=(),.:+*/<>-]+)*|[<>-]"
WORDS = ", ".join(f"'{w}'" for w in RESERVED)

NORMALIZED = f"""src AS ({RULES_SRC}lineitem),
n1 AS (SELECT *, rule_type AS kind, CASE WHEN rule_type = 'EVALUATE' THEN {sql_predicate("subject_text")} END AS subject_norm,
  CASE WHEN rule_type = 'EVALUATE' THEN CASE WHEN upper(when_text) = 'OTHER' THEN 'OTHER' ELSE {sql_predicate("when_text")} END END AS when_norm,
  {sql_action("then_text")} AS then_norm, {sql_action("else_text")} AS else_norm FROM src),
n2 AS (SELECT *, CASE WHEN kind = 'EVALUATE' THEN when_norm ELSE {sql_predicate("condition_text")} END AS condition_norm, else_norm IS NOT NULL AS has_else,
  cast({sql_statements("then_norm")} AS int) AS then_stmt_count, cast({sql_statements("else_norm")} AS int) AS else_stmt_count FROM n1),
n3 AS (SELECT *, CASE WHEN kind = 'EVALUATE' THEN trim(coalesce(subject_norm, '') || ' | WHEN | ' || coalesce(when_norm, '')) ELSE condition_norm END AS pred FROM n2),
norm AS (SELECT *, cast(1 + {" + ".join(sql_occurrences("pred", f" {w} ") for w in ("AND", "OR", "NOT"))} + then_stmt_count // 3 + else_stmt_count // 3 AS int) AS complexity_score FROM n3)"""
KEYED = f"""{NORMALIZED},
keyed AS (SELECT *, sha256(kind || '|' || CASE WHEN has_else THEN '1' ELSE '0' END || '|' || CASE WHEN kind = 'EVALUATE' THEN coalesce(subject_norm, '') || '|WHEN|' || coalesce(when_norm, '') ELSE coalesce(condition_norm, '') END
  || '|' || coalesce(then_norm, '') || '|' || coalesce(else_norm, '')) AS canonical_key FROM norm)"""
_TOK = TOKEN.replace("'", "''")
_id = lambda t: f"regexp_matches({t}, '^[A-Z][A-Z0-9-]*$') AND {t} NOT IN ({WORDS})"
_name = lambda ts: f"list_transform({ts}, lambda t: CASE WHEN {_id('t')} THEN 'VAR' || list_position(ids, t)::VARCHAR ELSE t END)"
_pretty = lambda ts: f"replace(regexp_replace(array_to_string({_name(ts)}, ' '), ' ([),.:])', '\\1', 'g'), '( ', '(')"
ABSTRACTED = f"""{KEYED},
d AS (SELECT kind, has_else, condition_norm, subject_norm, when_norm, then_norm, else_norm, canonical_key, count(*) AS weight FROM keyed GROUP BY ALL),
t0 AS (SELECT *, regexp_extract_all(coalesce(CASE WHEN kind = 'EVALUATE' THEN subject_norm ELSE condition_norm END, ''), '{_TOK}') AS th,
  regexp_extract_all(coalesce(CASE WHEN kind = 'EVALUATE' THEN when_norm END, ''), '{_TOK}') AS tw, regexp_extract_all(coalesce(then_norm, ''), '{_TOK}') AS tt, regexp_extract_all(coalesce(else_norm, ''), '{_TOK}') AS te FROM d),
t1 AS (SELECT *, list_filter(th || tw || tt || te, lambda t: {_id("t")}) AS every FROM t0),
t2 AS (SELECT *, list_filter(every, lambda t, i: list_position(every, t) = i) AS ids FROM t1),
t3 AS (SELECT *, {_pretty("th")} AS ah, {_pretty("tw")} AS aw, nullif({_pretty("tt")}, '') AS abstract_then, nullif({_pretty("te")}, '') AS abstract_else FROM t2),
t4 AS (SELECT *, CASE WHEN kind = 'EVALUATE' THEN ah || ' | WHEN | ' || aw ELSE nullif(ah, '') END AS abstract_predicate FROM t3),
abst AS (SELECT *, sha256(kind || '|' || CASE WHEN has_else THEN '1' ELSE '0' END || '|' || coalesce(abstract_predicate, '') || '|' || coalesce(abstract_then, '') || '|' || coalesce(abstract_else, '')) AS abstract_canonical_key FROM t4)"""
ROUND = "cast(round(cast({} AS decimal(18,6)), 2) AS double)"


def pct(part: str, whole: str) -> str:
    return ROUND.format(f"100.0 * {part} / {whole}")


CANON = f"""{KEYED}, canon AS (SELECT canonical_key, min(kind) AS kind, min(condition_norm) AS condition_norm, min(subject_norm) AS subject_norm, min(then_norm) AS then_norm, min(else_norm) AS else_norm, bool_or(has_else) AS has_else,
  cast(count(*) AS int) AS occurrences, min(complexity_score) AS min_complexity, max(complexity_score) AS max_complexity, avg(complexity_score) AS avg_complexity FROM keyed GROUP BY canonical_key)"""
ABST = f"""{ABSTRACTED}, pats AS (SELECT abstract_canonical_key, min(canonical_key) AS canonical_key, min(kind) AS kind, bool_or(has_else) AS has_else, min(abstract_predicate) AS abstract_predicate, min(abstract_then) AS abstract_then,
  min(abstract_else) AS abstract_else, cast(sum(weight) AS bigint) AS occurrences FROM abst GROUP BY abstract_canonical_key)"""


def _check(cid: str, stage: str, cond: str, bad: str = "FAIL", good: str = "OK") -> str:
    return f"SELECT '{cid}' AS check_id, '{stage}' AS stage, cast(count(*) FILTER (WHERE {cond}) AS bigint) AS violations, CASE WHEN count(*) FILTER (WHERE {cond}) = 0 THEN '{good}' ELSE '{bad}' END AS status FROM keyed"


def _blank(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = '')"


_ALL = "concat(condition_norm, subject_norm, when_norm, then_norm, else_norm)"
_WSALL = "concat_ws(' ', condition_norm, subject_norm, when_norm, then_norm, else_norm)"
_WSACT, _WSPRED = "concat_ws(' ', then_norm, else_norm)", "concat_ws(' ', condition_norm, subject_norm, when_norm)"
_IFBAD = f"kind = 'IF' AND ({_blank('condition_norm')} OR {_blank('then_norm')})"
_ELSEBAD = f"(has_else AND {_blank('else_norm')}) OR (NOT has_else AND NOT {_blank('else_norm')})"
_EVBAD = f"kind = 'EVALUATE' AND ({_blank('subject_norm')} OR {_blank('when_norm')} OR {_blank('then_norm')})"
_EDGE = "[^[:alnum:]_-]"
# The patterns of the checks in the three texts below must equal those of the published checks.
AUDIT_S4 = f"WITH {KEYED} " + " UNION ALL ".join(
    [
        _check("C-10", "S4", f"rule_type = 'IF' AND ({_blank('condition_text')} OR {_blank('then_text')})"),
        _check("C-11", "S4", f"rule_type = 'EVALUATE' AND ({_blank('subject_text')} OR {_blank('when_text')} OR {_blank('then_text')})"),
        _check("C-12", "S4", f"rule_type = 'EVALUATE' AND regexp_matches(when_text, '(^|{_EDGE})({audit.PREDICATE_VERBS})({_EDGE}|$)')", "PRUEFEN"),
    ]
)
AUDIT_S5 = f"WITH {KEYED} " + " UNION ALL ".join(
    [
        _check("C-15", "S5", f"regexp_matches({_ALL}, '(^|{_EDGE})COPY({_EDGE}|$)', 'i')"),
        _check("C-16", "S5", f"regexp_matches({_ALL}, 'EXEC[[:space:]]+(SQL|CICS)', 'i')"),
        _check("C-17", "S5", "contains(concat(condition_norm, subject_norm, when_norm), 'EXEC_BLOCK_STUB')"),
        _check("C-18", "S5", "regexp_matches(concat(then_norm, else_norm), 'EXEC_BLOCK_STUB[^[:space:]]')"),
        _check("C-19", "S5", f"regexp_matches({_ALL}, '<N[^>]|<S[^>P]|<SPACE[^>]|<ZERO[^>]|<<|>>')"),
        _check("C-20", "S5", _IFBAD),
        _check("C-21", "S5", _ELSEBAD),
        _check("C-22", "S5", _EVBAD),
        _check("C-27", "S5", "canonical_key IS NULL"),
    ]
)
_B = ("manuell pruefen", "unauffaellig")
AUDIT_BATTERY = f"WITH {KEYED} " + " UNION ALL ".join(
    [
        _check("C-42", "S5", f"regexp_matches({_WSACT}, 'EXEC_BLOCK_STUBEXEC_BLOCK_STUB', 'i')", *_B),
        _check("C-43", "S5", f"regexp_matches({_WSPRED}, 'EXEC_BLOCK_STUB', 'i')", *_B),
        _check("C-44", "S5", f"regexp_matches({_WSALL}, '(^|[[:space:]])COPY([[:space:]]|[.]|$)', 'i')", *_B),
        _check("C-45", "S5", f"regexp_matches({_WSALL}, '(^|[[:space:]])EXEC[[:space:]]+(SQL|CICS)([[:space:]]|$)|END-EXEC', 'i')", *_B),
        _check("C-46", "S5", f"regexp_matches({_WSALL}, '<N[^>]|<S[^>P]|<SPACE[^>]|<ZERO[^>]|<<|>>')", *_B),
        _check("C-47", "S5", _IFBAD, *_B),
        _check("C-48", "S5", _ELSEBAD, *_B),
        _check("C-49", "S5", _EVBAD, *_B),
        _check("C-50", "S5", f"kind = 'EVALUATE' AND regexp_matches({_WSPRED}, '(^|[[:space:]])({audit.BATTERY_VERBS})([[:space:]]|$)|(^|[[:space:]])GO[[:space:]]+TO([[:space:]]|$)', 'i')", *_B),
        _check("C-51", "S5", f"regexp_matches({_WSACT}, 'EXEC_BLOCK_STUB[[:space:]]+EXEC_BLOCK_STUB', 'i')", *_B),
        _check("C-55", "S5", f"regexp_matches({_WSACT}, 'EXEC_BLOCK_STUB[A-Z0-9_(]|[A-Z0-9_)]EXEC_BLOCK_STUB', 'i')", *_B),
    ]
)


def _rows(cid: str, stage: str, table: str) -> str:
    return f"SELECT '{cid}' AS check_id, '{stage}' AS stage, cast(count(*) AS bigint) AS violations, CASE WHEN count(*) = 0 THEN 'OK' ELSE 'FAIL' END AS status FROM ({table})"


def _lost(cid: str, stage: str, patterns: str) -> str:
    n = f"abs((SELECT coalesce(sum(occurrences), 0) FROM {patterns}) - (SELECT count(*) FROM keyed))"
    return f"SELECT '{cid}' AS check_id, '{stage}' AS stage, cast({n} AS bigint) AS violations, CASE WHEN {n} = 0 THEN 'OK' ELSE 'FAIL' END AS status"


def _dedup_checks(ids: tuple, stage: str, key: str, patterns: str) -> str:
    return " UNION ALL ".join([_rows(ids[0], stage, f"SELECT 1 FROM {patterns} WHERE NOT regexp_matches({key}, '^[0-9a-f]{{64}}$')"), _rows(ids[1], stage, f"SELECT {key} FROM {patterns} GROUP BY {key} HAVING count(*) > 1"), _lost(ids[2], stage, patterns)])


AUDIT_S6 = f"WITH {CANON} " + _dedup_checks(("C-24", "C-25", "C-26"), "S6", "canonical_key", "canon") + " UNION ALL " + _rows("C-28", "S6", "SELECT canonical_key FROM keyed GROUP BY 1 HAVING count(DISTINCT kind) > 1 OR count(DISTINCT has_else) > 1")
_MORE = "greatest((SELECT count(*) FROM pats) - (SELECT count(DISTINCT canonical_key) FROM keyed), 0)"
AUDIT_S7 = (
    f"WITH {ABST} SELECT 'C-29' AS check_id, 'S7' AS stage, cast({_MORE} AS bigint) AS violations, CASE WHEN {_MORE} = 0 THEN 'OK' ELSE 'FAIL' END AS status UNION ALL "
    + " UNION ALL ".join([_rows("C-30", "S7", "SELECT abstract_canonical_key FROM pats GROUP BY 1 HAVING count(*) > 1"), _lost("C-33", "S7", "pats")])
    + " UNION ALL "
    + _rows("C-31", "S7", f"SELECT 1 FROM pats WHERE {_blank('abstract_predicate')}")
    + " UNION ALL "
    + _rows("C-32", "S7", "SELECT 1 FROM pats WHERE regexp_matches(concat(abstract_predicate, abstract_then, abstract_else), '(^|[^[:alnum:]])VAR([^0-9]|$)')")
)

# ------------------------------------------------------------ queries


def _distinct(spark: SparkSession, d: str) -> DataFrame:
    return rules.keyed_distinct(source(spark, d))


def _norm_columns(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    x = normalize.normalize_rules(source(spark, d).groupBy(*rules.RULE_COLUMNS).agg(count_rows().alias("n")))
    return x.groupBy(*names).agg(F.sum("n").alias("n"))


def canonical_share(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: canonical rules of each kind with their share of all rule instances."""
    rows = keys.with_canonical_key(normalize.normalize_rules(source(spark, d).groupBy(*rules.RULE_COLUMNS).agg(count_rows().alias("weight"))))
    canon = rules.canonical(rows, "weight").select("canonical_key", "kind", "condition_norm", "then_norm", F.col("occurrences").cast("long").alias("occurrences"))
    # the total as a scalar of the same rows: no join, and no window without a key
    total = rows.filter("canonical_key IS NOT NULL").agg(F.sum("weight").alias("total")).scalar()
    return canon.select("canonical_key", "kind", "condition_norm", "then_norm", "occurrences", reports.exact2(100.0 * F.col("occurrences") / total).alias("pct"))


def _canonical(spark, d):
    return rules.canonical(_distinct(spark, d), "weight")


def _abstract(spark, d):
    return rules.abstract(_distinct(spark, d), "weight")


def _reduction(spark, d):
    x = _distinct(spark, d)
    counts = x.agg(F.sum("weight").alias("rules"), F.count_distinct("canonical_key").alias("canonical"), F.count_distinct("abstract_canonical_key").alias("abstract"))
    return reports.reduction(counts)


def _topk(spark, d):
    order = ["program_id", "start_line", "raw_snippet", "condition_text", "when_text", "then_text"]
    return rules.examples_of_raw(source(spark, d), order).select("canonical_key", "program_id", "start_line", "rank")


def _audit_s4(spark, d):
    return audit.extracted(source(spark, d).groupBy(*rules.RULE_COLUMNS).agg(count_rows().alias("weight")), "weight")


def _audit_s5(spark, d):
    return audit.normalized(_distinct(spark, d), "weight")


def _battery(spark, d):
    return audit.battery(_distinct(spark, d), "weight")


def _audit_s6(spark, d):
    return audit.canonical_stage(_distinct(spark, d), "weight")


def _audit_s7(spark, d):
    return audit.abstract_stage(_distinct(spark, d), "weight")


def _counts_of(names: list[str]):
    return lambda spark, d: _norm_columns(spark, d, names)


def _key_counts(spark, d):
    return _distinct(spark, d).groupBy("canonical_key", "abstract_canonical_key").agg(F.sum("weight").alias("n"))


QUERIES = {
    "canonical_share": canonical_share,
    "norm_predicate": _counts_of(["condition_norm", "subject_norm", "when_norm"]),
    "norm_action": _counts_of(["then_norm", "else_norm", "has_else"]),
    "statement_counts": _counts_of(["then_stmt_count", "else_stmt_count", "complexity_score"]),
    "canonical_rebuild": _canonical,
    "abstract_rebuild": _abstract,
    "rule_keys": _key_counts,
    "reduction_cascade": _reduction,
    "topk_examples": _topk,
    "kind_summary": lambda spark, d: rules.kind_summary(source(spark, d), "rule_type"),
    "rule_totals": lambda spark, d: audit.else_and_total(source(spark, d)),
    "audit_s4": _audit_s4,
    "audit_s5": _audit_s5,
    "audit_battery": _battery,
    "audit_s6": _audit_s6,
    "audit_s7": _audit_s7,
}
_n = "cast(count(*) AS bigint) AS n"
ORACLE_SQL = {
    "canonical_share": f"WITH {CANON} SELECT canonical_key, kind, condition_norm, then_norm, cast(occurrences AS bigint) AS occurrences, {pct('occurrences', '(SELECT sum(occurrences) FROM canon)')} AS pct FROM canon",
    "norm_predicate": f"WITH {NORMALIZED} SELECT condition_norm, subject_norm, when_norm, {_n} FROM norm GROUP BY 1, 2, 3",
    "norm_action": f"WITH {NORMALIZED} SELECT then_norm, else_norm, has_else, {_n} FROM norm GROUP BY 1, 2, 3",
    "statement_counts": f"WITH {NORMALIZED} SELECT then_stmt_count, else_stmt_count, complexity_score, {_n} FROM norm GROUP BY 1, 2, 3",
    "canonical_rebuild": f"WITH {CANON} SELECT * FROM canon",
    "abstract_rebuild": f"WITH {ABST} SELECT * FROM pats",
    "rule_keys": f"WITH {ABSTRACTED} SELECT canonical_key, abstract_canonical_key, cast(sum(weight) AS bigint) AS n FROM abst GROUP BY 1, 2",
    "reduction_cascade": f"WITH {ABSTRACTED}, c AS (SELECT cast(sum(weight) AS bigint) AS rules, count(DISTINCT canonical_key) AS canonical, count(DISTINCT abstract_canonical_key) AS abstract FROM abst) SELECT *, {ROUND.format('100.0 * (1 - canonical / rules)')} AS pct_canonical, {ROUND.format('100.0 * (1 - abstract / canonical)')} AS pct_abstract, {ROUND.format('100.0 * (1 - abstract / rules)')} AS pct_all FROM c",
    "topk_examples": f"WITH {KEYED}, r AS (SELECT canonical_key, program_id, start_line, cast(row_number() OVER (PARTITION BY canonical_key ORDER BY program_id, start_line, raw_snippet, condition_text NULLS FIRST, when_text NULLS FIRST, then_text) AS int) AS rank FROM keyed) SELECT * FROM r WHERE rank <= 3",
    "kind_summary": f"SELECT cast(count(*) AS bigint) AS total, cast(count(*) FILTER (WHERE rule_type = 'IF') AS bigint) AS ifs, cast(count(*) FILTER (WHERE rule_type = 'EVALUATE') AS bigint) AS evaluates FROM ({RULES_SRC}lineitem)",
    "rule_totals": f"SELECT cast(count(*) FILTER (WHERE NOT {_blank('else_text')}) AS bigint) AS with_else, cast(count(*) AS bigint) AS total FROM ({RULES_SRC}lineitem)",
    "audit_s4": AUDIT_S4,
    "audit_s5": AUDIT_S5,
    "audit_battery": AUDIT_BATTERY,
    "audit_s6": AUDIT_S6,
    "audit_s7": AUDIT_S7,
}
