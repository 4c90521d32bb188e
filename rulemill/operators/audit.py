"""Data-quality checks of every stage (C-01 to C-58): each gives (check_id, stage, violations, status).

All row checks of a table run in one pass: a conditional count each, then one row a check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PATTERNS, RULE_KIND
from .relational import count_rows, duplicates, exact2, is_blank_text, missing, mixed_keys

# What a status is called.
OK, FAIL, REVIEW = "OK", "FAIL", "PRUEFEN"
CALM, BY_HAND = "unauffaellig", "manuell pruefen"
# Verbs that must not stand in a predicate.
PREDICATE_VERBS = "MOVE|PERFORM|COMPUTE|ADD|SUBTRACT|MULTIPLY|DIVIDE"
BATTERY_VERBS = "MOVE|PERFORM|ADD|SUBTRACT|MULTIPLY|DIVIDE|COMPUTE|DISPLAY|CALL"
EDGE = "[^A-Za-z0-9_-]"
SPACE = r"[ \t\n\r\f\x0B]"

_c = F.col


def _all(*names: str) -> Column:
    return F.concat(*[F.coalesce(_c(n), F.lit("")) for n in names])


def _ws(*names: str) -> Column:
    return F.concat_ws(" ", *[_c(n) for n in names])


def _blank(name: str) -> Column:
    return is_blank_text(_c(name))


PREDICATE = ("condition_norm", "subject_norm", "when_norm")
ACTION = ("then_norm", "else_norm")

EXTRACTED: dict[str, tuple[Column, str]] = {}
NORMALIZED: dict[str, tuple[Column, str]] = {}
BATTERY: dict[str, tuple[Column, str]] = {}
ABSTRACT: dict[str, tuple[Column, str]] = {}
LABELS: dict[str, tuple[Column, str]] = {}
CANDIDATES: dict[str, tuple[Column, str]] = {}


def _is(kind: str, name: str = "kind") -> Column:
    return _c(name) == kind


def _define() -> None:
    """Row checks by table; built on first use, when there is a session."""
    if EXTRACTED:
        return
    no_else = F.coalesce(~_c("has_else"), F.lit(False))
    # The patterns of the checks must equal those of the published checks.
    CANDIDATES.update(
        {
            "C-06": (~_c("kind").isin(*RULE_KIND) | _c("kind").isNull(), FAIL),
            "C-07": (_c("start_line").isNull() | _c("end_line").isNull() | (_c("start_line") < 1) | (_c("end_line") < _c("start_line")), FAIL),
        }
    )
    EXTRACTED.update(
        {
            "C-10": (_is("IF", "rule_type") & (_blank("condition_text") | _blank("then_text")), FAIL),
            "C-11": (_is("EVALUATE", "rule_type") & (_blank("subject_text") | _blank("when_text") | _blank("then_text")), FAIL),
            "C-12": (_is("EVALUATE", "rule_type") & _c("when_text").rlike(f"(^|{EDGE})({PREDICATE_VERBS})({EDGE}|$)"), REVIEW),
        }
    )
    NORMALIZED.update(
        {
            "C-15": (_all(*PREDICATE, *ACTION).rlike(f"(?i)(^|{EDGE})COPY({EDGE}|$)"), FAIL),
            "C-16": (_all(*PREDICATE, *ACTION).rlike(f"(?i)EXEC{SPACE}+(SQL|CICS)"), FAIL),
            "C-17": (_all(*PREDICATE).contains("EXEC_BLOCK_STUB"), FAIL),
            "C-18": (_all(*ACTION).rlike(r"EXEC_BLOCK_STUB[^ \t\n\r\f\x0B]"), FAIL),
            "C-19": (_all(*PREDICATE, *ACTION).rlike("<N[^>]|<S[^>P]|<SPACE[^>]|<ZERO[^>]|<<|>>"), FAIL),
            "C-20": (_is("IF") & (_blank("condition_norm") | _blank("then_norm")), FAIL),
            "C-21": ((_c("has_else") & _blank("else_norm")) | (no_else & ~_blank("else_norm")), FAIL),
            "C-22": (_is("EVALUATE") & (_blank("subject_norm") | _blank("when_norm") | _blank("then_norm")), FAIL),
            "C-27": (_c("canonical_key").isNull(), FAIL),
        }
    )
    go = f"(^|{SPACE})GO{SPACE}+TO({SPACE}|$)"
    BATTERY.update(
        {
            "C-42": (_ws(*ACTION).rlike("(?i)EXEC_BLOCK_STUBEXEC_BLOCK_STUB"), BY_HAND),
            "C-43": (_ws(*PREDICATE).rlike("(?i)EXEC_BLOCK_STUB"), BY_HAND),
            "C-44": (_ws(*PREDICATE, *ACTION).rlike(rf"(?i)(^|{SPACE})COPY({SPACE}|[.]|$)"), BY_HAND),
            "C-45": (_ws(*PREDICATE, *ACTION).rlike(f"(?i)(^|{SPACE})EXEC{SPACE}+(SQL|CICS)({SPACE}|$)|END-EXEC"), BY_HAND),
            "C-46": (_ws(*PREDICATE, *ACTION).rlike("<N[^>]|<S[^>P]|<SPACE[^>]|<ZERO[^>]|<<|>>"), BY_HAND),
            "C-47": (_is("IF") & (_blank("condition_norm") | _blank("then_norm")), BY_HAND),
            "C-48": ((_c("has_else") & _blank("else_norm")) | (no_else & ~_blank("else_norm")), BY_HAND),
            "C-49": (_is("EVALUATE") & (_blank("subject_norm") | _blank("when_norm") | _blank("then_norm")), BY_HAND),
            "C-50": (_is("EVALUATE") & _ws(*PREDICATE).rlike(f"(?i)(^|{SPACE})({BATTERY_VERBS})({SPACE}|$)|{go}"), BY_HAND),
            "C-51": (_ws(*ACTION).rlike(f"(?i)EXEC_BLOCK_STUB{SPACE}+EXEC_BLOCK_STUB"), BY_HAND),
            "C-55": (_ws(*ACTION).rlike(r"(?i)EXEC_BLOCK_STUB[A-Z0-9_(]|[A-Z0-9_)]EXEC_BLOCK_STUB"), BY_HAND),
        }
    )
    ABSTRACT.update(
        {
            "C-31": (_blank("abstract_predicate"), FAIL),
            "C-32": (_all("abstract_predicate", "abstract_then", "abstract_else").rlike("(^|[^A-Za-z0-9])VAR([^0-9]|$)"), FAIL),
        }
    )
    LABELS.update(
        {
            "C-36": (_c("pattern").isNull() | ~_c("pattern").isin(*PATTERNS), FAIL),
            "C-37": (_c("confidence").isNotNull() & ~_c("confidence").between(0, 1), FAIL),
            "C-38": (_all("title", "rule_summary").rlike("VAR[0-9]+|<N>|<S>|<ZERO>|<SPACE>"), FAIL),
        }
    )


def run_checks(df: DataFrame, stage: str, checks: dict[str, tuple[Column, str]], calm: str = OK, weight: str | None = None) -> DataFrame:
    """One row a check, from one pass over the table; weight: the column that says for how many instances a row stands."""
    number = (lambda c: F.coalesce(F.sum(F.when(c, F.col(weight))), F.lit(0)).cast("long")) if weight else F.count_if
    counts = df.agg(*[number(cond).alias(k) for k, (cond, _) in checks.items()])
    long = counts.unpivot([], list(checks), "check_id", "violations")
    word = F.lit(None).cast("string")
    for k, (_, w) in checks.items():
        word = F.when(F.col("check_id") == k, w).otherwise(word)
    return long.select("check_id", F.lit(stage).alias("stage"), "violations", F.when(F.col("violations") == 0, calm).otherwise(word).alias("status"))


def candidates(df: DataFrame) -> DataFrame:
    _define()
    return run_checks(df, "S3", CANDIDATES)


def extracted(df: DataFrame, weight: str | None = None) -> DataFrame:
    _define()
    return run_checks(df, "S4", EXTRACTED, weight=weight)


def normalized(df: DataFrame, weight: str | None = None) -> DataFrame:
    _define()
    return run_checks(df, "S5", NORMALIZED, weight=weight)


def battery(df: DataFrame, weight: str | None = None) -> DataFrame:
    """C-42 to C-51 and C-55 in one pass."""
    _define()
    return run_checks(df, "S5", BATTERY, CALM, weight)


def abstracts(df: DataFrame) -> DataFrame:
    _define()
    return run_checks(df, "S7", ABSTRACT)


def labels(df: DataFrame) -> DataFrame:
    _define()
    return run_checks(df, "S8", LABELS)


def one(check_id: str, stage: str, violations: DataFrame, fail: str = FAIL) -> DataFrame:
    """A check whose violations are the rows of a table."""
    n = violations.agg(count_rows().alias("violations"))
    return n.select(F.lit(check_id).alias("check_id"), F.lit(stage).alias("stage"), "violations", F.when(F.col("violations") == 0, OK).otherwise(fail).alias("status"))


def parse_results(programs: DataFrame, results: DataFrame) -> DataFrame:
    """C-01 to C-03."""
    c01 = _difference("C-01", "S2", programs.agg(count_rows().alias("a")), results.agg(count_rows().alias("b")))
    return c01.unionByName(one("C-02", "S2", missing(programs, results, ["program_id"]))).unionByName(one("C-03", "S2", duplicates(results, ["program_id"])))


def candidates_of_invalid(candidates_: DataFrame, results: DataFrame) -> DataFrame:
    """C-05: candidates whose program is not VALID, or unknown."""
    status = candidates_.join(results.select("program_id", "status"), "program_id", "left")
    return one("C-05", "S3", status.filter(~F.col("status").eqNullSafe(F.lit("VALID"))))


def glued_and_separate(rows: DataFrame) -> DataFrame:
    """C-52: stub markers without and with a blank between them."""
    stub = "EXEC_BLOCK_STUB"
    return rows.agg(F.count_if(_ws(*ACTION).rlike(f"(?i){stub}{stub}")).alias("glued"), F.count_if(_ws(*ACTION).rlike(f"(?i){stub}{SPACE}+{stub}")).alias("separate"))


def _difference(check_id: str, stage: str, a: DataFrame, b: DataFrame, at_most: bool = False) -> DataFrame:
    """A check that two one-row tables (a, b) hold the same number, or that a is at most b."""
    gap = F.greatest(F.col("a") - F.col("b"), F.lit(0)) if at_most else F.abs(F.col("a") - F.col("b"))
    # two rows added up, rather than joined: no nested loop in the plan
    both = a.select("a", F.lit(None).cast("long").alias("b")).unionByName(b.select(F.lit(None).cast("long").alias("a"), "b")).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    got = both.select(F.lit(check_id).alias("check_id"), F.lit(stage).alias("stage"), gap.cast("long").alias("violations"))
    return got.withColumn("status", F.when(F.col("violations") == 0, OK).otherwise(FAIL))


def key_format(patterns: DataFrame, key: str, check_id: str, stage: str) -> DataFrame:
    """C-24: keys are 64 hexadecimal digits."""
    # counted, not filtered: a filter on a key would be pushed below its aggregation, and compute the key once more
    return run_checks(patterns, stage, {check_id: (~F.col(key).rlike("^[0-9a-f]{64}$"), FAIL)})


def key_unique(patterns: DataFrame, key: str, check_id: str, stage: str) -> DataFrame:
    """C-25, C-30."""
    return one(check_id, stage, duplicates(patterns, [key]))


def conserved(rows: DataFrame, patterns: DataFrame, key: str, check_id: str, stage: str, weight: str | None = None) -> DataFrame:
    """C-26, C-33: the occurrences of all patterns are the rows that have a key."""
    keyed = F.sum(F.when(F.col(key).isNotNull(), F.col(weight))) if weight else F.count(key)
    return _difference(check_id, stage, patterns.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("a")), rows.agg(F.coalesce(keyed, F.lit(0)).alias("b")))


def not_more(patterns: DataFrame, canonical: DataFrame) -> DataFrame:
    """C-29: there are at most as many abstract patterns as canonical ones."""
    return _difference("C-29", "S7", patterns.agg(count_rows().alias("a")), canonical.agg(count_rows().alias("b")), True)


def mixed(rows: DataFrame) -> DataFrame:
    """C-28."""
    return one("C-28", "S6", mixed_keys(rows.filter("canonical_key IS NOT NULL"), ["canonical_key"], ["kind", "has_else"]))


def _by_keys(rows: DataFrame, keys: list[str], weight: str | None, **parts: Column) -> DataFrame:
    """Keyed rows grouped by each of the keys and as a whole in one pass: which (0 for the whole), key, n (rows with it) and the parts."""
    n = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    x = rows.select(*rows.columns, *[F.col(k).alias(f"_{k}") for k in keys])
    sets = [[f"_{k}"] for k in keys] + [[]]
    which = F.lit(0)
    for i, k in enumerate(keys, 1):
        which = F.when(F.grouping(f"_{k}") == 0, i).otherwise(which)
    held = [F.sum(F.when(F.col(k).isNotNull(), F.col(weight) if weight else F.lit(1))).alias(f"held_{i}") for i, k in enumerate(keys, 1)]
    got = x.groupingSets(sets, *[f"_{k}" for k in keys]).agg(which.alias("which"), n.cast("long").alias("n"), *held, *[c.alias(k) for k, c in parts.items()])
    return got.withColumn("key", F.coalesce(*[f"_{k}" for k in keys])).filter("which = 0 OR key IS NOT NULL")


def _told(counts: DataFrame, stage: str, checks: list[str]) -> DataFrame:
    long = counts.unpivot([], checks, "check_id", "violations")
    return long.select("check_id", F.lit(stage).alias("stage"), F.coalesce(F.col("violations"), F.lit(0)).cast("long").alias("violations"), F.when(F.coalesce("violations", F.lit(0)) == 0, OK).otherwise(FAIL).alias("status"))


def _of_patterns(which: int) -> tuple[Column, Column]:
    """Of the patterns under a key: how many keys occur more than once, and how far their occurrences are from the rows that have the key."""
    own = F.col("which") == which
    lost = F.abs(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)) - F.coalesce(F.sum(F.when(F.col("which") == 0, F.col(f"held_{which}"))), F.lit(0)))
    return F.count(F.when(own, F.col("key"))) - F.count_distinct(F.when(own, F.col("key"))), lost


def canonical_stage(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """C-24, C-25, C-26 and C-28 from one pass over the keyed rows."""
    mixed_ = (F.min("kind") != F.max("kind")) | (F.min("has_else") != F.max("has_else"))
    x = _by_keys(rows, ["canonical_key"], weight, mixed=mixed_)
    own = F.col("which") == 1
    twice, lost = _of_patterns(1)
    return _told(x.agg(F.count_if(own & ~F.col("key").rlike("^[0-9a-f]{64}$")).alias("C-24"), twice.alias("C-25"), lost.alias("C-26"), F.count_if(own & F.col("mixed")).alias("C-28")), "S6", ["C-24", "C-25", "C-26", "C-28"])


def abstract_stage(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """C-29 to C-33 from one pass over the keyed rows."""
    _define()
    texts = {c: F.min(c) for c in ("abstract_predicate", "abstract_then", "abstract_else")}
    x = _by_keys(rows, ["abstract_canonical_key", "canonical_key"], weight, **texts)
    own = F.col("which") == 1
    twice, lost = _of_patterns(1)
    more = F.greatest(F.count_if(own) - F.count_if(F.col("which") == 2), F.lit(0))
    checks = {"C-29": more, "C-30": twice, **{k: F.count_if(own & cond) for k, (cond, _) in ABSTRACT.items()}, "C-33": lost}
    return _told(x.agg(*[v.alias(k) for k, v in checks.items()]), "S7", list(checks))


def coverage(patterns: DataFrame, labels_: DataFrame) -> DataFrame:
    """C-34, C-35: patterns without a label; labels without a pattern."""
    return one("C-34", "S8", missing(patterns, labels_, ["abstract_canonical_key"])).unionByName(one("C-35", "S8", missing(labels_, patterns, ["abstract_canonical_key"])))


def unfinished_steps(metrics: DataFrame) -> DataFrame:
    """C-41."""
    return one("C-41", "Mon", metrics.filter(~F.col("batch_status").eqNullSafe(F.lit("COMPLETED"))))


def else_and_total(rows: DataFrame) -> DataFrame:
    """C-13, C-14 (for information): extracted rules with an else text, and all of them."""
    return rows.agg(F.count_if(~_blank("else_text")).alias("with_else"), count_rows().alias("total"))


def step_listing(metrics: DataFrame) -> DataFrame:
    """C-40."""
    return metrics.filter("step_name IS NOT NULL AND step_name <> 'Job'").orderBy(F.desc("start_time"))


def parser_errors(results: DataFrame, programs: DataFrame) -> DataFrame:
    """C-53, C-54: parser errors with their programs."""
    return results.filter("status = 'PARSER_ERROR'").join(programs.select("program_id", "path"), "program_id", "left").orderBy("path")


def reduction_percent(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """C-23."""
    a = rows.agg(count_rows().alias("normalized_rules"))
    b = patterns.agg(count_rows().alias("n")).scalar()
    return a.withColumn("canonical_patterns", b).withColumn("reduction_pct", exact2(100.0 * (1 - F.col("canonical_patterns") / F.nullif(F.col("normalized_rules"), F.lit(0)))))
