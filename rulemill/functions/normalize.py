"""Normalisation of conditions and actions: operator words, literals, statement counts, complexity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, squeeze, strip_controls

# Operator words and their signs, longest phrases first; they count only between blanks.
OPERATOR_WORDS = (
    (" IS EQUAL TO ", " = "),
    (" IS NOT EQUAL TO ", " <> "),
    (" IS GREATER THAN OR EQUAL TO ", " >= "),
    (" IS LESS THAN OR EQUAL TO ", " <= "),
    (" IS GREATER THAN ", " > "),
    (" IS LESS THAN ", " < "),
    (" EQUAL TO ", " = "),
    (" EQUAL ", " = "),
    (" GREATER THAN ", " > "),
    (" LESS THAN ", " < "),
)
# The verbs that count as statements.
COUNTED_VERBS = ("MOVE", "PERFORM", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "COMPUTE", "DISPLAY", "CALL", "EXEC_BLOCK_STUB")
# Literals, in the order in which they are generalised.
LITERALS = (
    (r'"[^"]*"(?:"[^"]*")*', "<S>"),
    (r"'[^']*'(?:'[^']*')*", "<S>"),
    (r"(?<![A-Z0-9_-])[+-]?\d+(?:\.\d+)?(?![A-Z0-9_-])", "<N>"),
    (r"(?<!<)\bZERO(?:S|ES)?\b(?!>)", "<ZERO>"),
    (r"(?<!<)\bSPACES?\b(?!>)", "<SPACE>"),
    (r"<+ZERO>+", "<ZERO>"),
    (r"<+SPACE>+", "<SPACE>"),
)
STUB = "EXEC_BLOCK_STUB"


def _each(c: Column, pairs) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, *p), pairs, c)


def operator_words(c: Column) -> Column:
    """O-111."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), OPERATOR_WORDS, c)


def generalize_literals(c: Column) -> Column:
    """O-112: string, number and figurative literals to placeholders."""
    return strip_controls(squeeze(_each(c, LITERALS)))


def norm_predicate(c: Column) -> Column:
    """O-110: a condition without its inline comment, in upper case, with signs and placeholders; blank is null."""
    text = squeeze(F.upper(strip_controls(F.substring_index(c, "*>", 1))))
    return let(generalize_literals(operator_words(text)), lambda out: F.when(out != "", out))


def separate_stubs(c: Column) -> Column:
    """A blank between a stub marker and a word it is glued to."""
    return _each(c, ((rf"{STUB}(?=[A-Z0-9_(])", f"{STUB} "), (rf"(?<=[A-Z0-9_)]){STUB}", f" {STUB}")))


def norm_action(c: Column) -> Column:
    """O-113: an action block in one form; a lone CONTINUE stays, others go, and so do COPY stubs."""
    text = squeeze(F.upper(strip_controls(c)))
    stubs = (
        (rf"\bDISPLAY\s+[\"']{STUB}[\"']\s*\.?", f" {STUB} "),
        (r"\*>\s*EXEC\s+BLOCK\s+STUB\.?\s*", f" {STUB} "),
        (r"\bEXEC\s+BLOCK\s+STUB\b", f" {STUB} "),
    )
    gone = ((r"^\*>\s*COPY STUB\.?\s*$", ""), (r"\bDISPLAY\s+[\"']COPY_STUB[\"']\s*\.?", ""), (r"\bCONTINUE\b\.?\s*", ""))

    def rest(t: Column) -> Column:
        body = strip_controls(squeeze(_each(separate_stubs(_each(t, stubs)), gone)))
        return strip_controls(squeeze(separate_stubs(generalize_literals(body))))

    return let(text, lambda t: F.when(t.rlike(r"^CONTINUE\s*\.?$"), F.lit("CONTINUE")).otherwise(let(rest(t), lambda out: F.when(out != "", out))))


def occurrences(c: Column, needle: str) -> Column:
    """O-115: how often a text holds another, not overlapping; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(rf"\Q{needle}\E")), F.lit(0))


def statement_count(c: Column) -> Column:
    """O-114: counted verbs between blanks."""
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    return reduce(lambda a, b: a + b, [occurrences(padded, f" {v} ") for v in COUNTED_VERBS]).cast("int")


def complexity(predicate: Column, then_count: Column, else_count: Column) -> Column:
    """O-116: 1, one for each AND, OR and NOT, and one for every three statements of a branch."""
    words = sum((occurrences(predicate, f" {w} ") for w in ("AND", "OR", "NOT")), F.lit(0))
    return (F.lit(1) + words + F.floor(then_count / 3) + F.floor(else_count / 3)).cast("int")


def evaluate_predicate(subject: Column, when: Column) -> Column:
    """O-117: subject and WHEN in one text, for the complexity."""
    return F.btrim(F.concat(F.coalesce(subject, F.lit("")), F.lit(" | WHEN | "), F.coalesce(when, F.lit(""))))


def safe_mode(c: Column) -> Column:
    """O-118: FULL for null or unknown parse modes."""
    up = F.upper(strip_controls(c))
    return F.when(up.isin("FULL", "PROCEDURE_ONLY"), up).otherwise(F.lit("FULL"))


def safe_kind(c: Column) -> Column:
    """O-118: EVALUATE where the text says so, else IF."""
    return F.when(F.upper(c).contains("EVALUATE"), F.lit("EVALUATE")).otherwise(F.lit("IF"))


def normalize_rules(rules):
    """O-110 to O-120 over extracted rules: adds the normalised columns, keeps the others."""
    evaluate = F.col("kind") == "EVALUATE"
    when = F.when(F.upper(strip_controls(F.col("when_text"))) == "OTHER", F.lit("OTHER")).otherwise(norm_predicate(F.col("when_text")))
    x = rules.withColumn("kind", safe_kind(F.col("rule_type"))).withColumns(
        {"subject_norm": F.when(evaluate, norm_predicate(F.col("subject_text"))), "when_norm": F.when(evaluate, when), "then_norm": norm_action(F.col("then_text")), "else_norm": norm_action(F.col("else_text"))}
    )
    x = x.withColumn("condition_norm", F.when(evaluate, F.col("when_norm")).otherwise(norm_predicate(F.col("condition_text"))))
    x = x.withColumns({"has_else": F.col("else_norm").isNotNull(), "then_stmt_count": F.coalesce(statement_count(F.col("then_norm")), F.lit(0)), "else_stmt_count": F.coalesce(statement_count(F.col("else_norm")), F.lit(0))})
    joined = F.when(evaluate, evaluate_predicate(F.col("subject_norm"), F.col("when_norm"))).otherwise(F.col("condition_norm"))
    return x.withColumn("complexity_score", complexity(joined, F.col("then_stmt_count"), F.col("else_stmt_count")))
