"""Structural abstraction: identifiers become VAR1, VAR2 ... in the order of first appearance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import canonical_key
from .text import strip_controls

# Words that stay as they are; other identifiers are abstracted.
RESERVED = """
TRUE FALSE OTHER ALSO
AND OR NOT
MOVE PERFORM CALL ADD SUBTRACT MULTIPLY DIVIDE
COMPUTE DISPLAY SET INITIALIZE STRING UNSTRING
READ WRITE REWRITE DELETE OPEN CLOSE START
ACCEPT INSPECT
EXEC NEXT SENTENCE CONTINUE STOP RUN
GOBACK EXIT GO TO
IF THEN ELSE END-IF
EVALUATE WHEN END-EVALUATE
END-COMPUTE END-CALL
ON EXCEPTION
THRU THROUGH USING INTO BY SIZE DELIMITED
LENGTH OF FUNCTION
REPLACING ALL
UPPER-CASE
IS EQUAL GREATER LESS THAN
NUMERIC ALPHABETIC POSITIVE NEGATIVE
ZERO ZEROS SPACE SPACES
HIGH-VALUE HIGH-VALUES LOW-VALUE LOW-VALUES
""".split()
# Placeholders of the normalisation.
PLACEHOLDERS = ("<N>", "<S>", "<ZERO>", "<SPACE>")

_CHAR = r"(?:(?!>=|<=|<>)[^\s=(),.:+*/-])"
#: Two-character signs, single signs, words (a hyphen belongs to a word if a letter or digit follows), hyphens.
TOKEN = rf">=|<=|<>|[=(),.:+*/]|{_CHAR}(?:{_CHAR}|-(?=[\p{{L}}\p{{Nd}}]))*|-"


def tokens(c: Column) -> Column:
    """O-132."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def is_identifier(t: Column) -> Column:
    """O-133, O-137: what is abstracted."""
    return t.rlike("^[A-Z][A-Z0-9-]*$") & ~t.isin(*RESERVED)


def pretty(ts: Column) -> Column:
    """O-138: tokens in one text, closing signs close to what is before them, opening ones to what follows."""
    return F.replace(F.regexp_replace(F.array_join(ts, " "), r" ([),.:])", "$1"), F.lit("( "), F.lit("("))


def _named(ts: Column, ids: Column) -> Column:
    def one(t: Column) -> Column:
        number, quoted = t.rlike(r"^[+-]?\d+(\.\d+)?$"), t.rlike("^'.*'$")
        return (
            F.when(t.isin(*PLACEHOLDERS), t)
            .when(number, F.lit("<N>"))
            .when(quoted, F.lit("<S>"))
            .when(is_identifier(t), F.concat(F.lit("VAR"), F.array_position(ids, t).cast("string")))
            .otherwise(t)
        )

    return F.transform(ts, one)


def _or_null(c: Column, out: Column) -> Column:
    return F.when(c.isNotNull() & (strip_controls(c) != ""), out)


def with_abstract_parts(df, parts: dict[str, Column]):
    """O-134 to O-136: adds a column for each text, with one numbering over all of them in the order given; blank ones are null.

    Tokens and identifiers are columns of their own: inside a lambda they would be computed for each token.
    """
    kept = df.columns
    x = df.withColumns({f"_text{i}": c for i, c in enumerate(parts.values())})
    x = x.withColumns({f"_tokens{i}": tokens(F.coalesce(F.upper(strip_controls(F.col(f"_text{i}"))), F.lit(""))) for i in range(len(parts))})
    x = x.withColumn("_ids", F.array_distinct(F.filter(F.concat(*[F.col(f"_tokens{i}") for i in range(len(parts))]), is_identifier)))
    out = {n: _or_null(F.col(f"_text{i}"), pretty(_named(F.col(f"_tokens{i}"), F.col("_ids")))) for i, n in enumerate(parts)}
    return x.select(*kept, *[c.alias(n) for n, c in out.items()])


def with_abstract_key(rules):
    """O-135 to O-139: adds abstract_predicate, abstract_then, abstract_else and abstract_canonical_key."""
    c = F.col
    evaluate = c("kind") == "EVALUATE"
    head = F.when(evaluate, c("subject_norm")).otherwise(c("condition_norm"))
    when = F.when(evaluate, c("when_norm"))
    x = with_abstract_parts(rules, {"_head": head, "_when": when, "abstract_then": c("then_norm"), "abstract_else": c("else_norm")})
    joined = F.concat(F.coalesce(c("_head"), F.lit("")), F.lit(" | WHEN | "), F.coalesce(c("_when"), F.lit("")))
    x = x.withColumn("abstract_predicate", F.when(evaluate, joined).otherwise(c("_head"))).drop("_head", "_when")
    return x.withColumn("abstract_canonical_key", canonical_key(c("kind"), c("abstract_predicate"), c("abstract_then"), c("abstract_else"), c("has_else")))
