"""Content keys of rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze, strip_controls


def _part(c: Column) -> Column:
    return F.coalesce(squeeze(strip_controls(c)), F.lit(""))


def canonical_key(kind: Column, predicate: Column, then: Column, otherwise: Column, has_else: Column) -> Column:
    """O-130: SHA-256 over kind, else flag, predicate and branches, null and empty alike."""
    flag = F.when(F.coalesce(has_else, F.lit(False)), "1").otherwise("0")
    key = F.sha2(F.concat_ws("|", _part(kind), flag, _part(predicate), _part(then), _part(otherwise)).cast("binary"), 256)
    return F.coalesce(key, F.lit(""))  # never null, and known to be: filters on it fold away


def canonical_predicate(kind: Column, condition: Column, subject: Column, when: Column) -> Column:
    """O-131: the condition, or subject|WHEN|when of an EVALUATE branch."""
    return F.when(kind == "EVALUATE", F.concat(F.coalesce(subject, F.lit("")), F.lit("|WHEN|"), F.coalesce(when, F.lit("")))).otherwise(condition)


def with_canonical_key(rules):
    c = F.col
    return rules.withColumn("canonical_key", canonical_key(c("kind"), canonical_predicate(c("kind"), c("condition_norm"), c("subject_norm"), c("when_norm")), c("then_norm"), c("else_norm"), c("has_else")))
