"""Deduplication of rules by content keys, in two levels (O-170, O-171), and the evidence for each pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.abstraction import with_abstract_key
from ..functions.keys import with_canonical_key
from ..functions.normalize import normalize_rules
from .relational import count_rows, top_k

RULE_COLUMNS = ["rule_type", "condition_text", "subject_text", "when_text", "then_text", "else_text"]


def keyed(rules: DataFrame) -> DataFrame:
    """S5 to S7 row by row: normalised columns, canonical and abstract keys."""
    return with_abstract_key(with_canonical_key(normalize_rules(rules)))


def keyed_distinct(rules: DataFrame) -> DataFrame:
    """The same over distinct raw rules with their number: text work runs once for each distinct text.

    Sources repeat themselves (copied paragraphs, generated code), so counting first is a partial aggregation
    on raw text, and the costly expressions see each text once.
    """
    return keyed(rules.groupBy(*RULE_COLUMNS).agg(count_rows().alias("weight")))


def canonical(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """O-170: one row a canonical key, with its number and the range of its complexity."""
    n = F.sum(weight) if weight else count_rows()
    mean = F.sum(F.col("complexity_score") * F.col(weight)) / F.sum(weight) if weight else F.avg("complexity_score")
    return rows.filter("canonical_key IS NOT NULL").groupBy("canonical_key").agg(
        F.min("kind").alias("kind"),
        F.min("condition_norm").alias("condition_norm"),
        F.min("subject_norm").alias("subject_norm"),
        F.min("then_norm").alias("then_norm"),
        F.min("else_norm").alias("else_norm"),
        F.bool_or("has_else").alias("has_else"),
        n.cast("int").alias("occurrences"),
        F.min("complexity_score").alias("min_complexity"),
        F.max("complexity_score").alias("max_complexity"),
        mean.alias("avg_complexity"),
    )


def abstract(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """O-171: one row an abstract key, with a canonical key that stands for it."""
    n = F.sum(weight) if weight else count_rows()
    return rows.filter("abstract_canonical_key IS NOT NULL").groupBy("abstract_canonical_key").agg(
        F.min("canonical_key").alias("canonical_key"),
        F.min("kind").alias("kind"),
        F.bool_or("has_else").alias("has_else"),
        F.min("abstract_predicate").alias("abstract_predicate"),
        F.min("abstract_then").alias("abstract_then"),
        F.min("abstract_else").alias("abstract_else"),
        n.cast("long").alias("occurrences"),
    )


def examples(rows: DataFrame, k: int = 3) -> DataFrame:
    """O-151: the first k rules of each abstract key, by program and line."""
    return top_k(rows, ["abstract_canonical_key"], ["program_id", "start_line", "end_line", "raw_snippet"], k)


def examples_of_raw(rules: DataFrame, order: list, key: str = "canonical_key", k: int = 3) -> DataFrame:
    """O-151 from raw rules: the first k of each key lie among the first k of each raw text, so only those are normalised."""
    return top_k(keyed(top_k(rules, RULE_COLUMNS, order, k).drop("rank")), [key], order, k)


def kind_summary(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """O-103: totals by kind."""
    return rows.agg(count_rows().alias("total"), F.count_if(F.col(kind) == "IF").alias("ifs"), F.count_if(F.col(kind) == "EVALUATE").alias("evaluates"))
