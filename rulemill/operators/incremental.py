"""Canonical and abstract rules kept up to date by what was added and removed (O-170, O-171).

The stored state counts equal rows: one for each key and each combination of the columns that a rebuild aggregates.  Counts can be taken
back, which minima and maxima cannot; with the counts by value they follow again.  A key is a hash of normalised content, so it
has few such combinations, however many rules there are.

A delta is aggregated first (added rules count 1, removed ones -1).  Only the buckets of its keys are read, merged and rewritten,
in the state and in the result.  Removing what is not there has no effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import Buckets
from . import rules

CANONICAL = ("kind", "condition_norm", "subject_norm", "then_norm", "else_norm", "has_else", "complexity_score")
ABSTRACT = ("canonical_key", "kind", "has_else", "abstract_predicate", "abstract_then", "abstract_else")
WEIGHT = "weight"


def counted(rows: DataFrame, key: str, columns: tuple[str, ...], sign: int = 1, weight: str | None = None) -> DataFrame:
    """Equal rows and their number (times the sign); ``weight``: the column that says for how many a row stands; rows without a key have no part."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return rows.filter(F.col(key).isNotNull()).groupBy(key, *columns).agg((F.lit(sign) * n).alias(WEIGHT))


def merged(state: DataFrame, delta: DataFrame) -> DataFrame:
    keys = [c for c in state.columns if c != WEIGHT]
    return state.unionByName(delta).groupBy(*keys).agg(F.sum(WEIGHT).alias(WEIGHT)).filter(F.col(WEIGHT) > 0)


class Rebuilt:
    """One level of deduplication: its state and its result, each a table in buckets of the key."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: tuple[str, ...], aggregate: Callable[[DataFrame, str], DataFrame], count: int = 64):
        self.key, self.columns, self.aggregate = key, columns, aggregate
        self.state = Buckets(spark, f"{path.rstrip('/')}/state", key, count)
        self.result = Buckets(spark, f"{path.rstrip('/')}/result", key, count)

    def rebuild(self, rows: DataFrame, weight: str | None = None) -> int:
        """From all rows; the number of keys."""
        self.state.write(counted(rows, self.key, self.columns, weight=weight))
        return self.result.write(self.aggregate(self.state.read(), WEIGHT))

    def apply(self, added: DataFrame, removed: DataFrame, weight: str | None = None) -> list[int]:
        """After a change: the rows that came and those that went; the buckets that were rewritten."""
        delta = counted(added, self.key, self.columns, 1, weight).unionByName(counted(removed, self.key, self.columns, -1, weight))
        delta = delta.groupBy(self.key, *self.columns).agg(F.sum(WEIGHT).alias(WEIGHT)).filter(F.col(WEIGHT) != 0)
        buckets = self.state.touched(delta)
        if buckets:
            self.state.put(self.plan(delta, buckets), buckets)
            # the buckets of the state and of the result are the same, so the result follows from the new state alone
            self.result.put(self.aggregate(self.state.read(buckets), WEIGHT), buckets)
        return buckets

    def plan(self, delta: DataFrame, buckets: list[int]) -> DataFrame:
        return merged(self.state.read(buckets), delta)

    def read(self) -> DataFrame:
        return self.result.read()


def canonical(spark: SparkSession, path: str, count: int = 64) -> Rebuilt:
    """O-170; rows as ``rules.keyed`` gives them."""
    return Rebuilt(spark, path, "canonical_key", CANONICAL, rules.canonical, count)


def abstract(spark: SparkSession, path: str, count: int = 64) -> Rebuilt:
    """O-171."""
    return Rebuilt(spark, path, "abstract_canonical_key", ABSTRACT, rules.abstract, count)
