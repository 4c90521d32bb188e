"""Generic table operators: joins, shares, top-k, duplicates, upserts, validity checks (O-05, O-17 to O-24, O-150 to O-200)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_rows() -> Column:
    return F.count(F.lit(1))


def exact2(c: Column) -> Column:
    """Two decimals, ties away from zero on the decimal value: the same on every engine."""
    return F.round(c.cast("decimal(18,6)"), 2).cast("double")


def is_blank_text(c: Column) -> Column:
    """Null, empty or blanks."""
    return c.isNull() | (F.btrim(c) == "")


def share_of_total(df: DataFrame, keys: Sequence[str], count: str = "n", share: str = "pct") -> DataFrame:
    """O-190: rows of each group and their percentage of all.  The window runs over the groups, not the rows."""
    got = df.groupBy(*keys).agg(count_rows().alias(count))
    return got.withColumn(share, exact2(100.0 * F.col(count) / F.sum(count).over(W.partitionBy())))


def share_within(df: DataFrame, outer: Sequence[str], inner: Sequence[str], count: str = "n", share: str = "pct") -> DataFrame:
    """O-191: rows of each inner group and their percentage of the outer one."""
    got = df.groupBy(*outer, *inner).agg(count_rows().alias(count))
    return got.withColumn(share, exact2(100.0 * F.col(count) / F.sum(count).over(W.partitionBy(*outer))))


def missing(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """O-05, O-152, O-153: rows of left without a partner."""
    return left.join(right.select(*on), list(on), "left_anti")


def present(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """O-161: rows of left with a partner, each once."""
    return left.join(right.select(*on), list(on), "left_semi")


def differs(left: DataFrame, right: DataFrame, on: Sequence[str], a: str, b: str) -> DataFrame:
    """O-154: rows of left whose a is distinct from b of their partner; none counts as null."""
    return left.join(right, list(on), "left").filter(~F.col(a).eqNullSafe(F.col(b)))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """O-173: keys that occur more than once."""
    return df.groupBy(*keys).agg(count_rows().alias("n")).filter("n > 1")


def mixed_keys(df: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """O-174: keys under which an attribute has several values."""
    spread = [F.count_distinct(a).alias(f"n_{a}") for a in attributes]
    several = " OR ".join(f"n_{a} > 1" for a in attributes)
    return df.groupBy(*keys).agg(*spread).filter(several)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, rank: str = "rank") -> DataFrame:
    """O-151, O-194: the first k rows of each key (row_number <= k prunes inside the sort of each task)."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def top_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """O-195: the first n rows."""
    return df.orderBy(*order).limit(n)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """O-17, O-18: all new rows, and the old rows of keys that are not among them."""
    return missing(old, new, keys).unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """O-05: old rows, and the new rows of keys that are not there yet (one a key)."""
    return old.unionByName(missing(new, old, keys).dropDuplicates(list(keys)))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    """O-196."""
    return df.unpivot(list(ids), list(values), name, value)


def with_grand_total(df: DataFrame, key: str, total: DataFrame, label: str) -> DataFrame:
    """O-180: a report's rows and its total row."""
    return df.unionByName(total.withColumn(key, F.lit(label)).select(*df.columns))


def ranked_by(c: Column, order: Sequence[str]) -> Column:
    """O-193: a sort key that follows a given order of values."""
    out = F.lit(len(order) + 1)
    for i, v in reversed(list(enumerate(order, 1))):
        out = F.when(c == v, F.lit(i)).otherwise(out)
    return out


def typed_ratings(raw: DataFrame) -> DataFrame:
    """O-22: rating rows from text: trimmed, whole numbers, decimal commas, empty to null."""
    t = lambda c: F.btrim(F.col(c))
    grades = [F.try_to_number(t(f), F.lit("999")).cast("short").alias(f) for f in ("f1", "f2", "f3", "f4")]
    mean = F.replace(t("mittelwert"), F.lit(","), F.lit(".")).try_cast("decimal(4,2)").alias("mittelwert")
    return raw.select(t("sample_no").try_cast("int").alias("sample_no"), t("evaluator").alias("evaluator"), t("erfahrung").alias("erfahrung"), *grades, mean, F.nullif(t("kommentar"), F.lit("")).alias("kommentar"))


def rating_violations(ratings: DataFrame) -> DataFrame:
    """O-23: rows that break a range or domain, with the rule that they break first."""
    bad = F.when(~F.col("sample_no").between(1, 30), "sample_no").when(~F.col("evaluator").isin("E1", "E2", "E3", "E4", "E5"), "evaluator")
    for f in ("f1", "f2", "f3", "f4"):
        bad = bad.when(~F.col(f).between(1, 5), f)
    return ratings.withColumn("broken", bad).filter("broken IS NOT NULL")


def columns_of(tables: dict[str, DataFrame]) -> DataFrame:
    """O-25: the columns of named tables."""
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema, 1)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, ordinal_position int, column_name string, data_type string")


def inherit_next(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """O-98 over a table: a null takes the next value of its group that is not null."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.currentRow, W.unboundedFollowing)
    return df.withColumn(out, F.first(value, ignorenulls=True).over(w))


# Lookups over a table of programs (O-24).


def find_by(df: DataFrame, column: str, value, ignore_case: bool = False) -> DataFrame:
    c = F.col(column)
    return df.filter(F.lower(c) == str(value).lower()) if ignore_case else df.filter(c == value)


def exists_by(df: DataFrame, column: str, value, ignore_case: bool = False) -> bool:
    return not find_by(df, column, value, ignore_case).isEmpty()


def first_by_id(df: DataFrame) -> DataFrame:
    return df.orderBy("id").limit(1)


def delete_by(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))
