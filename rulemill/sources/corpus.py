"""Sources and sinks: walks of source folders, CSV, tables of the stages (O-01 to O-25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import has_source_extension, normalize_path, system_name
from ..operators.relational import insert_missing, missing, upsert


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def scan(spark: SparkSession, root: str, folders: dict[str, str] | None = None) -> DataFrame:
    """O-01 to O-04, O-08: the source files below the known folders, with their bytes; missing folders are passed over."""
    found = None
    for folder, kind in (folders or S.SOURCE_TYPES).items():
        path = f"{root.rstrip('/')}/{folder}"
        if not exists(spark, path):
            continue
        got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content", F.lit(kind).alias("source_type"))
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], S.PROGRAMS)
    path = normalize_path(F.col("path"))
    return found.filter(has_source_extension(F.col("path"))).select(F.xxhash64(path).alias("id"), system_name(path).alias("system_name"), path.alias("path"), "source_type", "content")


def import_programs(old: DataFrame | None, found: DataFrame, mode: str = "incremental") -> DataFrame:
    """O-05 to O-07: none keeps the table, incremental adds unknown paths, full replaces it."""
    if mode == "none" and old is not None:
        return old
    if mode == "incremental" and old is not None:
        return insert_missing(old, found, ["path"])
    if mode not in ("none", "incremental", "full"):
        raise ValueError(f"unknown import mode {mode!r}")
    return found


def valid_utf8(content: str = "content"):
    """O-08: whether the bytes are text."""
    return F.is_valid_utf8(F.col(content).cast("string"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """O-20: text columns; quoted cells may span lines and hold doubled quotes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    return reader.csv(path, schema=schema) if schema else reader.option("inferSchema", False).csv(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """O-21: a report as one ordered CSV file (reports are small; large tables go to Parquet)."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_stage(df: DataFrame, path: str, part: str | None = None) -> None:
    """O-06, O-16, O-19: a stage's table, replacing what is there; with ``part`` only the parts (values of that column) that df has rows of."""
    out = df.write.mode("overwrite")
    (out.option("partitionOverwriteMode", "dynamic").partitionBy(part) if part else out).parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """O-09, O-11, O-15."""
    return spark.read.parquet(path)


def valid_programs(programs: DataFrame, results: DataFrame) -> DataFrame:
    """O-10, O-150: programs whose parse result is VALID."""
    return programs.join(results.filter("status = 'VALID'").select(F.col("program_id").alias("id")), "id")


def replace_programs_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """O-17, O-18: new rows of the programs that have any, old rows of the others."""
    return upsert(old, new, ["program_id"])


def missing_predicate(patterns: DataFrame) -> DataFrame:
    """O-13."""
    return patterns.filter("abstract_predicate IS NULL").orderBy(F.desc("occurrences"), "abstract_canonical_key")


def unknown_programs(found: DataFrame, old: DataFrame) -> DataFrame:
    return missing(found, old, ["path"])
