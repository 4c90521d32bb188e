"""Import by manifest: files are told apart by path, length and time of change; only new and changed ones are read (O-01, O-05, O-08).

Listing reads no content: Spark's binary source opens a file only for the column ``content``.  The paths to read come from a
comparison of two listings, and the second pass reads those files alone.  Spark's own listing of a folder is held
by the driver, so the list of paths to read is no larger than what is there already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_source_extension, normalize_path, system_name
from ..schemas import SOURCE_TYPES
from .buckets import Buckets
from .corpus import exists

MANIFEST = "path string, length long, modified timestamp, source_type string"


def listed(spark: SparkSession, root: str, folders: dict[str, str] | None = None) -> DataFrame:
    """MANIFEST of the source files below the known folders, without their content; missing folders are passed over."""
    found = spark.createDataFrame([], MANIFEST)
    for folder, kind in (folders or SOURCE_TYPES).items():
        path = f"{root.rstrip('/')}/{folder}"
        if exists(spark, path):
            got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            got = got.filter(has_source_extension(F.col("path"))).select("path", "length", F.col("modificationTime").alias("modified"), F.lit(kind).alias("source_type"))
            found = found.unionByName(got)
    return found


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change (new, changed, vanished, same) of every file of two listings."""
    a = old.select("path", F.struct("length", "modified").alias("was"))
    b = new.select("path", F.struct("length", "modified").alias("now"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "vanished").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return a.join(b, "path", "full").select("path", change.alias("change"))


def contents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The programs of the listed files (path, source_type), read now."""
    paths = [r["path"] for r in files.select("path").collect()]
    kinds = files.select(F.col("path").alias("_path"), "source_type")
    if not paths:
        return spark.createDataFrame([], "id long, system_name string, path string, source_type string, content binary")
    got = spark.read.format("binaryFile").load(paths).select("path", "content").join(kinds, F.col("path") == F.col("_path"))
    path = normalize_path(F.col("path"))
    return got.select(F.xxhash64(path).alias("id"), system_name(path).alias("system_name"), path.alias("path"), "source_type", "content")


class Import:
    """The table of programs of a folder and its manifest, brought up to date."""

    def __init__(self, spark: SparkSession, root: str, out: str, folders: dict[str, str] | None = None):
        self.spark, self.root, self.out, self.folders = spark, root, out.rstrip("/"), folders

    def manifest(self) -> DataFrame:
        path = f"{self.out}/manifest"
        return self.spark.read.schema(MANIFEST).parquet(path) if exists(self.spark, f"{path}/_SUCCESS") else self.spark.createDataFrame([], MANIFEST)

    def programs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/programs")

    def update(self, drop_vanished: bool = True) -> dict[str, int]:
        """Reads what is new or changed; the numbers of files by change.

        Only the buckets that hold a new, changed or vanished file are rewritten.  The manifest is written last, so that an
        import that broke off is taken up by the next one.
        """
        now = listed(self.spark, self.root, self.folders)
        rows = [r.asDict() for r in now.collect()]  # the driver holds this listing already
        now = self.spark.createDataFrame(rows, MANIFEST) if rows else now
        changes = compared(self.manifest(), now)
        counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        fresh = now.join(changes.filter("change IN ('new', 'changed')"), "path", "left_semi")
        table = Buckets(self.spark, f"{self.out}/programs", "path")
        read = contents(self.spark, fresh)
        if not table.exists():
            table.write(read)
        elif counts.get("new", 0) + counts.get("changed", 0) + counts.get("vanished", 0):
            gone = changes.filter("change = 'changed'" + (" OR change = 'vanished'" if drop_vanished else "")).select(normalize_path(F.col("path")).alias("path"))
            table.replace(read, gone)
        now.write.mode("overwrite").parquet(f"{self.out}/manifest")
        return counts
