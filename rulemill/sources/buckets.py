"""Tables in hash buckets of a key, of which single buckets are replaced (O-16 to O-19).

A bucket is a partition folder.  ``replace`` reads and rewrites only the buckets of the keys it is given, by Spark's dynamic partition overwrite: the
new files are written beside the table and put in place when all of them are there, so a write that is killed leaves
the old rows.  Folders of buckets that have lost all rows go after that.

Rows go to their buckets by a rebalancing exchange: large buckets are written by several tasks (also where one key holds much of the table), small ones
together.  ``count`` decides how much a change rewrites, so it should grow with the table: 64 suit some gigabytes.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .corpus import exists

BUCKET = "bucket"
_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names, removed when the driver ends; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="rulemill-scratch-")
        spark.conf.set("spark.checkpoint.dir", shared)
    if not _SCRATCH:
        atexit.register(_remove)
    _SCRATCH.append((spark, f"{shared}/rulemill-{uuid.uuid4().hex}"))
    return _SCRATCH[-1][1]


def holder(spark: SparkSession):
    """A function (name, rows) that writes rows as a table in a new scratch folder and gives the table back."""
    folder = scratch(spark)

    def hold(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    return hold


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove() -> None:
    for spark, path in _SCRATCH:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


class Buckets:
    """A table below ``path`` with the buckets of one key column; ``count`` must stay as it was when the table was written."""

    def __init__(self, spark: SparkSession, path: str, key: str, count: int = 64):
        self.spark, self.path, self.key, self.count = spark, path.rstrip("/"), key, count

    def of(self, key: Column | None = None) -> Column:
        """The bucket of a key; nulls have one too."""
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.count)).cast("int")

    def exists(self) -> bool:
        return exists(self.spark, f"{self.path}/_SUCCESS")

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows, of some buckets only where they are named (other folders are not listed among the files to read)."""
        rows = self.spark.read.schema(self._schema()).parquet(self.path)
        rows = rows.filter(F.col(BUCKET).isin(list(buckets))) if buckets is not None else rows
        return rows.drop(BUCKET)

    def write(self, rows: DataFrame) -> int:
        """All rows anew; their number, counted as they pass."""
        number = self._put(rows, "static")["n"]
        # a table may lose all its files, but not its columns
        columns = rows.withColumn(BUCKET, self.of()).schema.json()
        files, path = self._columns()
        out = files.create(path, True)
        out.write(bytearray(columns, "utf-8"))
        out.close()
        return number

    def _columns(self):
        """The file system of the table, and where its columns are written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_schema.json")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _schema(self) -> StructType:
        files, path = self._columns()
        opened = files.open(path)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
        opened.close()
        return StructType.fromJson(json.loads(text))

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that the keys fall in, ``count`` of them at most."""
        return sorted(r[BUCKET] for r in keys.select(self.of().alias(BUCKET)).distinct().collect())

    def replace(self, rows: DataFrame, keys: DataFrame) -> list[int]:
        """``rows`` instead of all rows of ``keys`` (which may have none any more); the buckets that were rewritten."""
        buckets = self.touched(keys.select(self.key).unionByName(rows.select(self.key)))
        gone = keys.select(F.col(self.key).alias("_key")).distinct()
        old = self.read(buckets)
        kept = old.join(gone, old[self.key].eqNullSafe(F.col("_key")), "left_anti")
        self.put(kept.unionByName(rows), buckets)
        return buckets

    def put(self, rows: DataFrame, buckets: Sequence[int]) -> None:
        """These rows instead of all rows of the buckets."""
        if not buckets:
            return
        left = set(self._put(rows, "dynamic")["b"] or [])
        for b in set(buckets) - left:
            _delete(self.spark, f"{self.path}/{BUCKET}={b}")

    def _put(self, rows: DataFrame, mode: str) -> dict:
        seen = Observation()
        rows = rows.withColumn(BUCKET, self.of()).hint("rebalance", BUCKET).observe(seen, F.collect_set(BUCKET).alias("b"), F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(BUCKET).parquet(self.path)
        return seen.get
