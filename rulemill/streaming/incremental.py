"""Incremental import as a file stream: each run takes the files that no earlier run has seen, then ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_source_extension, normalize_path, system_name
from ..operators import parse_stage

FILES = "path string, modificationTime timestamp, length long, content binary"


def source_stream(spark: SparkSession, folder: str, source_type: str, files_per_batch: int = 1000) -> DataFrame:
    """New source files below a folder, as rows of the programs table."""
    got = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    path = normalize_path(F.col("path"))
    return got.filter(has_source_extension(F.col("path"))).select(F.xxhash64(path).alias("id"), system_name(path).alias("system_name"), path.alias("path"), F.lit(source_type).alias("source_type"), "content")


def import_new(spark: SparkSession, folder: str, source_type: str, out: str, checkpoint: str) -> None:
    """Parse what is new and append it to the table of parsed programs (exactly once, by the file sink's log)."""
    parsed = parse_stage.parse(source_stream(spark, folder, source_type))
    parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
