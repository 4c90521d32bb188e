"""Asking a labeler: each prompt once, a bounded number of calls at a time, answers kept (O-213, O-219).

Answers are a table under a hash of run, model, attempt and prompt.  Equal prompts are asked once; what the table has is not asked again,
also after a run that was killed: prompts go in slices of ``batch``, and each slice's answers are written before the next one starts.  A task
that is lost asks its part of a slice again.

A task has ``in_flight`` calls at a time, and begins them at its share of ``per_second``.  A call is tried ``attempts`` times while
it fails for a passing reason (``labels.TransientError``); a prompt that got no answer is not stored, so the next run asks it again.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import exists
from .labels import call

ANSWER = "prompt_key string, response string"


class Exchange:
    def __init__(self, spark: SparkSession, path: str, labeler: Callable[[dict], str], run_id: str = "run_1", model: str = "offline", attempts: int = 5, pause: float = 2.0, in_flight: int = 4, per_second: float | None = None, tasks: int | None = None, batch: int = 10_000):
        self.spark, self.path, self.labeler, self.run_id, self.model = spark, path.rstrip("/"), labeler, run_id, model
        self.attempts, self.pause, self.in_flight, self.per_second, self.batch = attempts, pause, in_flight, per_second, batch
        self.tasks = tasks or spark.sparkContext.defaultParallelism

    def answers(self) -> DataFrame:
        return self.spark.read.schema(ANSWER).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], ANSWER)

    def keyed(self, rows: DataFrame, attempt: int) -> DataFrame:
        return rows.withColumn("prompt_key", F.sha2(F.concat_ws("\x1f", F.lit(self.run_id), F.lit(self.model), F.lit(str(attempt)), "prompt"), 256))

    def ask(self, rows: DataFrame, attempt: int = 1) -> DataFrame:
        """The rows with a column response; null where none came."""
        rows = self.keyed(rows, attempt)
        todo = rows.dropDuplicates(["prompt_key"]).join(self.answers().select("prompt_key"), "prompt_key", "left_anti")
        slices = -(-todo.count() // self.batch)
        for k in range(slices):
            part = todo.filter(F.pmod(F.xxhash64("prompt_key"), F.lit(slices)) == k)
            self._called(part).write.mode("append").parquet(self.path)
        return rows.join(self.answers(), "prompt_key", "left").drop("prompt_key")

    def _called(self, rows: DataFrame) -> DataFrame:
        labeler, attempts, pause, in_flight = self.labeler, self.attempts, self.pause, self.in_flight
        space = self.tasks / self.per_second if self.per_second else 0.0

        def run(batches):
            lock, due = threading.Lock(), [0.0]

            def one(row: dict) -> str | None:
                with lock:  # calls begin one after the other, each at its time
                    due[0] = max(due[0] + space, time.monotonic())
                    wait = due[0] - time.monotonic()
                time.sleep(max(wait, 0.0))
                return call(labeler, row, attempts, pause)

            with ThreadPoolExecutor(in_flight) as pool:
                for b in batches:
                    got = pa.array(list(pool.map(one, b.to_pylist())), pa.string())
                    yield pa.RecordBatch.from_arrays([b["prompt_key"], got], names=["prompt_key", "response"]).filter(got.is_valid())

        return rows.repartition(self.tasks, "prompt_key").mapInArrow(run, ANSWER)
