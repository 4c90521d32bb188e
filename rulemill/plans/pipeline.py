"""

Every stage reads its predecessor's table and replaces its own; a stage whose table is complete is passed over
with resume=True, so a run that broke off goes on where it stopped.  Files that fail become rows with a status,
patterns that fail become rejects with a reason; neither ends the run.  Labels and rejects are kept by run_id, so several runs stand side by side
(``reports.agreement`` compares them); a run asks only for patterns that it has no label of.  Each step leaves a row of
metrics when it ends, FAILED included, and each run a row for the job.

Stage tables by program lie in buckets of it, and the canonical and abstract rules are kept with counts that can be taken back: ``refresh`` parses
some programs anew and brings all of them up to date, reading and rewriting only the buckets that those programs and their keys fall in.
``skip_limit`` ends a run in which more files than that failed for a reason that no status foresees.
"""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import exchange, incremental, labels, parse_stage, rules
from ..sources import corpus
from ..sources.buckets import Buckets

STEPS = ("programs", "parsed", "parse_results", "candidates", "extracted", "normalized", "canonical", "abstract", "labels")
#: The table whose rows a step reads, where there is one.
SOURCES = {"parsed": "programs", "parse_results": "parsed", "candidates": "parsed", "extracted": "parsed", "normalized": "extracted", "canonical": "normalized", "abstract": "normalized", "labels": "abstract"}
JOB = "decisionRuleJob"
#: Tables in buckets of a program, with the column that names it; and those that are merged.
BY_PROGRAM = {"parsed": "id", "parse_results": "program_id", "candidates": "program_id", "extracted": "program_id", "normalized": "program_id"}
MERGED = {"canonical": incremental.canonical, "abstract": incremental.abstract}
#: Tables that are kept by run_id, with their columns.
BY_RUN = {"labels": S.LABEL, "rejected": "abstract_canonical_key string, reason string, run_id string"}


class SkipLimitError(Exception):
    """More files failed than a run may skip (O-221)."""


class Pipeline:
    def __init__(self, spark: SparkSession, corpus_root: str, out_dir: str, import_mode: str = "full", parity: bool = False, labeler=labels.offline_labeler, run_id: str = "run_1", partitions: int | None = None, model: str = "offline", pause: float = 2.0, buckets: int = 64, skip_limit: int | None = None):
        self.spark, self.root, self.out = spark, corpus_root, out_dir.rstrip("/")
        self.import_mode, self.parity, self.labeler, self.run_id, self.partitions = import_mode, parity, labeler, run_id, partitions
        self.model, self.pause, self.buckets, self.skip_limit = model, pause, buckets, skip_limit
        self.metrics: list[tuple] = []
        self.written: dict[str, int] = {}  # rows by table, as this pipeline wrote them

    def table(self, name: str) -> DataFrame:
        path = f"{self.out}/{name}"
        if name in BY_PROGRAM:
            return self.by_program(name).read()
        if name in MERGED:
            return self.merged(name).read()
        return self.spark.read.schema(BY_RUN[name]).parquet(path) if name in BY_RUN else corpus.read_stage(self.spark, path)

    def by_program(self, name: str) -> Buckets:
        return Buckets(self.spark, f"{self.out}/{name}", BY_PROGRAM[name], self.buckets)

    def merged(self, name: str) -> incremental.Rebuilt:
        return MERGED[name](self.spark, f"{self.out}/{name}", self.buckets)

    def _write(self, name: str, rows: DataFrame) -> int:
        """The number of rows written, observed as they pass: nothing is read for it."""
        if name in BY_PROGRAM:
            return self.by_program(name).write(rows)
        if name in MERGED:
            return self.merged(name).rebuild(rows)
        seen = Observation()
        corpus.write_stage(rows.observe(seen, F.count(F.lit(1)).alias("n")), f"{self.out}/{name}", "run_id" if name in BY_RUN else None)
        return seen.get["n"]

    def own(self, name: str) -> DataFrame:
        """The rows of this run, where runs are told apart."""
        return self.table(name).filter(F.col("run_id") == self.run_id) if name in BY_RUN else self.table(name)

    def has(self, name: str) -> bool:
        last = f"run_id={self.run_id}" if name in BY_RUN else "result/_SUCCESS" if name in MERGED else "_SUCCESS"
        return corpus.exists(self.spark, f"{self.out}/{name}/{last}")

    def run(self, steps=STEPS, resume: bool = False) -> DataFrame:
        """Run the steps in their order and return their metrics (also written as a table, each when its step ends)."""
        job, began, status = int(time.time() * 1000), datetime.now(UTC), "FAILED"
        first = len(self.metrics)
        try:
            for name in STEPS:
                if name in steps and not (resume and self.has(name)):
                    self._step(job, name, getattr(self, f"_{name}"))
            status = "COMPLETED"
        finally:
            totals = [sum(m[k] for m in self.metrics[first:]) for k in range(8, 12)]
            self._record((JOB, job, "Job", status, status, began, *self._since(began), *totals))
        return self.spark.createDataFrame(self.metrics, S.METRIC)

    @staticmethod
    def _since(began: datetime) -> tuple[datetime, int]:
        ended = datetime.now(UTC)
        return ended, int((ended - began).total_seconds() * 1000)

    def _record(self, row: tuple) -> None:
        self.spark.createDataFrame([row], S.METRIC).coalesce(1).write.mode("append").parquet(f"{self.out}/metrics")

    def _step(self, job: int, name: str, make) -> None:
        """O-222: counts and duration of a step; a failing step is recorded, then raised."""
        began, status, written, read, filtered, skipped = datetime.now(UTC), "FAILED", 0, 0, 0, 0
        try:
            written = self._write(name, make())
            self.written[name] = written
            read = written if name not in SOURCES else self.written[SOURCES[name]] if SOURCES[name] in self.written else self.table(SOURCES[name]).count()
            if name in ("candidates", "extracted"):
                filtered = self.table("parse_results").filter("status <> 'VALID'").count()
            if name == "parsed":
                skipped = self.table("parsed").filter(parse_stage.unforeseen()).count()
                if self.skip_limit is not None and skipped > self.skip_limit:
                    raise SkipLimitError(f"{skipped} files failed for no foreseen reason, {self.skip_limit} may")
            if name == "labels":
                skipped = self.own("rejected").count()
                filtered = read - written - skipped
            status = "COMPLETED"
        finally:
            self.metrics.append((JOB, job, name, status, status, began, *self._since(began), read, written, filtered, skipped))
            self._record(self.metrics[-1])

    def _programs(self) -> DataFrame:
        found = corpus.scan(self.spark, self.root)
        if self.import_mode == "full" or not self.has("programs"):
            return found
        # the table cannot be read while it is replaced: its rows go by way of a second folder
        corpus.write_stage(self.table("programs"), f"{self.out}/programs_before")
        return corpus.import_programs(self.table("programs_before"), found, self.import_mode)

    def _parsed(self) -> DataFrame:
        return parse_stage.parse(self.table("programs"), self.parity, self.partitions)

    def _parse_results(self) -> DataFrame:
        return parse_stage.results(self.table("parsed"))

    def _candidates(self) -> DataFrame:
        return parse_stage.candidates(self.table("parsed"))

    def _extracted(self) -> DataFrame:
        return parse_stage.rules(self.table("parsed"))

    def _normalized(self) -> DataFrame:
        return rules.keyed(self.table("extracted"))

    def _canonical(self) -> DataFrame:
        return self.table("normalized")

    def _abstract(self) -> DataFrame:
        return self.table("normalized")

    def refresh(self, programs: DataFrame) -> None:
        """O-17, O-18: these programs (id, path, source_type, content) parsed anew, in all tables from parsed to abstract."""

        def held(name: str, rows: DataFrame) -> DataFrame:
            corpus.write_stage(rows, f"{self.out}/refreshed/{name}")
            return corpus.read_stage(self.spark, f"{self.out}/refreshed/{name}")

        parsed = held("parsed", parse_stage.parse(programs, self.parity, self.partitions))
        keys = held("keys", programs.select(F.col("id").alias("program_id")).distinct())
        old = self.by_program("normalized").read(self.by_program("normalized").touched(keys))
        before = held("before", old.join(keys, "program_id", "left_semi"))
        after = held("after", rules.keyed(parse_stage.rules(parsed)))
        self.by_program("parsed").replace(parsed, keys.withColumnRenamed("program_id", "id"))
        for name, rows in (("parse_results", parse_stage.results(parsed)), ("candidates", parse_stage.candidates(parsed)), ("extracted", parse_stage.rules(parsed)), ("normalized", after)):
            self.by_program(name).replace(rows, keys)
        for name in MERGED:
            self.merged(name).apply(after, before)
        self.written.clear()

    def _labels(self) -> DataFrame:
        """The labels of this run: those that it has, and those of the patterns that it has none of (O-220)."""
        done = self.own("labels") if self.has("labels") else self.spark.createDataFrame([], S.LABEL)
        asked = exchange.Exchange(self.spark, f"{self.out}/answers", self.labeler, self.run_id, self.model, pause=self.pause)
        got, rejected = labels.label(self.table("abstract"), rules.examples(self.table("normalized")), done, run_id=self.run_id, model=self.model, exchange=asked.ask)
        corpus.write_stage(rejected.withColumn("run_id", F.lit(self.run_id)), f"{self.out}/rejected", "run_id")
        return done.unionByName(got)
