"""Labels of abstract patterns: evidence, prompt, a pluggable labeler, guardrails, retries (O-210 to O-221).

The labeler is any function of a prompt row; the default is a deterministic one that needs no network.  Every
labeler's output goes through the same checks; what fails is asked for once more with the reason, then rejected.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import strip_controls
from .relational import missing

# Tokens that must not reach a title or a summary.
INTERNAL = r"(?i)(?<![A-Z0-9_-])VAR\d+(?![A-Z0-9_-])|<(?:N|S|SPACE|ZERO)>|(?<![A-Z0-9_-])(?:EXEC_BLOCK_STUB|COPY_STUB)(?![A-Z0-9_-])"
LABEL_JSON = "title string, rule_summary string, pattern string, confidence double"
INSTRUCTIONS = (
    "Annotate one decision pattern found in COBOL programs. Use only what the source excerpts show. "
    f"Answer as JSON with title (at most 8 words), rule_summary, pattern (one of {', '.join(S.PATTERNS)}) and confidence (0 to 1). "
    "Never use VAR1, VAR2 ..., <N>, <S>, <SPACE>, <ZERO>, EXEC_BLOCK_STUB or COPY_STUB in title or rule_summary. "
    "Choose in this order: a check of an input before its use is DATA_VALIDATION; a decision or computation of the trade is "
    "BUSINESS_RULE_CANDIDATE; steering of handlers or routines is CONTROL_FLOW_TEMPLATE; a local technical step is IDIOM_PATTERN; else OTHER."
)


def evidence(c: Column) -> Column:
    """O-211: an excerpt without stub comments; blank is null."""
    t = strip_controls(F.regexp_replace(c, r"(?m)^\s*\*>\s*(EXEC BLOCK STUB|COPY STUB)\.?\s*$\n?", ""))
    return F.when(t != "", t)


def prompts(patterns: DataFrame, examples: DataFrame) -> DataFrame:
    """O-210, O-220: one prompt a pattern, with its numbered excerpts; patterns without any have none."""
    shown = examples.withColumn("excerpt", evidence(F.col("raw_snippet"))).filter("excerpt IS NOT NULL")
    listed = shown.groupBy("abstract_canonical_key").agg(F.sort_array(F.collect_list(F.struct("rank", "excerpt"))).alias("x"))  # at most k a key
    numbered = F.array_join(F.transform("x", lambda e, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), e["excerpt"])), "\n\n")
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("<EMPTY>")))
    head = F.concat_ws("\n", F.lit(INSTRUCTIONS), part("kind", "kind"), part("has_else", "has_else"), part("predicate", "abstract_predicate"), part("then", "abstract_then"), part("else", "abstract_else"))
    return patterns.join(listed, "abstract_canonical_key").withColumn("prompt", F.concat_ws("\n\n", head, numbered)).drop("x")


def incomplete(patterns: DataFrame) -> DataFrame:
    """O-212: patterns that must not be labelled, with the reason."""
    blank = lambda c: F.col(c).isNull() | (strip_controls(F.col(c)) == "")
    reason = F.when(blank("abstract_predicate"), "missing predicate").when(blank("abstract_then"), "missing then").when(F.col("has_else") & blank("abstract_else"), "missing else").when(~F.coalesce("has_else", F.lit(False)) & ~blank("abstract_else"), "unexpected else")
    return patterns.withColumn("reason", reason).filter("reason IS NOT NULL")


def response_text(c: Column) -> Column:
    """O-214: the output text of a response, or else the first text of all contents of all outputs; only strings that are not blank count."""
    shape = lambda v: F.schema_of_variant(v) == "STRING"
    said = lambda v, path: F.try_variant_get(v, path, "variant")
    root = F.try_parse_json(c)
    lists = F.transform(F.try_variant_get(root, "$.output", "array<variant>"), lambda o: F.coalesce(F.try_variant_get(o, "$.content", "array<variant>"), F.array().cast("array<variant>")))
    texts = F.transform(F.flatten(lists), lambda x: said(x, "$.text"))
    every = F.concat(F.array(said(root, "$.output_text")), F.coalesce(texts, F.array().cast("array<variant>")))
    strings = F.transform(every, lambda v: F.when(shape(v), F.try_variant_get(v, "$", "string")))
    return F.get(F.filter(strings, lambda t: strip_controls(t) != ""), F.lit(0))


def parse_response(c: Column) -> Column:
    """O-214, O-215: the label in a response."""
    return F.from_json(response_text(c), LABEL_JSON)


def has_internal_tokens(title: Column, summary: Column) -> Column:
    """O-217."""
    return F.concat_ws(" ", title, summary).rlike(INTERNAL)


def fault(title: Column, summary: Column, pattern: Column, confidence: Column) -> Column:
    """O-216, O-217: what is wrong with a label, null if nothing."""
    blank = lambda c: c.isNull() | (strip_controls(c) == "")
    return (
        F.when(blank(title), "blank title")
        .when(F.size(F.split(strip_controls(title), r"\s+")) > 8, "long title")
        .when(blank(summary), "blank summary")
        .when(pattern.isNull() | ~pattern.isin(*S.PATTERNS), "unknown pattern")
        .when(confidence.isNull() | F.isnan(confidence) | ~confidence.between(0, 1), "confidence out of range")
        .when(has_internal_tokens(title, summary), "internal tokens")
    )


def offline_labeler(row: dict) -> str:
    """A label by plain rules, in the order of the instructions."""
    then, pred = row["abstract_then"] or "", row["abstract_predicate"] or ""
    words = set(then.replace(".", " ").split())
    if any(x in pred for x in ("NUMERIC", "<SPACE>", "ALPHABETIC")):
        kind, what = "DATA_VALIDATION", "Checks an input before its use"
    elif words & {"COMPUTE", "MULTIPLY", "DIVIDE", "ADD", "SUBTRACT"}:
        kind, what = "BUSINESS_RULE_CANDIDATE", "Computes a value under a condition"
    elif words & {"PERFORM", "GO", "CALL", "EXEC_BLOCK_STUB", "GOBACK", "STOP"}:
        kind, what = "CONTROL_FLOW_TEMPLATE", "Selects a routine by a condition"
    elif words & {"MOVE", "SET", "DISPLAY", "INITIALIZE", "CONTINUE"}:
        kind, what = "IDIOM_PATTERN", "Sets a value under a condition"
    else:
        kind, what = "OTHER", "Decides by a condition"
    summary = f"{what}{', with an alternative branch' if row['has_else'] else ''}."
    return json.dumps({"output_text": json.dumps({"title": what, "rule_summary": summary, "pattern": kind, "confidence": 0.5})})


class TransientError(Exception):
    """A labeler's failure that is worth another attempt (rate limits, time-outs, server errors)."""


def call(labeler: Callable[[dict], str], row: dict, attempts: int = 3, pause: float = 2.0) -> str | None:
    """O-219, O-221: the response, after waiting longer at each attempt; null when none came.

    Any other failure of the labeler is not tried again; the pattern gets no response, and so is rejected, and the stage goes on.
    """
    for k in range(1, attempts + 1):
        try:
            return labeler(row)
        except TransientError:
            if k < attempts:
                time.sleep(pause * k)
        except Exception:  # noqa: BLE001 - one pattern's failure must stay its own
            return None
    return None


def ask(rows: DataFrame, labeler: Callable[[dict], str], pause: float = 2.0) -> DataFrame:
    """O-213: rows with a column response; the labeler runs in Arrow batches on the executors."""

    def run(batches):
        for b in batches:
            got = [call(labeler, r, pause=pause) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, "response"])

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("response", StringType())]))


def _checked(rows: DataFrame) -> DataFrame:
    x = rows.withColumn("label", parse_response(F.col("response")))
    silent = F.when(F.col("response").isNull(), "no response")
    return x.withColumn("fault", F.coalesce(silent, fault(F.col("label.title"), F.col("label.rule_summary"), F.col("label.pattern"), F.col("label.confidence"))))


def label(patterns: DataFrame, examples: DataFrame, done: DataFrame | None = None, labeler: Callable[[dict], str] = offline_labeler, run_id: str = "run_1", model: str = "offline", prompt_version: str = "v1", pause: float = 2.0, store: Callable[[str, DataFrame], DataFrame] | None = None, exchange: Callable[[DataFrame, int], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """O-210 to O-221: (labels, rejected patterns with their reasons) of the patterns that have no label in this run yet.

    ``store(name, rows)`` keeps the responses of an attempt and gives them back, so that both results read the same
    answers and none is asked for twice.  Without it they are persisted.  ``exchange(rows, attempt)`` asks in place of both (see
    exchange.py): it keeps the answers itself.
    """
    store = store or (lambda _name, rows: rows.persist())
    exchange = exchange or (lambda rows, attempt: store(("responses", "corrections")[attempt - 1], ask(rows, labeler, pause)))
    todo = missing(patterns, done.filter(F.col("run_id") == run_id), ["abstract_canonical_key"]) if done is not None else patterns
    bad = incomplete(todo).select("abstract_canonical_key", "reason")
    ready = prompts(missing(todo, bad, ["abstract_canonical_key"]), examples)
    first = _checked(exchange(ready, 1))
    again = first.filter("fault IS NOT NULL").withColumn("prompt", F.concat_ws("\n\n", "prompt", F.concat(F.lit("Correct this and answer again: "), "fault"))).drop("response", "label", "fault")
    second = _checked(exchange(again, 2))  # O-218: one corrective attempt
    every = first.filter("fault IS NULL").unionByName(second)
    out = every.filter("fault IS NULL").select(F.lit(run_id).alias("run_id"), "abstract_canonical_key", "kind", "label.title", "label.rule_summary", "label.pattern", "label.confidence", F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"))
    return out, bad.unionByName(every.filter("fault IS NOT NULL").select("abstract_canonical_key", F.col("fault").alias("reason")))


def unlabelled(patterns: DataFrame, labels: DataFrame) -> DataFrame:
    """O-12, O-152: patterns without a label, the most frequent first."""
    return missing(patterns, labels, ["abstract_canonical_key"]).orderBy(F.desc("occurrences"), "abstract_canonical_key")
