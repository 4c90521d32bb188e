"""The parse stage: source files to parse results, candidates and rules, in one pass over each file (O-70 to O-104).

A file is read, cleaned and parsed once, in an Arrow batch function, and its result is a row with nested
lists; candidates and rules are exploded from it.  Files are independent, so the stage is a map.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from . import cleaning, structure

PARSED = f"id long, path string, source_type string, {S.PARSE_RESULT}, candidates array<struct<{S.CANDIDATE.replace(' ', ':').replace(',:', ', ')}>>, rules array<struct<{S.RULE.replace(' ', ':').replace(',:', ', ')}>>"
_MAX = {"message": 2000, "offending_token": 500, "snippet": 8000}


def cut(text: str | None, longest: int) -> str | None:
    return text if text is None or len(text) <= longest else text[: longest - 3] + "..."


def around(text: str, line: int, radius: int = 2) -> str:
    rows = text.split("\n")
    return "\n".join(f"{i + 1:5d} | {rows[i]}" for i in range(max(0, line - 1 - radius), min(len(rows), line + radius)))


def parse_source(content: bytes | None, parity: bool = False) -> dict:
    """O-70: one file's status, with its candidates and rules where it is valid."""
    out = {"status": "VALID", "parse_mode": "FULL", "snippet": None, "message": None, "line_no": None, "char_pos": None, "offending_token": None, "if_count": 0, "evaluate_count": 0, "candidates": [], "rules": []}
    try:
        source = (content or b"").decode("utf-8")
    except UnicodeDecodeError as e:
        return out | {"status": "IO_ERROR", "message": cut(f"Input is not valid UTF-8: {e.reason} at byte {e.start}", _MAX["message"])}
    got = cleaning.clean(source, parity)
    if not got.content:
        return out | {"status": "EMPTY_AFTER_CLEAN", "message": f"Empty after preprocessing ({got.reason or 'no code left'})"}
    if cleaning.is_copybook(got.content):
        return out | {"status": "SKIPPED_COPYBOOK", "message": "Looks like a copybook or data fragment"}
    if cleaning.is_function_unit(got.content):
        return out | {"status": "SKIPPED_FUNCTION_UNIT", "message": "Looks like a function unit"}
    failure, text = None, got.content
    for mode in S.PARSE_MODE:
        text = got.content if mode == "FULL" else cleaning.procedure_only(got.content)
        if text is None:
            break
        try:
            candidates, rules = structure.extract(text, mode, parity)
        except structure.SourceError as e:
            failure = failure or (e, text)
            continue
        up = text.upper()
        return out | {"parse_mode": mode, "if_count": up.count(" IF "), "evaluate_count": up.count("EVALUATE "), "candidates": candidates, "rules": rules}
    e, text = failure
    return out | {"status": e.status, "message": cut(e.message, _MAX["message"]), "line_no": e.line, "char_pos": e.pos, "offending_token": cut(e.token, _MAX["offending_token"]), "snippet": cut(around(text, e.line), _MAX["snippet"])}


def cleaned(programs: DataFrame, parity: bool = False) -> DataFrame:
    """O-30 to O-62 alone: (id, content, reason) of each program whose bytes are UTF-8."""

    def run(batches):
        for b in batches:
            rows = []
            for i, content in zip(b["id"].to_pylist(), b["content"].to_pylist(), strict=True):
                try:
                    got = cleaning.clean((content or b"").decode("utf-8"), parity)
                except UnicodeDecodeError:
                    continue
                rows.append({"id": i, "content": got.content, "reason": got.reason})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.int64()), ("content", pa.string()), ("reason", pa.string())]))

    return programs.select("id", "content").mapInArrow(run, "id long, content string, reason string")


#: How the message of a failure begins that no status foresees; its class follows.
UNFORESEEN = "Unforeseen "


def unforeseen():
    """Whether a parse result stands for such a failure."""
    return (F.col("status") == "PARSER_ERROR") & F.col("message").startswith(UNFORESEEN)


def parse_safely(content: bytes | None, parity: bool = False) -> dict:
    """O-221: parse_source, but what no status foresees becomes a row with PARSER_ERROR instead of the end of the stage."""
    try:
        return parse_source(content, parity)
    except Exception as e:  # noqa: BLE001 - any failure of one file must stay that file's
        return parse_source(None) | {"status": "PARSER_ERROR", "message": cut(f"{UNFORESEEN}{type(e).__name__}: {e}", _MAX["message"])}


def parse(programs: DataFrame, parity: bool = False, partitions: int | None = None) -> DataFrame:
    """A row for each program with its parse result and nested candidates and rules."""
    rows = programs.select("id", "path", "source_type", "content")
    if partitions:
        rows = rows.repartition(partitions, "path")  # many small files: spread them before the work

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([r | parse_safely(r.pop("content"), parity) for r in b.to_pylist()], schema=schema)

    schema = pa.schema([("id", pa.int64()), ("path", pa.string()), ("source_type", pa.string()), *_fields(S.PARSE_RESULT), ("candidates", pa.list_(pa.struct(_fields(S.CANDIDATE)))), ("rules", pa.list_(pa.struct(_fields(S.RULE))))])
    return rows.mapInArrow(run, PARSED)


def _fields(ddl: str) -> list[tuple[str, pa.DataType]]:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    return [(n, types[t]) for n, t in re.findall(r"(\w+) (\w+)", ddl)]


def results(parsed: DataFrame) -> DataFrame:
    """D2: one row a program."""
    return parsed.select(F.col("id").alias("program_id"), *[n for n, _ in _fields(S.PARSE_RESULT)])


def candidates(parsed: DataFrame) -> DataFrame:
    """D3: a row for each IF or EVALUATE of a valid program."""
    return parsed.filter("status = 'VALID'").select(F.col("id").alias("program_id"), "parse_mode", F.explode("candidates").alias("x")).select("program_id", "parse_mode", "x.*")


def rules(parsed: DataFrame) -> DataFrame:
    """D4: a row for each IF and each WHEN of a valid program."""
    return parsed.filter("status = 'VALID'").select(F.col("id").alias("program_id"), F.explode("rules").alias("x")).select("program_id", "x.*")


def statistics(parsed: DataFrame) -> DataFrame:
    """O-79: files, decisions, files with decisions and averages a file, by status."""
    mean = lambda c: F.round(F.avg(c).cast("decimal(18,6)"), 2).cast("double")
    return parsed.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("if_count").alias("ifs"), F.sum("evaluate_count").alias("evaluates"), F.count_if(F.col("if_count") > 0).alias("files_with_if"), F.count_if(F.col("evaluate_count") > 0).alias("files_with_evaluate"), mean("if_count").alias("ifs_per_file"), mean("evaluate_count").alias("evaluates_per_file"))
