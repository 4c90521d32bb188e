"""Schemas and closed domains of the stages' tables."""

from __future__ import annotations

# Closed domains.
PARSE_STATUS = ("VALID", "IO_ERROR", "LEXER_ERROR", "PARSER_ERROR", "EMPTY_AFTER_CLEAN", "SKIPPED_COPYBOOK", "SKIPPED_FUNCTION_UNIT")
PARSE_MODE = ("FULL", "PROCEDURE_ONLY")
RULE_KIND = ("IF", "EVALUATE")
PATTERNS = ("IDIOM_PATTERN", "CONTROL_FLOW_TEMPLATE", "BUSINESS_RULE_CANDIDATE", "DATA_VALIDATION", "OTHER")
SOURCE_TYPES = {"x-cobol": "XCOBOL", "genapp": "GENAPP"}
EVALUATORS = ("E1", "E2", "E3", "E4", "E5")

PROGRAMS = "id long, system_name string, path string, source_type string, content binary"
PARSE_RESULT = "status string, parse_mode string, snippet string, message string, line_no int, char_pos int, offending_token string, if_count int, evaluate_count int"
CANDIDATE = "kind string, start_line int, end_line int, snippet string"
RULE = (
    "parse_mode string, rule_type string, start_line int, end_line int, condition_text string, subject_text string, then_text string, else_text string, "
    "evaluate_boolean_mode boolean, when_text string, when_index int, is_when_other boolean, raw_snippet string"
)
LABEL = "run_id string, abstract_canonical_key string, kind string, title string, rule_summary string, pattern string, confidence double, model string, prompt_version string"
METRIC = (
    "job_name string, job_execution_id long, step_name string, batch_status string, exit_code string, start_time timestamp, end_time timestamp, duration_ms long, "
    "read_count long, write_count long, filter_count long, process_skip_count long"
)
RATING_RAW = "sample_no string, evaluator string, erfahrung string, f1 string, f2 string, f3 string, f4 string, mittelwert string, kommentar string"
