"""Text-cleaning and text-inspection functions, Column to Column.

"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level numbers that begin data entries, program headers, signal words, file extensions.
LEVELS = "01|02|03|04|05|10|15|20|49|66|77|88"
PROGRAM_HEADERS = ("IDENTIFICATION DIVISION", "ID DIVISION", "PROGRAM-ID", "PROCEDURE DIVISION")
SIGNAL_WORDS = ("IDENTIFICATION", "PROGRAM-ID", "PROCEDURE DIVISION", "DATA DIVISION", "WORKING-STORAGE", "ENVIRONMENT DIVISION")
# Fixed values, as classes of characters that say the same in every engine: what ends a line, white space, and what is no part of a word.
LINE_END = r"\r\n|[\n-\r\x85\u2028\u2029]"
WHITE = r"[\t-\r\x1C-\x20\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000]"
WORD_END = r"([^0-9A-Z_a-z]|$)"
LEVEL_LINE = rf"^([0-9A-Z]{{1,6}}[\t-\r ]+)?({LEVELS}){WORD_END}"
FUNCTION_UNIT = rf"(^|[^0-9A-Z_a-z])FUNCTION(-|[\t-\r ]+)ID{WORD_END}"
EXTENSIONS = "cbl|cob|cobol"


def let(c: Column, f) -> Column:
    """f of a column that is computed once, however often f uses it (nested conditions would copy it into each branch)."""
    return F.element_at(F.transform(F.array(c), f), 1)


def strip_controls(c: Column) -> Column:
    """Everything up to U+0020 off both ends (wider than SQL's trim, which takes blanks only)."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def blank_to_null(c: Column) -> Column:
    return F.when(strip_controls(c) != "", c)


def is_blank(c: Column) -> Column:
    """SQL blankness: null, empty or blanks."""
    return c.isNull() | (F.btrim(c) == "")


def guard_blank(c: Column) -> Column:
    """O-30: struct<content, reason> with the reason 'raw blank' for null or blank text."""
    blank = c.isNull() | (strip_controls(c) == "")
    return F.struct(F.when(blank, "").otherwise(c).alias("content"), F.when(blank, "raw blank").alias("reason"))


def normalize_eol_tabs(c: Column) -> Column:
    """O-31: any line end to LF, a tab to four blanks."""
    return F.replace(F.regexp_replace(c, r"\r\n?", "\n"), F.lit("\t"), F.lit("    "))


def normalize_characters(c: Column) -> Column:
    """O-32: typographic quotes to plain ones, characters no lexer takes to blanks, underscores to hyphens."""
    return F.translate(c, "“”„‘’{}@?\\#﻿_", "\"\"\"''       -")


def sniff_html(c: Column) -> Column:
    """O-33: whether the text looks like a web page."""
    low = F.lower(c)
    return low.contains("<html") | low.contains("<script") | low.contains("</div>")


def blank_controls(c: Column) -> Column:
    """O-34: control characters other than LF to blanks."""
    return F.regexp_replace(c, r"[\x00-\x09\x0B-\x1F\x7F]", " ")


def lines(c: Column) -> Column:
    """O-35: the lines without trailing blanks, empty ones dropped."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")


def comma_to_blank(c: Column) -> Column:
    """O-50."""
    return F.replace(c, F.lit(","), F.lit(" "))


def lexer_characters(c: Column) -> Column:
    """O-56: backtick to quote; square brackets and exclamation marks to blanks."""
    return F.translate(c, "`[]!", "'   ")


def drop_metadata_lines(c: Column) -> Column:
    """O-47: blank out lines of documentation paragraphs and vendor banners."""
    words = r"AUTHOR|INSTALLATION|REMARKS|SECURITY|DATE-WRITTEN|DATE-COMPILED"
    return F.regexp_replace(F.regexp_replace(c, r"(?im)^.*\b(COMPUWARE|ANNA)\b.*$", ""), rf"(?im)^\s*({words})\.?\s+.*$", "")


def collapse_dots(c: Column) -> Column:
    """O-52: runs of dots to one; a lone slash on a line goes."""
    return F.regexp_replace(F.regexp_replace(c, r"\.{2,}", "."), r"(?m)^\s*/\s*$", "")


def drop_reference_modification(c: Column) -> Column:
    """O-53: NAME(from:length) to NAME."""
    return F.regexp_replace(c, r"(?i)\b([A-Z0-9-]+)\s*\([^()\n]*:[^()\n]*\)", "$1")


def drop_subscripts(c: Column, parity: bool = False) -> Column:
    """O-54: NAME(i) to NAME.  Reserved words keep their parenthesis, unless parity with the older behaviour is asked for."""
    keep = "" if parity else r"(?!(?:IF|AND|OR|NOT|WHEN|UNTIL|EVALUATE|THAN|TO|EQUAL|IS|BY|COMPUTE)(?![A-Z0-9-]))"
    return F.regexp_replace(c, rf"(?i)(?<![A-Z0-9-]){keep}([A-Z0-9-]+)\s*\([^():\n]*\)", "$1")


def assign_dynamic(c: Column) -> Column:
    """O-55: ASSIGN TO DYNAMIC x to ASSIGN TO x."""
    return F.regexp_replace(c, r"(?i)\bASSIGN\s+TO\s+DYNAMIC\s+([A-Z0-9-]+)\b", "ASSIGN TO $1")


def final_period(c: Column) -> Column:
    """O-61: no trailing blanks, at most one empty line in a row, a period at the end."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when((t == "") | t.endswith("."), t).otherwise(F.concat(t, F.lit(".")))


def weak_signal(c: Column, words: tuple[str, ...] = SIGNAL_WORDS) -> Column:
    """O-62: whether no signal word, or not more than ten letters, speak for a program."""
    up = F.upper(c)
    word = F.lit(False)
    for w in words:
        word = word | up.contains(w)
    return ~(word & (F.regexp_count(c, F.lit(r"\p{L}")) > 10))


def strip_white(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def is_copybook(c: Column, headers: tuple[str, ...] = PROGRAM_HEADERS, first: int = 8) -> Column:
    """O-71: no program header, and one of the first eight meaningful lines begins with a level number."""
    up = F.upper(c)
    header = F.lit(False)
    for h in headers:
        header = header | up.contains(h)
    meaningful = F.filter(F.transform(F.split(up, LINE_END), strip_white), lambda x: (x != "") & ~x.startswith("*"))
    return ~header & F.exists(F.slice(meaningful, 1, first), lambda x: x.rlike(LEVEL_LINE))


def is_function_unit(c: Column) -> Column:
    """O-72."""
    return F.upper(c).rlike(FUNCTION_UNIT)


def rule_signals(c: Column) -> Column:
    """O-77: how often ' IF ' and 'EVALUATE ' occur in the upper-cased text, not overlapping."""
    up = F.upper(c)
    n_if, n_eval = F.regexp_count(up, F.lit(" IF ")), F.regexp_count(up, F.lit("EVALUATE "))
    return F.struct((n_if > 0).alias("has_if"), (n_eval > 0).alias("has_evaluate"), n_if.cast("int").alias("if_count"), n_eval.cast("int").alias("evaluate_count"))


def ellipsis(c: Column, longest: int) -> Column:
    """O-78: a text beyond the bound is cut, with three dots as its end."""
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest - 3), F.lit("..."))).otherwise(c)


def error_snippet(c: Column, line: Column, radius: int = 2) -> Column:
    """O-76: the lines around a line (from 1), each with its number."""
    numbered = F.transform(F.split(c, "\n"), lambda x, i: F.format_string("%5d | %s", i + 1, x))
    first = F.greatest(line - radius, F.lit(1))
    last = F.least(line + radius, F.size(numbered))
    return F.concat_ws("\n", F.slice(numbered, first, F.greatest(last - first + 1, F.lit(0))))


def preview(c: Column, longest: int = 200) -> Column:
    """O-104: the beginning of a text on one line."""
    return F.translate(F.substring(c, 1, longest), "\n", "⏎")


def has_source_extension(path: Column) -> Column:
    """O-02."""
    return F.lower(path).rlike(rf"\.({EXTENSIONS})$")


def system_name(path: Column) -> Column:
    """O-03: the name of the folder a path lies in, else 'unknown'."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.coalesce(F.nullif(F.try_element_at(parts, F.lit(-2)), F.lit("")), F.lit("unknown"))).otherwise(F.lit("unknown"))


def normalize_path(path: Column) -> Column:
    """O-04: without the scheme, and with single slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"^file:", ""), r"/+", "/")
