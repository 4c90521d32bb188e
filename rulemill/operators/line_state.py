"""Lines with a state as tables: latches and open blocks are last values, continuations are segments (O-35 to O-45, O-51, O-57, O-58).

The same result as the steps over lists of lines in ``cleaning``, for texts that come as a table: lines are rows, and nothing leaves the JVM.

* Whether a block is open before a line is the last of what earlier lines say about it: a line opens it, closes it, or says nothing.
* A latch is the same with lines that only set it.
* A continuation line belongs to the line it continues: lines that begin one are numbered by a running count, and each number is folded.

``scan`` takes these values in two steps: within stretches of ``stretch`` lines, then from stretch to stretch, so that a very long text is
as many tasks as it has stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cleaning import STORAGE, STUB, VENDORS

STRETCH = 4096
# White space as Python's strip() has it.
WHITE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
CONTINUE = "           CONTINUE."
_c = F.col


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{WHITE}+$", "")


def lines(texts: DataFrame, stretch: int = STRETCH, text: str = "text") -> DataFrame:
    """id, n, stretch, line of every line."""
    x = texts.select("id", F.posexplode(F.split(F.coalesce(_c(text), F.lit("")), "\n")).alias("n", "line"))
    return x.withColumn("stretch", F.expr(f"n DIV {stretch}"))


def joined(rows: DataFrame, texts: DataFrame, line: str = "line") -> DataFrame:
    """id, text: the lines of each text end to end, in order; a text without lines is empty."""
    got = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", _c(line).alias("line")))).alias("x"))
    return texts.select("id").join(got.select("id", F.array_join(F.expr("transform(x, y -> y.line)"), "\n").alias("text")), "id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def scan(rows: DataFrame, lasts: dict[str, Column] | None = None, counts: dict[str, Column] | None = None) -> DataFrame:
    """For each name the last value that is not null, or the sum, of what the text's earlier lines say; null or 0 at first."""
    lasts, counts = lasts or {}, counts or {}
    x = rows.withColumns({f"_{k}": c for k, c in (lasts | counts).items()})
    before = W.partitionBy("id", "stretch").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    over = W.partitionBy("id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    last, total = (lambda c, w: F.last(c, ignorenulls=True).over(w)), (lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)))
    ends = [F.max_by(f"_{k}", F.when(_c(f"_{k}").isNotNull(), _c("n"))).alias(f"_{k}") for k in lasts] + [F.sum(f"_{k}").alias(f"_{k}") for k in counts]
    ends = x.groupBy("id", "stretch").agg(*ends)
    carried = ends.select("id", "stretch", *[last(f"_{k}", over).alias(f"carried_{k}") for k in lasts], *[total(f"_{k}", over).alias(f"carried_{k}") for k in counts])
    x = x.withColumns({f"own_{k}": last(f"_{k}", before) for k in lasts} | {f"own_{k}": total(f"_{k}", before) for k in counts}).join(carried, ["id", "stretch"])
    out = {k: F.coalesce(f"own_{k}", f"carried_{k}") for k in lasts} | {k: _c(f"own_{k}") + _c(f"carried_{k}") for k in counts}
    return x.select(*rows.columns, *[c.alias(k) for k, c in out.items()])


def is_directive(up: Column, parity: bool = False) -> Column:
    """O-36, of a stripped line in upper case."""
    word = r"^(PROCESS|CBL)" if parity else r"^(PROCESS|CBL)(?![A-Z0-9-])"
    vendor = rf"(?U)^([0-9A-Z]{{1,6}}{WHITE}+)?({'|'.join(sorted(VENDORS))})(?!\w)"
    return up.startswith(">>") | up.rlike(r"^REPLACE(?![A-Z0-9-])") | up.rlike(word) | up.rlike(vendor)


def is_copy(up: Column) -> Column:
    return up.rlike(r"^COPY([ .]|\z)")


def _joined_continuations(parts: str) -> Column:
    """O-43: the parts of a line one after the other: in an open literal without a gap and without the repeated quote."""
    mark = "regexp_extract(regexp_replace(a, '\"[^\"]*\"|\\'[^\\']*\\'', ''), '[\"\\']', 0)"
    rest = f"regexp_replace(x, r'^{WHITE}+', '')"
    step = f"IF(a IS NULL, x, element_at(transform(array(struct({mark} AS m, {rest} AS r)), y -> CASE WHEN y.m = '' THEN concat(a, ' ', y.r) WHEN startswith(y.r, y.m) THEN concat(a, substring(y.r, 2)) ELSE concat(a, y.r) END), 1))"
    return F.expr(f"aggregate({parts}, CAST(NULL AS STRING), (a, x) -> {step})")


def folded_lines(texts: DataFrame, parity: bool = False, stretch: int = STRETCH, text: str = "text") -> DataFrame:
    """O-35 to O-45: id, n, line of the lines that stay; ``joined`` makes texts of them."""
    x = lines(texts, stretch, text).withColumn("line", rstrip(_c("line"))).withColumn("bare", strip(_c("line"))).filter("bare != ''")
    x = x.withColumns({"up": F.upper("bare"), "fixed": _c("line").rlike("^[ 0-9A-Za-z]{6}[ */-]")})
    mark = F.substring("line", 7, 1)
    comment = _c("bare").startswith("*") | (_c("fixed") & mark.isin("*", "/"))
    starts = F.concat("up", F.lit(" ")).contains("EXEC ") & ~_c("bare").startswith("*>") & (F.lit(parity) | ~_c("comment"))
    x = x.withColumn("comment", comment).withColumns({"directive": is_directive(_c("up"), parity), "starts": starts, "ends": _c("up").contains("END-EXEC"), "area": rstrip(F.substring("line", 8, 65))})
    # O-38: a line closes the block, opens it, or leaves it
    x = scan(x, {"open": F.when(_c("ends"), 0).when(~_c("directive") & _c("starts"), 1)})
    inside = F.coalesce(_c("open") == 1, F.lit(False))
    x = x.withColumn("what", F.when(~inside & _c("directive"), "drop").when(inside | _c("starts"), F.when(_c("ends"), "stub").otherwise("exec")).when(is_copy(_c("up")), "copy").when(_c("comment"), "drop").when(~_c("fixed"), "line").when(mark == "-", "more").otherwise("area"))
    # what is left of a line in fixed columns is judged once more
    own = F.upper(strip(_c("area")))
    x = x.withColumn("own", own)
    x = x.withColumn("what", F.when(_c("what") != "area", _c("what")).when((_c("own") == "") | is_directive(_c("own"), parity), "drop").otherwise(F.when(is_copy(_c("own")), "copy2").otherwise("area")))
    # O-37: a PROCEDURE DIVISION has begun, with this line at the latest
    begun = _c("up").startswith("PROCEDURE DIVISION") | (_c("what").isin("area", "copy2") & _c("own").startswith("PROCEDURE DIVISION"))
    x = scan(x.withColumn("begun", begun), {"before": F.when(_c("begun"), 1)})
    procedure = _c("begun") | _c("before").isNotNull()
    dot = F.substring(_c("up"), F.locate("END-EXEC", _c("up")) + 8, F.length("up")).rlike(rf"^{WHITE}*\.")
    stub = F.concat(F.lit(f"           {STUB}"), F.when(dot, ".").otherwise(""))
    kept = F.when(_c("what") == "stub", F.when(procedure, stub)).when(_c("what").isin("copy", "copy2"), F.when(procedure, CONTINUE)).when(_c("what") == "line", _c("line")).when(_c("what").isin("area", "more"), _c("area"))
    x = x.select("id", "stretch", "n", (_c("what") == "more").alias("more"), kept.alias("part")).filter("part IS NOT NULL")
    # O-43: numbers of the lines that begin one; a continuation before any line begins one itself
    x = scan(x, counts={"begun": (~_c("more")).cast("long")})
    x = x.withColumn("number", _c("begun") + (~_c("more")).cast("long"))
    whole = x.groupBy("id", "number").agg(F.min("n").alias("n"), F.sort_array(F.collect_list(F.struct("n", "part"))).alias("parts"))
    return whole.select("id", "n", _joined_continuations("transform(parts, p -> p.part)").alias("line"))


def stubbed_strings(rows: DataFrame) -> DataFrame:
    """O-51: a STRING or UNSTRING statement, up to the line that ends with a period, becomes CONTINUE; rows (id, n, stretch, line)."""
    starts = F.upper(F.regexp_replace("line", f"^{WHITE}+", "")).rlike("^(STRING|UNSTRING) ")
    x = scan(rows.withColumn("starts", starts), {"open": F.when(rstrip(_c("line")).endswith("."), 0).when(_c("starts"), 1)})
    x = x.filter(F.coalesce(_c("open") == 0, F.lit(True)))
    return x.withColumn("line", F.when(_c("starts"), CONTINUE).otherwise(_c("line"))).drop("starts", "open")


def without_configuration_functions(rows: DataFrame) -> DataFrame:
    """O-57: FUNCTION lines of the CONFIGURATION SECTION go; rows (id, n, stretch, line)."""
    up = F.upper(strip(_c("line")))
    says = F.when(up.startswith("CONFIGURATION SECTION"), 1).when(up.rlike(r"(?U)^\S+ (SECTION|DIVISION)\b"), 0)
    x = scan(rows.withColumn("says", says), {"open": _c("says")})
    return x.filter(~((F.coalesce("says", "open", F.lit(0)) == 1) & up.startswith("FUNCTION "))).drop("says", "open")


def without_screen_section(rows: DataFrame) -> DataFrame:
    """O-58: a SCREEN SECTION up to the next section of data or the PROCEDURE DIVISION goes; without one it stays."""
    up, gap = F.upper(_c("line")), f"{WHITE}+"
    heads = "|".join(["PROCEDURE" + gap + "DIVISION", *(s + gap + "SECTION" for s in STORAGE)])
    head = lambda h: up.rlike(rf"(?U)^{WHITE}*({h})(?!\w)")
    says = F.when(head(heads), 0).when(head("SCREEN" + gap + "SECTION"), 1)
    last = rows.withColumn("says", says).filter("says = 0").groupBy("id").agg(F.max("n").alias("last"))
    x = scan(rows.withColumn("says", says), {"open": _c("says")}).join(last, "id", "left")
    return x.filter(~((F.coalesce("says", "open", F.lit(0)) == 1) & (_c("n") < F.coalesce("last", F.lit(-1))))).drop("says", "open", "last")


def folded(texts: DataFrame, parity: bool = False, stretch: int = STRETCH, text: str = "text") -> DataFrame:
    """id, text: the texts after O-35 to O-45."""
    return joined(folded_lines(texts, parity, stretch, text), texts)
