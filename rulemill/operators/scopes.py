"""Scopes of decisions as tables: tokens are rows, nesting is a running sum, matching is a window (O-73, O-74, O-90 to O-102).

The same result as ``structure.extract``, for sources that come as a table of cleaned texts: nothing leaves the JVM, and one plan
does all programs.

1. ``sentences``: a row for each sentence, with the line and the place in it where it begins (running sums over a program).
2. ``tokens``: rows of tokens, cut from the sentences.  A sentence's text goes along on a row of its own, number -1, so that
   nothing has to be joined back later.
3. ``by_depth``: the words that open, part or close a scope, with the scope that each belongs to.  Within a sentence the depth is the
   running sum of openings less closings; a closing, an ELSE or a WHEN belongs to the last opening of its own depth.  Where that is
   one of another kind, or has its ELSE already, something was left open on purpose (an ELSE, a WHEN or an END closes what stands
   inside): such sentences are folded word by word with a stack instead, in one expression over the sentence.
4. ``extract``: scopes with their parts as places of tokens, and texts as slices of the sentence's pieces.

Partitions of the windows are programs, sentences and depths within them; none spans programs.  All groups are parts of a program: rows
that come dealt by ``id`` are not dealt again, others once, as sentences; there is no join.  Words of verbs that can hold others take
part only in sentences that close them by END.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .structure import ACTIONS, HOLDERS, MORE_ACTIONS

PIECE = (
    r"[ \t\r]+|\*>[^\n]*|\n|\"[^\"\n]*(?:\"\"[^\"\n]*)*\"|'[^'\n]*(?:''[^'\n]*)*'|[+-]?\p{Nd}+(?:\.\p{Nd}+)?(?![A-Za-z0-9_-])"
    r"|[A-Za-z0-9]+(?:[-_]+[A-Za-z0-9]+)*|>=|<=|<>|\*\*|==|[=<>().:+*/;&-]|[^\n]"
)
LOOPS = ("UNTIL", "VARYING", "WITH", "TEST")
RULE = "parse_mode rule_type start_line end_line condition_text subject_text then_text else_text evaluate_boolean_mode when_text when_index is_when_other raw_snippet".split()
#: What a sentence's own row carries, the first of its rows.
OWN = ("text", "line", "at")
_c = F.col


#: Pieces up to a period: as one match, so a sentence is cut without a list of its pieces.
SENTENCE = rf"(?:(?!\.)(?:{PIECE}))*+\.?"


@dataclass
class Extracted:
    status: DataFrame  # id, status, line_no, char_pos, offending_token, message
    candidates: DataFrame  # id, parse_mode, kind, start_line, end_line, snippet
    rules: DataFrame  # id and RULE


def sentences(programs: DataFrame, text: str = "text") -> DataFrame:
    """id, sentence (its number), text, line and at (where it begins); each program has one at least."""
    x = programs.select("id", F.posexplode(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(SENTENCE), F.lit(0))).alias("sentence", "text"))
    before = W.partitionBy("id").orderBy("sentence").rowsBetween(W.unboundedPreceding, -1)
    size = F.length("text").cast("long")
    breaks = size - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    x = x.withColumns({"line": (1 + F.coalesce(F.sum(breaks).over(before), F.lit(0))).cast("int"), "off": F.coalesce(F.sum(size).over(before), F.lit(0))})
    start = F.coalesce(F.max(F.when(breaks > 0, _c("off") + size - F.length(F.substring_index("text", "\n", -1)))).over(before), F.lit(0))
    return x.select("id", "sentence", "text", "line", (_c("off") - start).cast("int").alias("at"))


_QUOTED = PIECE.replace("\\", "\\\\").replace("'", "\\'")
#: The pieces of a text by lines; a break of a line is a piece of the next one.  What is done for each piece is kept small.
_BY_LINE = rf"transform(split(text, '\\n'), (l, k) -> concat(IF(k = 0, array(), array('\n')), regexp_extract_all(l, '{_QUOTED}', 0)))"
_GAP = r"((t < '!' AND left(t, 1) IN (' ', '\t', '\r', '\n')) OR startswith(t, '*>'))"
_KEYS = r"""transform(words, t -> IF(left(t, 1) IN ('"', "'"), '', upper(t)))"""
_BAD = r"(length(t) = 1 AND NOT rlike(t, '[A-Za-z0-9\\p{Nd} \t\r\n=<>().:+*/;&-]'))"


def _cut(x: DataFrame) -> DataFrame:
    """The rows with ``texts`` and ``lines`` of all pieces, and ``at_piece`` (numbers of pieces), ``words`` and ``keys`` of the tokens."""
    x = x.withColumn("by_line", F.expr(_BY_LINE))
    x = x.withColumns({"texts": F.flatten("by_line"), "lines": F.expr("flatten(transform(by_line, (l, k) -> array_repeat(line + k, size(l))))")}).drop("by_line")
    x = x.withColumn("at_piece", F.expr(f"filter(transform(texts, (t, p) -> IF({_GAP}, NULL, p)), p -> p IS NOT NULL)"))
    return x.withColumn("words", F.expr("transform(at_piece, p -> texts[p])")).withColumn("keys", F.expr(_KEYS))


def tokens(programs: DataFrame, text: str = "text") -> DataFrame:
    """id, sentence, i (number of the token within its sentence), key, previous, following; at i = -1 the sentence's text, line and at."""
    x = sentences(programs, text).withColumn("words", F.expr(f"filter(regexp_extract_all(text, '{_QUOTED}', 0), t -> NOT {_GAP})"))
    x = x.select("id", "sentence", *OWN, F.expr(_KEYS).alias("keys"))
    own = "struct(-1 AS i, '' AS key, CAST(NULL AS STRING) AS previous, CAST(NULL AS STRING) AS following, text, line, at)"
    each = "struct(i, k AS key, get(keys, i - 1) AS previous, get(keys, i + 1) AS following, CAST(NULL AS STRING) AS text, CAST(NULL AS INT) AS line, CAST(NULL AS INT) AS at)"
    return x.select("id", "sentence", F.inline(F.expr(f"concat(array({own}), transform(keys, (k, i) -> {each}))")))


def _events(tok: DataFrame, parity: bool) -> DataFrame:
    """Tokens that begin an action or a scope, part one or close one, and the sentences' own rows: role, name, begins, next_begin, next_then."""
    actions = sorted(ACTIONS if parity else ACTIONS | MORE_ACTIONS)
    verb = _c("key").isin(actions) & (F.coalesce("previous", F.lit("")) != "FUNCTION")
    decision = _c("key").isin("IF", "EVALUATE")
    holder = verb & (_c("key").isin(sorted(HOLDERS)) | ((_c("key") == "PERFORM") & F.coalesce(_c("following").isin(*LOOPS), F.lit(False))))
    role = F.when(decision | holder, "OPEN").when(_c("key").isin("ELSE", "WHEN", "THEN"), _c("key")).when(_c("key").startswith("END-"), "END")
    name = F.when(_c("key").startswith("END-"), F.substring("key", 5, 100)).otherwise(_c("key"))
    x = tok.select("id", "sentence", "i", role.alias("role"), name.alias("name"), (decision | verb).alias("begins"), *OWN).filter("role IS NOT NULL OR begins OR i < 0")
    back = W.partitionBy("id", "sentence").orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, -1)
    return x.withColumns({"next_begin": F.min(F.when(_c("begins"), _c("i"))).over(back), "next_then": F.min(F.when(_c("role") == "THEN", _c("i"))).over(back)})


def _structural(events: DataFrame) -> DataFrame:
    """Of the verbs that can hold others those only that an END closes, and no END without its verb; IF, EVALUATE and SEARCH stay."""
    own = W.partitionBy("id", "sentence", "name")
    always = _c("name").isin("IF", "EVALUATE", "SEARCH")
    last_end, first_open = F.max(F.when(_c("role") == "END", _c("i"))).over(own), F.min(F.when(_c("role") == "OPEN", _c("i"))).over(own)
    x = events.filter("role IN ('OPEN', 'ELSE', 'WHEN', 'END') OR i < 0").withColumns({"last_end": last_end, "first_open": first_open})
    matched = F.when(_c("role") == "OPEN", _c("last_end") > _c("i")).when(_c("role") == "END", _c("first_open") < _c("i"))
    return x.filter((_c("i") < 0) | _c("role").isin("ELSE", "WHEN") | always | F.coalesce(matched, F.lit(False))).select("id", "sentence", "i", "role", "name", "next_begin", "next_then", *OWN)


def by_depth(words: DataFrame) -> DataFrame:
    """The words with ``owner`` (the place of the opening each belongs to) and ``regular`` (whether its whole sentence nests by depth alone)."""
    step = F.when(_c("role") == "OPEN", 1).when(_c("role") == "END", -1).otherwise(0)
    order = W.partitionBy("id", "sentence").orderBy("i")
    level = F.sum(step).over(order) + F.when(_c("role") == "END", 1).otherwise(0)
    x = words.withColumn("level", level)
    seen = W.partitionBy("id", "sentence", "level").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    opened = lambda c: F.last(F.when(_c("role") == "OPEN", _c(c)), ignorenulls=True).over(seen)
    x = x.withColumns({"owner": opened("i"), "kind": opened("name")})
    parts = F.count_if(_c("role") == "ELSE").over(W.partitionBy("id", "sentence", "owner").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    fits = F.when(_c("role") == "END", _c("kind") == _c("name")).when(_c("role") == "ELSE", (_c("kind") == "IF") & (parts == 1)).when(_c("role") == "WHEN", _c("kind").isin("EVALUATE", "SEARCH")).otherwise(True)
    return x.withColumn("fits", (_c("i") < 0) | (F.coalesce(fits, F.lit(False)) & (_c("level") > 0))).withColumn("regular", F.min("fits").over(W.partitionBy("id", "sentence")))


# One step of the fold: s is the stack (its top first), o what is known so far; {k} is the place in the stack that the word belongs to.
_CLOSE = "transform(slice(a.s, 1, k - 1), x -> struct(x.start AS owner, x.kind AS kind, 'END' AS role, w.i - 1 AS i, w.next_begin, w.next_then))"
_ROW = "array(struct({0} AS owner, {1} AS kind, '{2}' AS role, w.i AS i, w.next_begin, w.next_then))"
_STEP = f"""CASE w.role
  WHEN 'OPEN' THEN struct(concat(array(struct(w.name AS kind, w.i AS start, false AS parted)), a.s) AS s, concat(a.o, {_ROW.format('w.i', 'w.name', 'OPEN')}) AS o)
  ELSE element_at(transform(array(coalesce(array_position(transform(a.s, x -> CASE w.role WHEN 'ELSE' THEN x.kind = 'IF' AND NOT x.parted WHEN 'WHEN' THEN x.kind IN ('EVALUATE', 'SEARCH') ELSE x.kind = w.name END), true), 0)), k -> CASE
    WHEN k = 0 THEN struct(a.s AS s, IF(w.role = 'END' AND w.name NOT IN ('IF', 'EVALUATE'), a.o, concat(a.o, {_ROW.format('w.i', 'concat(w.role, w.name)', 'ERROR')})) AS o)
    WHEN w.role = 'END' THEN struct(slice(a.s, CAST(k AS INT) + 1, size(a.s)) AS s, concat(a.o, {_CLOSE}, {_ROW.format('a.s[k - 1].start', 'a.s[k - 1].kind', 'END')}) AS o)
    WHEN w.role = 'ELSE' THEN struct(concat(array(struct('IF' AS kind, a.s[k - 1].start AS start, true AS parted)), slice(a.s, CAST(k AS INT) + 1, size(a.s))) AS s, concat(a.o, {_CLOSE}, {_ROW.format('a.s[k - 1].start', "'IF'", 'ELSE')}) AS o)
    ELSE struct(slice(a.s, CAST(k AS INT), size(a.s)) AS s, concat(a.o, {_CLOSE}, {_ROW.format('a.s[k - 1].start', 'a.s[k - 1].kind', 'WHEN')}) AS o) END), 1) END"""
_EMPTY = "named_struct('s', CAST(array() AS ARRAY<STRUCT<kind: STRING, start: INT, parted: BOOLEAN>>), 'o', CAST(array() AS ARRAY<STRUCT<owner: INT, kind: STRING, role: STRING, i: INT, next_begin: INT, next_then: INT>>))"


def attached(words: DataFrame, fold_all: bool = False) -> DataFrame:
    """A row for each sentence: id, sentence, text, line, at, and ``belongs``: owner, kind, role (OPEN, ELSE, WHEN, END), i, next_begin, next_then of its words.

    Words without a scope to belong to are ERROR; sentences whose nesting needs a stack are folded.
    """
    x = words.withColumns({"owner": F.lit(None).cast("int"), "kind": F.lit(None).cast("string"), "regular": F.lit(False)}) if fold_all else by_depth(words)
    word = F.when(_c("i") >= 0, F.struct("i", "role", "name", "owner", "kind", "next_begin", "next_then"))
    x = x.groupBy("id", "sentence").agg(F.sort_array(F.collect_list(word)).alias("words"), F.min("regular").alias("regular"), *[F.max(c).alias(c) for c in OWN])
    known = "transform(words, w -> struct(w.owner AS owner, w.kind AS kind, w.role AS role, w.i AS i, w.next_begin, w.next_then))"
    return x.select("id", "sentence", *OWN, F.expr(f"IF(regular, {known}, aggregate(words, {_EMPTY}, (a, w) -> {_STEP}, a -> a.o))").alias("belongs"))


def _upto(a: str, b: str, only: str = "") -> str:
    """The sentence's tokens from number a to before number b as one text."""
    some = lambda c: f"slice({c}, {a} + 1, greatest({b} - ({a}), 0))"
    kept = f"filter(zip_with({some('words')}, {some('keys')}, (t, key) -> IF({only}, t, NULL)), t -> t IS NOT NULL)" if only else some("words")
    return f"array_join({kept}, ' ')"


def _cleaned(text: str) -> Column:
    """O-101."""
    one = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r'\bDISPLAY "EXEC[ _]BLOCK[ _]STUB"', "EXEC_BLOCK_STUB")
    return F.trim(F.substring_index(one, "*>", 1))


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def _also(text: str) -> Column:
    """O-96."""
    return F.expr(rf"filter(transform(split(coalesce({text}, ''), '(?i)\\s+ALSO\\s+'), x -> trim(x)), x -> x != '')")


_RAW = "array_join(slice(texts, {0} + 1, {1} - {0} + 1), '')"  # from one piece to another
_KEY_AT, _PIECE_AT = "get(keys, {0})", "get(at_piece, {0})"


SCOPE = ("owner", "kind", "other", "whens", "next_begin", "next_then")


def _with(have: tuple[str, ...], **more: str) -> Column:
    """The scopes of a sentence with some of their fields and further ones, expressions of a scope s."""
    fields = [f"s.{k} AS {k}" for k in have] + [f"{v} AS {k}" for k, v in more.items()]
    return F.expr(f"transform(scopes, s -> struct({', '.join(fields)}))")


def _scopes(attached: DataFrame) -> DataFrame:
    """The sentences with their pieces and tokens, their scopes with their parts as numbers of tokens, and the first ERROR as ``word``."""
    x = attached.select("*", F.expr("sort_array(filter(belongs, b -> b.role != 'ERROR'))").alias("parts"), F.expr("array_min(transform(filter(belongs, b -> b.role = 'ERROR'), b -> struct(b.i AS i, b.kind AS kind)))").alias("word"))
    # the parts of a scope stand together: cut where another owner begins
    starts = "filter(transform(parts, (b, n) -> IF(n = 0 OR b.owner != parts[n - 1].owner, n, NULL)), n -> n IS NOT NULL)"
    x = x.withColumn("starts", F.expr(starts))
    x = x.withColumn("groups", F.expr("transform(starts, (n, j) -> slice(parts, n + 1, coalesce(get(starts, j + 1), size(parts)) - n))"))
    of = lambda role: f"filter(g, b -> b.role = '{role}')"
    first = lambda role, c: f"array_{'max' if role == 'OPEN' else 'min'}(transform({of(role)}, b -> b.{c}))"
    whens = f"sort_array(transform({of('WHEN')}, b -> struct(b.i AS i, b.next_begin AS next_begin)))"
    scope = f"struct(g[0].owner AS owner, g[0].kind AS kind, {first('END', 'i')} AS closed, {first('ELSE', 'i')} AS other, {whens} AS whens, {first('OPEN', 'next_begin')} AS next_begin, {first('OPEN', 'next_then')} AS next_then)"
    x = x.select("id", "sentence", *OWN, "word", F.expr(f"transform(filter(groups, g -> g[0].kind IN ('IF', 'EVALUATE')), g -> {scope})").alias("scopes"))
    x = _cut(x).withColumn("top", F.size("words") - 1)
    # a scope that nothing closes ends before the period; the last sentence may have none
    x = x.withColumn("scopes", _with(SCOPE, end=f"greatest(s.owner, coalesce(s.closed, IF({_KEY_AT.format('top')} = '.', top - 1, top)))"))
    event = "coalesce(least(s.next_begin, s.next_then) <= coalesce(s.other - 1, s.end), false)"
    then = "coalesce(s.next_then < s.next_begin, s.next_begin IS NULL)"
    body = f"CASE WHEN s.kind != 'IF' THEN NULL WHEN {event} THEN IF({then}, s.next_then + 1, s.next_begin) ELSE s.other END"
    stop = f"IF({_KEY_AT.format('s.end')} IN ('END-IF', 'END-EVALUATE'), s.end, s.end + 1)"
    return x.withColumn("scopes", _with((*SCOPE, "end"), body=body, stop=stop, a=_PIECE_AT.format("s.owner"), z=_PIECE_AT.format("s.end")))


def extract(programs: DataFrame, mode: str = "FULL", parity: bool = False, fold_all: bool = False, hold: Callable[[str, DataFrame], DataFrame] = lambda _name, rows: rows, snippets: bool = True) -> Extracted:
    """Status, candidates (O-90) and rules (O-91 to O-100) of programs (id, text); an id is one row.

    Each result is one pass, which writes nothing but the one exchange by ``id``, and not that where programs come dealt by ``id``.
    ``snippets=False`` leaves the rules' raw_snippet null, for readers that don't take it: it is not made then.  Where several results are read, ``hold(name, rows)`` may keep the sentences with their scopes as a table and give it back.
    """
    x = _judged(_scopes(attached(_structural(_events(tokens(programs), parity)), fold_all)))
    every = hold("sentences", x)
    valid = every.filter("said IS NULL AND size(scopes) > 0")
    found = valid.select("id", F.inline(F.expr(f"transform(scopes, s -> struct(s.kind AS kind, get(lines, s.a) AS start_line, get(lines, s.z) AS end_line, {_RAW.format('s.a', 's.z')} AS snippet))")))
    return Extracted(_status(every), found.select("id", F.lit(mode).alias("parse_mode"), "kind", "start_line", "end_line", "snippet"), _rules(valid, mode, snippets))


_TYPES = {"evaluate_boolean_mode": "boolean", "is_when_other": "boolean", "when_index": "int", "start_line": "int", "end_line": "int"}


def _rules(sentences: DataFrame, mode: str, snippets: bool = True) -> DataFrame:
    """O-91 to O-93, and O-95 to O-100: a row for each IF and for each WHEN; a WHEN without an action shares the next one's (O-98)."""
    condition, then, other = _upto("s.owner + 1", "s.body", "key != 'THEN'"), _upto("s.body", "coalesce(s.other, s.stop)"), _upto("s.other + 1", "s.stop")
    raw = _RAW if snippets else "CAST(NULL AS STRING)"
    row = "struct({kind} AS kind, s.owner AS owner, {n} AS n, {subject} AS subject, get(lines, {first}) AS start_line, get(lines, {last}) AS last_line, {cond} AS cond, {action} AS action, {other} AS other, {raw} AS raw)"
    ifs = row.format(kind="'IF'", n="0", subject="CAST(NULL AS STRING)", first="s.a", last="s.z", cond=condition, action=then, other=other, raw=raw.format("s.a", "s.z"))
    subject = _upto("s.owner + 1", "get(s.whens, 0).i")
    after = "coalesce(get(s.whens, n + 1).i, s.stop)"
    whens = f"transform(s.whens, (w, n) -> struct(s.owner AS owner, n AS n, w.i AS i, {after} AS after, IF(w.next_begin < {after}, w.next_begin, NULL) AS body, subject AS subject))"
    with_subject = f"flatten(transform(filter(scopes, s -> s.kind = 'EVALUATE'), s -> flatten(transform(array({subject}), subject -> {whens}))))"
    x = sentences.withColumn("whens", F.expr(with_subject))
    first, last = _PIECE_AT.format("s.i"), _PIECE_AT.format("greatest(s.after - 1, s.i)")
    when = row.format(kind="'EVALUATE'", n="s.n", subject="s.subject", first=first, last=last, cond=_upto("s.i + 1", "coalesce(s.body, s.after)"), action=_upto("s.body", "s.after"), other="CAST(NULL AS STRING)", raw=raw.format(first, last))
    x = x.select("id", "sentence", F.inline(F.expr(f"concat(transform(filter(scopes, s -> s.kind = 'IF'), s -> {ifs}), transform(whens, s -> {when}))")))
    is_if = _c("kind") == "IF"
    x = x.withColumns({"subject": _or_null(_cleaned("subject")), "cond": _cleaned("cond"), "action": _or_null(_cleaned("action")), "other": _or_null(_cleaned("other"))})
    x = x.withColumn("cond", F.when(is_if, _c("cond")).otherwise(F.coalesce(_or_null(_c("cond")), F.lit("OTHER"))))
    x = x.withColumns({"subjects": F.when(~is_if, _also("subject")), "items": F.when(~is_if, _also("cond")), "is_other": ~is_if & (F.upper("cond") == "OTHER")})
    x = x.withColumn("boolean", F.expr("size(subjects) > 0 AND forall(subjects, x -> upper(x) = 'TRUE')"))
    paired = F.expr("array_join(IF(boolean, items, transform(slice(items, 1, size(subjects)), (w, i) -> concat(subjects[i], ' = ', w))), ' AND ')")
    x = x.withColumn("predicate", F.when(_c("is_other"), "OTHER").otherwise(F.coalesce(_or_null(paired), _c("cond"))))
    # from a scope's last WHEN to its first: those that share an action have one number, 0 behind the last action
    scope = ("id", "sentence", "owner")
    back = W.partitionBy(*scope).orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("group", F.count(F.when(_c("action").isNotNull(), 1)).over(back))
    shared = W.partitionBy(*scope, "group").orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0)
    has = _c("group") > 0
    raws = F.array_join(F.reverse(F.collect_list("raw").over(shared)), "\n")
    x = x.withColumns({"then": F.when(has, F.first("action").over(shared)), "end_line": F.when(has, F.first("last_line").over(shared)).otherwise(_c("last_line")), "branch": F.when(has, raws).otherwise(_c("raw"))})
    blank = F.trim(F.regexp_replace("branch", r"(?U)\s+", " ")) == ""
    snippet = F.when(~blank, F.when(_c("subject").isNotNull(), F.concat(F.lit("EVALUATE "), "subject", F.lit("\n    "), "branch", F.lit("\nEND-EVALUATE"))).otherwise(_c("branch")))
    of_when = lambda c: F.when(~is_if, c)
    known = {
        "parse_mode": F.lit(mode), "rule_type": _c("kind"), "start_line": _c("start_line"), "end_line": _c("end_line"), "condition_text": F.when(is_if, _c("cond")).otherwise(_c("predicate")), "subject_text": _c("subject"), "then_text": _c("then"), "else_text": _c("other"),
        "evaluate_boolean_mode": of_when(_c("boolean")), "when_text": of_when(_c("predicate")), "when_index": of_when(_c("n")), "is_when_other": of_when(_c("is_other")), "raw_snippet": F.when(is_if, _c("raw")).otherwise(snippet),
    }
    return x.select("id", *[known[c].cast(_TYPES.get(c, "string")).alias(c) for c in RULE])


def _judged(x: DataFrame) -> DataFrame:
    """The sentences with ``said``, the first failure of their program (null: valid): lexer before parser, words before the program's shape (O-70)."""
    top = "filter(scopes, s -> s.kind = 'IF')"
    fault = "CASE WHEN s.kind = 'IF' AND (s.body IS NULL OR s.body <= s.owner + 1) THEN 'IF without a condition or an action' WHEN s.kind = 'EVALUATE' AND size(s.whens) = 0 THEN 'EVALUATE without WHEN' END"
    place = lambda n: f"IF(get(at_piece, {n}) IS NULL, NULL, struct(sentence, get(at_piece, {n}) AS p, get(lines, get(at_piece, {n})) AS line, get(words, {n}) AS t))"
    x = x.withColumn("bad", F.expr(f"get(filter(transform(words, (t, n) -> IF({_BAD}, n, NULL)), n -> n IS NOT NULL), 0)"))
    x = x.withColumn("open", F.expr(f"get(filter(transform(scopes, s -> struct(s.owner AS owner, {fault} AS m)), s -> s.m IS NOT NULL), 0)"))
    of_sentence = {
        "lexer": F.expr(place("bad")),
        "first": F.expr(place("0")),
        "word": F.expr(f"IF(word IS NULL, NULL, struct({place('word.i')} AS x, word.kind AS kind))"),
        "top_scope": F.expr(place("get(scopes, 0).owner")),
        "open": F.expr(f"IF(open IS NULL, NULL, struct({place('open.owner')} AS x, open.m AS m))"),
        "named": F.array_contains("keys", "PROGRAM-ID"),
        "procedure": F.expr("array_contains(keys, 'PROCEDURE') AND exists(transform(keys, (k, n) -> k = 'PROCEDURE' AND get(keys, n + 1) <=> 'DIVISION'), y -> y)"),
        "any_if": F.expr(f"size({top}) > 0"),
    }
    names = {c: f"_{c}" for c in of_sentence}
    x = x.withColumns({names[c]: v for c, v in of_sentence.items()})
    w = W.partitionBy("id")
    least, any_ = lambda c: F.min(names[c]).over(w), lambda c: F.max(names[c]).over(w)
    x = x.withColumns({f"_all_{c}": (any_ if c in ("named", "procedure", "any_if") else least)(c) for c in names})
    g = lambda c: _c(f"_all_{c}")
    kind = g("word")["kind"]
    message = F.when(kind.startswith("ELSE"), "ELSE without IF").when(kind.startswith("WHEN"), "WHEN outside EVALUATE").otherwise(F.concat(F.lit("END-"), F.substring(kind, 4, 100), F.lit(" without "), F.substring(kind, 4, 100)))
    none = F.struct(F.lit(0).alias("sentence"), F.lit(0).alias("p"), F.lit(1).alias("line"), F.lit("").alias("t"))
    said = lambda status, where, m: F.struct(F.lit(status).alias("status"), where.alias("x"), m.alias("m"))
    what = (
        F.when(g("lexer").isNotNull(), said("LEXER_ERROR", g("lexer"), F.concat(F.lit("token recognition error at: '"), g("lexer")["t"], F.lit("'"))))
        .when(g("first").isNull(), said("PARSER_ERROR", none, F.lit("no tokens")))
        .when(g("word").isNotNull(), said("PARSER_ERROR", g("word")["x"], message))
        .when(~g("named"), said("PARSER_ERROR", g("first"), F.lit("PROGRAM-ID is missing")))
        .when(~g("procedure") & g("any_if"), said("PARSER_ERROR", g("top_scope"), F.lit("a statement outside the PROCEDURE DIVISION")))
        .when(g("open").isNotNull(), said("PARSER_ERROR", g("open")["x"], g("open")["m"]))
    )
    return x.select("id", "sentence", "line", "at", "texts", "lines", "at_piece", "words", "keys", "scopes", what.alias("said"))


def _status(sentences: DataFrame) -> DataFrame:
    """The row of each program, made from the sentence of its first failure, or from its first one."""
    x = sentences.filter(_c("sentence") == F.coalesce("said.x.sentence", F.lit(0)))
    # the place in the line: what stands before in it, and for a sentence's first line what stands before the sentence
    before = "aggregate(zip_with(slice(texts, 1, said.x.p), slice(lines, 1, said.x.p), (t, l) -> IF(l = said.x.line AND t != '\n', length(t), 0)), 0, (n, x) -> n + x)"
    at = F.expr(f"CASE WHEN said IS NULL THEN NULL WHEN said.m = 'no tokens' THEN 0 ELSE {before} + IF(said.x.line = line, at, 0) END")
    return x.select("id", F.coalesce("said.status", F.lit("VALID")).alias("status"), _c("said.x.line").alias("line_no"), at.alias("char_pos"), _c("said.x.t").alias("offending_token"), _c("said.m").alias("message"))
