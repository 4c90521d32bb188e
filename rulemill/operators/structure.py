"""Tokens, scopes and decision rules of one cleaned source text (O-73, O-74, O-90 to O-102).

An island parser: it follows the scopes of IF, EVALUATE and the statements that can hold others, and lets
everything else pass.  A sentence's period closes what is open; ELSE, WHEN and END-xxx close the scopes
inside the one that they belong to.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"(?P<gap>[ \t\r]+|\*>[^\n]*)|(?P<line>\n)|(?P<text>\"(?:[^\"\n]|\"\")*\"|'(?:[^'\n]|'')*')"
    r"|(?P<number>[+-]?\d+(?:\.\d+)?(?![A-Za-z0-9_-]))|(?P<word>[A-Za-z0-9]+(?:[-_]+[A-Za-z0-9]+)*)|(?P<sign>>=|<=|<>|\*\*|==|[=<>().:+*/;&-])|(?P<bad>.)"
)
# Verbs that begin an action.
ACTIONS = frozenset(
    "MOVE PERFORM COMPUTE CALL DISPLAY GO GOBACK STOP EXIT CONTINUE NEXT ADD SUBTRACT MULTIPLY DIVIDE READ WRITE REWRITE DELETE "
    "OPEN CLOSE START SET INITIALIZE STRING UNSTRING ACCEPT INSPECT EXEC".split()
)
#: Verbs that the older extraction did not take as the beginning of an action.
MORE_ACTIONS = frozenset("SEARCH SORT MERGE RETURN RELEASE CANCEL GENERATE TERMINATE INITIATE ALTER ENTRY UNLOCK".split())
HOLDERS = frozenset("READ WRITE REWRITE DELETE START RETURN CALL COMPUTE ADD SUBTRACT MULTIPLY DIVIDE STRING UNSTRING ACCEPT DISPLAY SEARCH".split())


@dataclass
class Tok:
    kind: str
    text: str
    line: int
    at: int

    @property
    def key(self) -> str:
        return self.text.upper() if self.kind in ("word", "sign") else self.text


@dataclass
class Scope:
    """An open or closed IF or EVALUATE: places of its parts as token numbers (None where it has none)."""

    kind: str
    start: int
    body: int | None = None
    other: int | None = None
    end: int = -1
    whens: list[list[int | None]] = field(default_factory=list)


class SourceError(Exception):
    def __init__(self, status: str, line: int, pos: int, token: str, message: str):
        super().__init__(message)
        self.status, self.line, self.pos, self.token, self.message = status, line, pos, token, message


def tokenize(text: str) -> list[Tok]:
    """O-73."""
    out, line, start = [], 1, 0
    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "line":
            line, start = line + 1, m.end()
        elif kind == "bad":
            raise SourceError("LEXER_ERROR", line, m.start() - start, m[0], f"token recognition error at: '{m[0]}'")
        elif kind != "gap":
            out.append(Tok(kind, m[0], line, m.start() - start))
    return out


def scopes(tokens: list[Tok], parity: bool = False) -> list[Scope]:
    """All IF and EVALUATE nodes in the order in which they begin."""
    actions = ACTIONS if parity else ACTIONS | MORE_ACTIONS
    found: list[Scope] = []
    stack: list[Scope] = []

    def close(to: int, last: int) -> None:
        while len(stack) > to:
            stack.pop().end = last

    def nearest(kind: str, ok=lambda s: True) -> int | None:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i].kind == kind and ok(stack[i])), None)

    def begins(i: int) -> None:
        """Token i begins an action: so do the branches that wait for one."""
        if stack and stack[-1].kind == "IF" and stack[-1].body is None:
            stack[-1].body = i
        if stack and stack[-1].kind == "EVALUATE" and stack[-1].whens and stack[-1].whens[-1][1] is None:
            stack[-1].whens[-1][1] = i

    for i, t in enumerate(tokens):
        k = t.key if t.kind in ("word", "sign") else ""
        if k == ".":
            close(0, i - 1)
        elif k == "IF" or k == "EVALUATE":
            begins(i)
            s = Scope(k, i)
            stack.append(s)
            found.append(s)
        elif k == "THEN":
            if stack and stack[-1].kind == "IF" and stack[-1].body is None:
                stack[-1].body = i + 1
        elif k == "ELSE":
            at = nearest("IF", lambda s: s.other is None)
            if at is None:
                raise SourceError("PARSER_ERROR", t.line, t.at, t.text, "ELSE without IF")
            close(at + 1, i - 1)
            stack[at].other = i
            stack[at].body = stack[at].body if stack[at].body is not None else i
        elif k == "WHEN":
            at = max((x for x in (nearest("EVALUATE"), nearest("SEARCH")) if x is not None), default=None)
            if at is None:
                raise SourceError("PARSER_ERROR", t.line, t.at, t.text, "WHEN outside EVALUATE")
            close(at + 1, i - 1)
            if stack[at].kind == "EVALUATE":
                stack[at].whens.append([i, None])
        elif k.startswith("END-"):
            kind = k[4:]
            at = nearest(kind)
            if at is not None:
                close(at + 1, i - 1)
                close(at, i)
            elif kind in ("IF", "EVALUATE"):
                raise SourceError("PARSER_ERROR", t.line, t.at, t.text, f"{k} without {kind}")
        elif k in actions and not (i and tokens[i - 1].key == "FUNCTION"):
            begins(i)
            following = tokens[i + 1].key if i + 1 < len(tokens) else ""
            if k in HOLDERS or (k == "PERFORM" and following in ("UNTIL", "VARYING", "WITH", "TEST")):
                stack.append(Scope(k, i))
    close(0, len(tokens) - 1)
    return found


def check_program(tokens: list[Tok], found: list[Scope]) -> None:
    """O-74, as far as an island parser can tell: a program id, a procedure division, complete decisions."""
    words = [t.key for t in tokens]
    if "PROGRAM-ID" not in words:
        t = tokens[0]
        raise SourceError("PARSER_ERROR", t.line, t.at, t.text, "PROGRAM-ID is missing")
    for a, b in zip(words, words[1:], strict=False):
        if (a, b) == ("PROCEDURE", "DIVISION"):
            break
    else:
        if any(s.kind == "IF" for s in found):
            t = tokens[found[0].start]
            raise SourceError("PARSER_ERROR", t.line, t.at, t.text, "a statement outside the PROCEDURE DIVISION")
    for s in found:
        t = tokens[s.start]
        if s.kind == "IF" and (s.body is None or s.body <= s.start + 1):
            raise SourceError("PARSER_ERROR", t.line, t.at, t.text, "IF without a condition or an action")
        if s.kind == "EVALUATE" and not s.whens:
            raise SourceError("PARSER_ERROR", t.line, t.at, t.text, "EVALUATE without WHEN")


def join(tokens: list[Tok]) -> str:
    return " ".join(t.text for t in tokens)


def split_also(text: str | None) -> list[str]:
    """O-96."""
    return [x.strip() for x in re.split(r"\s+ALSO\s+", text.strip(), flags=re.I) if x.strip()] if text and text.strip() else []


def build_predicate(subjects: list[str], items: list[str], boolean: bool) -> str | None:
    """O-97: items of a WHEN with their subjects; for EVALUATE TRUE the items alone."""
    if boolean:
        return " AND ".join(items) or None
    pairs = [f"{s} = {w}" for s, w in zip(subjects, items, strict=False)]
    return " AND ".join(pairs) or None


def strip_comment(text: str | None) -> str | None:
    """O-101."""
    if text is None:
        return None
    t = re.sub(r"\s+", " ", text)
    t = re.sub(r'\bDISPLAY "EXEC[ _]BLOCK[ _]STUB"', "EXEC_BLOCK_STUB", t)
    return t.split("*>", 1)[0].strip()


def context_snippet(subject: str | None, branch: str | None) -> str | None:
    """O-100."""
    if not branch or not branch.strip():
        return None
    return f"EVALUATE {subject}\n    {branch}\nEND-EVALUATE" if subject and subject.strip() else branch


def source_between(lines: list[str], first: Tok, last: Tok) -> str:
    """The text of the source between two tokens, both included, with its own white space."""
    if first.line == last.line:
        return lines[first.line - 1][first.at : last.at + len(last.text)]
    middle = lines[first.line : last.line - 1]
    return "\n".join([lines[first.line - 1][first.at :], *middle, lines[last.line - 1][: last.at + len(last.text)]])


def extract(text: str, mode: str, parity: bool = False) -> tuple[list[dict], list[dict]]:
    """Candidates (O-90) and rules (O-91 to O-100) of a program; SourceError where it does not parse."""
    tokens = tokenize(text)
    if not tokens:
        raise SourceError("PARSER_ERROR", 1, 0, "", "no tokens")
    found, lines = scopes(tokens, parity), text.split("\n")
    check_program(tokens, found)
    candidates, rules = [], []
    for s in found:
        last = tokens[max(s.end, s.start)]
        raw = source_between(lines, tokens[s.start], last)
        candidates.append({"kind": s.kind, "start_line": tokens[s.start].line, "end_line": last.line, "snippet": raw})
        stop = s.end if last.key in ("END-IF", "END-EVALUATE") else s.end + 1
        if s.kind == "IF":
            rules.append(_if_rule(s, tokens, stop, raw, last.line, mode))
        else:
            rules += _when_rules(s, tokens, stop, lines, mode)
    return candidates, rules


def _rule(mode: str, kind: str, start: int, end: int, **parts) -> dict:
    base = dict.fromkeys(("condition_text", "subject_text", "then_text", "else_text", "evaluate_boolean_mode", "when_text", "when_index", "is_when_other", "raw_snippet"))
    return {"parse_mode": mode, "rule_type": kind, "start_line": start, "end_line": end, **base, **parts}


def _if_rule(s: Scope, tokens: list[Tok], stop: int, raw: str, end_line: int, mode: str) -> dict:
    cond = [t for t in tokens[s.start + 1 : s.body] if t.key != "THEN"]
    then = tokens[s.body : s.other if s.other is not None else stop]
    other = tokens[s.other + 1 : stop] if s.other is not None else []
    return _rule(mode, "IF", tokens[s.start].line, end_line, condition_text=strip_comment(join(cond)), then_text=strip_comment(join(then)) or None, else_text=strip_comment(join(other)) or None, raw_snippet=raw)


def _when_rules(s: Scope, tokens: list[Tok], stop: int, lines: list[str], mode: str) -> list[dict]:
    subject = strip_comment(join(tokens[s.start + 1 : s.whens[0][0]])) or None
    subjects = split_also(subject)
    boolean = bool(subjects) and all(x.upper() == "TRUE" for x in subjects)
    out: list[dict] = []
    for n, (at, body) in enumerate(s.whens):
        after = s.whens[n + 1][0] if n + 1 < len(s.whens) else stop
        cond = strip_comment(join(tokens[at + 1 : body if body is not None else after])) or "OTHER"
        action = strip_comment(join(tokens[body:after])) if body is not None else None
        other = cond.upper() == "OTHER"
        predicate = "OTHER" if other else build_predicate(subjects, split_also(cond), boolean) or cond
        first, last = tokens[at], tokens[max(after - 1, at)]
        out.append(_rule(mode, "EVALUATE", first.line, last.line, condition_text=predicate, subject_text=subject, then_text=action or None, evaluate_boolean_mode=boolean, when_text=predicate, when_index=n, is_when_other=other, raw_snippet=source_between(lines, first, last)))
    for k in range(len(out) - 2, -1, -1):  # O-98: a WHEN without an action shares the next one's
        if out[k]["then_text"] is None and out[k + 1]["then_text"] is not None:
            out[k]["then_text"] = out[k + 1]["then_text"]
            out[k]["end_line"] = out[k + 1]["end_line"]
            out[k]["raw_snippet"] += "\n" + out[k + 1]["raw_snippet"]
    for r in out:
        r["raw_snippet"] = context_snippet(subject, r["raw_snippet"])
    return out
