"""Tokens of Oracle-style SQL and their normal rendering."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:[^']|'')*'?)|(?P<quoted>"[^"]*"?)
    |(?P<bind>:\w+|&&?\w+\.?)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<word>[^\W\d][\w$#]*)
    |(?P<op>\(\+\)|<>|!=|\^=|<=|>=|\|\||:=|=>|\*\*|\.\.|.)""",
    re.X | re.S,
)

# Words of the language, which are never columns.
KEYWORDS = frozenset("""ALL AND ANY AS ASC BETWEEN BY CASE CONNECT CROSS CURRENT DESC DISTINCT ELSE END ESCAPE EXCEPT EXISTS FETCH FIRST FOLLOWING FOR FROM FULL
    GROUP HAVING IN INNER INTERSECT INTERVAL INTO IS JOIN LAST LEFT LIKE MINUS NATURAL NOT NULL NULLS OF ON OR ORDER OUTER OVER PARTITION PRECEDING PRIOR RANGE RIGHT
    ROW ROWS SELECT SET SOME START THEN UNBOUNDED UNION UNIQUE USING VALUES WHEN WHERE WITH WITHIN""".split())  # fmt: skip
#: Values written without parentheses.
PSEUDO = frozenset("SYSDATE SYSTIMESTAMP ROWNUM LEVEL USER CURRENT_DATE CURRENT_TIMESTAMP TRUE FALSE DUAL".split())


@dataclass(frozen=True)
class Token:
    kind: str  # word, quoted, string, number, bind, op
    text: str

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""

    @property
    def name(self) -> str:
        return self.text.strip('"') if self.kind == "quoted" else self.text


def tokenize(sql: str) -> list[Token]:
    """The tokens, without white space and comments."""
    return [Token(m.lastgroup, m.group()) for m in _TOKEN.finditer(sql) if m.lastgroup not in ("space", "comment")]


def close_of(tokens: list[Token], at: int) -> int:
    """Place of the parenthesis that closes the one at `at`; the end if it is never closed."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += (tokens[i].text == "(") - (tokens[i].text == ")")
        if depth == 0:
            return i
    return len(tokens)


def split_at(tokens: list[Token], stops) -> list[list[Token]]:
    """Cut at the tokens outside parentheses and CASE for which stops(token) holds."""
    out, depth, cases = [[]], 0, 0
    for t in tokens:
        depth += (t.text == "(") - (t.text == ")")
        cases += (t.upper == "CASE") - (t.upper == "END" and cases > 0)
        if depth == 0 and cases == 0 and stops(t):
            out.append([])
        else:
            out[-1].append(t)
    return out


def commas(tokens: list[Token]) -> list[list[Token]]:
    return [x for x in split_at(tokens, lambda t: t.text == ",") if x]


def render(tokens: list[Token]) -> str:
    """One line: words of the language in capitals, one space between tokens, none inside calls and dotted names."""
    out: list[str] = []
    for i, t in enumerate(tokens):
        before = tokens[i - 1] if i else None
        text = t.upper if t.upper in KEYWORDS or t.upper in PSEUDO else "<>" if t.text in ("!=", "^=") else t.text
        if t.kind == "word" and i + 1 < len(tokens) and tokens[i + 1].text == "(":
            text = t.upper
        glued = (
            before is None or t.text in (")", ",", ".", ";", "(+)") or before.text in ("(", ".")
            or (t.text == "(" and before.kind in ("word", "quoted") and before.upper not in KEYWORDS)
            or (before.text in ("-", "+") and t.kind == "number" and (i < 2 or tokens[i - 2].text in ("(", ",", "=", "<", ">", "<=", ">=", "<>") or tokens[i - 2].upper in KEYWORDS))
        )
        out.append(text if glued else f" {text}")
    return "".join(out)


def columns(tokens: list[Token]) -> list[tuple[str | None, str]]:
    """(qualifier, column) of each column in the expression, in order; nested queries are left out."""
    out, i = [], 0
    while i < len(tokens):
        t = tokens[i]
        if t.text == "(" and i + 1 < len(tokens) and tokens[i + 1].upper in ("SELECT", "WITH"):
            i = close_of(tokens, i) + 1
            continue
        if t.kind in ("word", "quoted") and t.upper not in KEYWORDS and t.upper not in PSEUDO:
            parts = [t]
            while i + 2 < len(tokens) and tokens[i + 1].text == "." and (tokens[i + 2].kind in ("word", "quoted") or tokens[i + 2].text == "*"):
                parts.append(tokens[i + 2])
                i += 2
            after = tokens[i + 1] if i + 1 < len(tokens) else None
            date_word = t.upper in ("DATE", "TIMESTAMP") and after is not None and after.kind == "string"
            if not (after is not None and after.text == "(") and not date_word:
                out.append((parts[-2].name if len(parts) > 1 else None, parts[-1].name))
        i += 1
    return out
