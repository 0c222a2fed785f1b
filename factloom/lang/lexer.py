"""Java tokens. Comments and white space are skipped; nothing raises on broken input."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

STRING, CHAR, NAME, NUMBER, OPERATOR = "string", "char", "name", "number", "operator"

_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"
    r'|(?P<block>"""[ \t\f]*\n.*?(?:"""|\Z))'
    r'|(?P<string>"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z))'
    r"|(?P<char>'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z))"
    r"|(?P<name>[^\W\d][\w$]*|\$[\w$]*)"
    r"|(?P<number>\d[\w.]*)"
    r"|(?P<operator>->|::|\.\.\.|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|.)",
    re.DOTALL,
)
# Escapes of the Java language.
_ESCAPES = {"n": "\n", "t": "\t", "b": "\b", "r": "\r", "f": "\f", "s": " ", "0": "\0"}
_ESCAPE = re.compile(r"\\(u+([0-9a-fA-F]{4})|.)", re.DOTALL)
#: An access call right before a token, within so many characters.
IDIOM_REACH = 24
_IDIOM = re.compile(r"(?:getValue|setValue|\.get|\.set)\s*\(\s*(?:[A-Za-z_]\w*\.)*$")


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    at: int
    line: int
    col: int


def unescape(body: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[2], 16)) if m[2] else _ESCAPES.get(m[1], m[1]), body)


def tokens(source: str) -> list[Token]:
    """Tokens with 1-based lines and columns; string texts are unescaped."""
    breaks = [m.start() for m in re.finditer("\n", source)]
    out = []
    for m in _TOKEN.finditer(source):
        kind = m.lastgroup
        if kind == "skip":
            continue
        text = m[0]
        if kind == "block":
            kind, text = STRING, unescape(text[3:].removesuffix('"""').lstrip(" \t\f").removeprefix("\n"))
        elif kind == "string":
            text = unescape(text[1:-1] if len(text) > 1 and text.endswith('"') else text[1:])
        line = bisect_right(breaks, m.start() - 1)
        start = breaks[line - 1] + 1 if line else 0
        out.append(Token(kind, text, m.start(), line + 1, m.start() - start + 1))
    return out


def blanked(source: str) -> str:
    """The source with comments, strings and characters as blanks; same length and lines."""

    def blank(m: re.Match) -> str:
        noise = m.lastgroup in ("skip", "block", "string", "char")
        return re.sub(r"[^\n]", " ", m[0]) if noise else m[0]

    return _TOKEN.sub(blank, source)


def coarse_tokens(source: str) -> list[tuple[str, str, int, bool]]:
    """(kind, text, line, idiom) of strings and names: ``idiom`` if an access call opens
    right before the token."""
    found = []
    for t in tokens(source):
        if t.kind in (STRING, NAME):
            before = source[max(0, t.at - IDIOM_REACH) : t.at]
            found.append((t.kind, t.text, t.line, bool(_IDIOM.search(before))))
    return found
