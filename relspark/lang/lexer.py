"""Tokens of the script language. Keywords are case-insensitive, identifiers are not; double quotes make strings too."""

from __future__ import annotations

import re
from typing import NamedTuple

from relspark.errors import ScriptSyntaxError

#: Reserved words of the language (fixed values).
KEYWORDS = frozenset(
    """and as asc alternate apply async boolean broadcast build_edb by case const convergence count countall cross csv def desc diff distinct do dump
    else emit empty end export false float from hash if int intersect join like limit load not opp or order pull_edb pull_idb round_robin samplescan scan
    schema select sink store string sync then tipsy true uda union unionall until when where while worker_id blob""".split()
)
#: Operators, longest first (fixed values).
OPERATORS = ("<-", "//", "==", "!=", "<>", "<=", ">=", "≤", "≥", "≠", "+", "-", "*", "/", "%", "=", "<", ">", "(", ")", "[", "]", "{", "}", ",", ";", ":", ".", "$")
SAME = {"=": "==", "<>": "!=", "≠": "!=", "≤": "<=", "≥": ">="}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f", "v": "\v", "a": "\a"}

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<blob>b'(?:\\x[0-9A-Fa-f]{2}|[^'\\])*')
    |(?P<float>(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
    |(?P<int>\d+)
    |(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")
    |(?P<id>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op>"""
    + "|".join(re.escape(o) for o in OPERATORS)
    + ")",
    re.X | re.S,
)


class Token(NamedTuple):
    kind: str  # int, float, string, blob, id, key, op, end
    value: object
    line: int


def unescaped(body: str) -> str:
    return re.sub(r"\\(x[0-9A-Fa-f]{2}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 3 else ESCAPES.get(m[1], m[1]), body, flags=re.S)


def tokenize(text: str) -> list[Token]:
    out, at, line = [], 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ScriptSyntaxError(f"line {line}: unexpected {text[at]!r}")
        kind, raw = m.lastgroup, m[0]
        if kind == "id":
            low = raw.lower()
            out.append(Token("key", low, line) if low in KEYWORDS else Token("id", raw, line))
        elif kind == "int":
            out.append(Token("int", int(raw), line))
        elif kind == "float":
            out.append(Token("float", float(raw), line))
        elif kind == "string":
            out.append(Token("string", unescaped(raw[1:-1]), line))
        elif kind == "blob":
            out.append(Token("blob", unescaped(raw[2:-1]).encode("latin-1"), line))
        elif kind == "op":
            out.append(Token("op", SAME.get(raw, raw), line))
        line += raw.count("\n")
        at = m.end()
    out.append(Token("end", None, line))
    return out


def keywords() -> dict[str, list[str]]:
    """The reserved words, and the names of library functions, which cannot be defined anew."""
    from relspark.functions.scalar import LIBRARY

    return {"reserved": sorted(KEYWORDS), "functions": sorted(LIBRARY)}
