"""Expressions on plain Python values, row by row: for folds that no native form expresses, and as a model in tests."""

from __future__ import annotations

import hashlib
import math
import random
import re
from datetime import date, timedelta

from relspark.lang import tree as T


def _like(s: str, pattern: str) -> bool:
    return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), s, re.S) is not None


def _md5(s: str) -> int:
    n = int.from_bytes(hashlib.md5(s.encode()).digest()[:8], "big")
    return n - (1 << 64) if n >> 63 else n


_OPS = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: int(a % b),
    "//": lambda a, b: a // b if isinstance(a, int) and isinstance(b, int) else int(a / b), "neg": lambda a: -a, "not": lambda a: not a,
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "like": _like,
}
_CALLS = {
    "abs": abs, "ceil": lambda x: float(math.ceil(x)), "floor": lambda x: float(math.floor(x)), "cos": math.cos, "sin": math.sin, "tan": math.tan, "sqrt": math.sqrt, "log": math.log, "pow": lambda a, b: float(a) ** b,
    "md5": _md5, "len": len, "concat": lambda a, b: a + b, "substr": lambda s, a, b: s[a:b], "byterange": lambda s, a, b: s[a:b], "head": lambda s, n: s[: max(n, 0)], "tail": lambda s, n: s[max(len(s) - n, 0) :],
    "year": lambda s: int(s[:4]), "month": lambda s: int(s[5:7]), "day": lambda s: int(s[8:10]), "dateadd": lambda s, n: str(date.fromisoformat(s) + timedelta(n)),
    "least": min, "greatest": max, "lesser": min, "greater": max, "safediv": lambda n, d, other=0.0: n / d if d else float(other),
    "flip": lambda p: random.random() < p, "random": random.random, "worker_id": lambda: 0, "theanswertolifetheuniverseandeverything": lambda: 42,
}


def evaluate(node, env: dict):
    """The value of an expression whose names are in ``env``; None stands for null."""
    go = lambda n: evaluate(n, env)
    if isinstance(node, T.Lit):
        return node.value
    if isinstance(node, T.Name):
        return env[node.name]
    if isinstance(node, T.Op):
        if node.op == "and":
            return go(node.args[0]) and go(node.args[1])
        if node.op == "or":
            return go(node.args[0]) or go(node.args[1])
        args = [go(a) for a in node.args]
        return None if None in args else _OPS[node.op](*args)
    if isinstance(node, T.Case):
        return next((go(v) for c, v in node.whens if go(c)), None) if any(go(c) for c, _ in node.whens) else go(node.default)
    if isinstance(node, T.Cast):
        value = go(node.arg)
        return None if value is None else {"LONG": int, "DOUBLE": float, "STRING": str, "BOOLEAN": bool, "BLOB": bytes}[node.type](value)
    name, args = node.name.lower(), [go(a) for a in node.args]
    if name in ("least", "greatest", "lesser", "greater"):
        args = [a for a in args if a is not None]
        return _CALLS[name](args) if args else None
    return None if None in args else _CALLS[name](*args)
