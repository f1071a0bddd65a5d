"""Scalar operators and the function library: name -> (arities, builder of a typed column). All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from relspark.errors import TypeSafetyError
from relspark.types import SPARK, Typed, literal, need, numeric

L, D, B, S = "LONG", "DOUBLE", "BOOLEAN", "STRING"


def operate(op: str, args: list[Typed]) -> Typed:
    a, *rest = args
    b = rest[0] if rest else None
    if op in ("and", "or"):
        need(op, a, B)
        need(op, b, B)
        return Typed(a.col & b.col if op == "and" else a.col | b.col, B)
    if op == "not":
        need(op, a, B)
        return Typed(~a.col, B)
    if op == "neg":
        return Typed(-a.col, numeric(op, a))
    if op in ("+", "-", "*"):
        kind = numeric(op, a, b)
        col = a.col + b.col if op == "+" else a.col - b.col if op == "-" else a.col * b.col
        return Typed(col, kind)
    if op == "/":
        numeric(op, a, b)
        return Typed(a.col.cast("double") / b.col.cast("double"), D)
    if op == "//":
        if numeric(op, a, b) == D:
            return Typed((a.col / b.col).cast("long"), L)
        return Typed(whole_div(a.col, b.col), L)
    if op == "%":
        numeric(op, a, b)
        return Typed(modulo(a.col, b.col).cast("long"), L)
    if op == "like":
        need(op, a, S)
        need(op, b, S)
        return Typed(F.like(a.col, b.col), B)
    if a.type != b.type and not {a.type, b.type} <= {L, D}:
        raise TypeSafetyError(f"{op}: {a.type} and {b.type}")
    col = {"==": a.col == b.col, "!=": a.col != b.col, "<": a.col < b.col, ">": a.col > b.col, "<=": a.col <= b.col, ">=": a.col >= b.col}[op]
    return Typed(col, B)


def modulo(a: Column, b: Column) -> Column:
    """With the divisor's sign."""
    r = a % b
    return F.when(_apart(r, b), r + b).otherwise(r)


def _apart(r: Column, b: Column) -> Column:
    """Whether the rest of a truncating division has another sign than the divisor."""
    return (r != 0) & ((r < 0) != (b < 0))


def whole_div(a: Column, b: Column) -> Column:
    """Rounded down: one less than the truncated quotient where rest and divisor differ in sign."""
    return F.call_function("div", a, b) - F.when(_apart(a % b, b), 1).otherwise(0)


def cast(kind: str, a: Typed) -> Typed:
    if kind == B and a.type == S:
        return Typed(a.col != "", B)
    if kind == B and a.type in (L, D):
        return Typed(a.col != 0, B)
    if kind == S and a.type == B:
        return Typed(F.when(a.col, "True").otherwise("False"), S)
    return Typed(a.col.cast(SPARK[kind]), kind)


def case(whens: list[tuple[Typed, Typed]], default: Typed) -> Typed:
    kinds = {v.type for _, v in whens} | {default.type}
    if len(kinds) > 1:
        raise TypeSafetyError(f"case: branches of types {sorted(kinds)}")
    col = None
    for c, v in whens:
        need("when", c, B)
        col = F.when(c.col, v.col) if col is None else col.when(c.col, v.col)
    return Typed(col.otherwise(default.col), default.type)


def _double(name: str, f):
    def build(a: Typed) -> Typed:
        numeric(name, a)
        return Typed(f(a.col.cast("double")).cast("double"), D)

    return build


def _abs(a: Typed) -> Typed:
    return Typed(F.abs(a.col), numeric("abs", a))


def _pow(a: Typed, b: Typed) -> Typed:
    numeric("pow", a, b)
    return Typed(F.pow(a.col.cast("double"), b.col.cast("double")), D)


def _same(name: str, f):
    def build(*args: Typed) -> Typed:
        if len({a.type for a in args}) > 1:
            raise TypeSafetyError(f"{name}: {[a.type for a in args]}")
        return Typed(f(*[a.col for a in args]), args[0].type)

    return build


def _concat(a: Typed, b: Typed) -> Typed:
    need("concat", a, S)
    need("concat", b, S)
    return Typed(F.concat(a.col, b.col), S)


def _slice(kind: str, name: str):
    def build(s: Typed, begin: Typed, end: Typed) -> Typed:
        """From begin (counted from 0) up to end; negative bounds count from the end, bounds outside are moved to it."""
        need(name, s, kind)
        need(name, begin, L)
        need(name, end, L)
        size = F.length(s.col).cast("long")
        inside = lambda c: F.least(F.greatest(F.when(c < 0, size + c).otherwise(c), F.lit(0)), size)
        first = inside(begin.col)
        return Typed(F.substring(s.col, (first + 1).cast("int"), F.greatest(inside(end.col) - first, F.lit(0)).cast("int")), kind)

    return build


def _head(s: Typed, n: Typed) -> Typed:
    need("head", s, S)
    need("head", n, L)
    return Typed(F.substring(s.col, F.lit(1), F.greatest(n.col, F.lit(0)).cast("int")), S)


def _tail(s: Typed, n: Typed) -> Typed:
    need("tail", s, S)
    need("tail", n, L)
    keep = F.least(F.greatest(n.col, F.lit(0)).cast("int"), F.length(s.col))
    return Typed(F.substring(s.col, F.length(s.col) - keep + 1, keep), S)


def _len(s: Typed) -> Typed:
    need("len", s, S)
    return Typed(F.length(s.col).cast("long"), L)


def _part(name: str, f):
    def build(s: Typed) -> Typed:
        need(name, s, S, "DATETIME")
        return Typed(f(s.col.cast("date")).cast("long"), L)

    return build


def _dateadd(s: Typed, days: Typed) -> Typed:
    need("dateadd", s, S)
    need("dateadd", days, L)
    return Typed(F.date_format(F.date_add(s.col.cast("date"), days.col.cast("int")), "yyyy-MM-dd"), S)


def _md5(s: Typed) -> Typed:
    """The first 64 bits of the md5, as the signed LONG with the same bits."""
    need("md5", s, S)
    half = lambda at: F.conv(F.substring(F.md5(s.col), at, 8), 16, 10).cast("long")
    return Typed(F.shiftleft(half(1), 32).bitwiseOR(half(9)), L)


def _safe_div(n: Typed, d: Typed, default: Typed | None = None) -> Typed:
    numeric("safediv", n, d)
    other = default.col.cast("double") if default else F.lit(0.0)
    return Typed(F.coalesce(F.try_divide(n.col.cast("double"), d.col.cast("double")), F.when(d.col == 0, other)), D)


def _flip(p: Typed) -> Typed:
    numeric("flip", p)
    return Typed(F.rand() < p.col, B)


def _split(s: Typed, by: Typed) -> Typed:
    need("split", s, S)
    need("split", by, S)
    return Typed(F.explode(F.split(s.col, by.col)), S)


def _sequence(n: Typed) -> Typed:
    """0 up to n - 1; no rows if n < 1."""
    need("sequence", n, L)
    return Typed(F.explode(F.when(n.col > 0, F.sequence(F.lit(0).cast("long"), n.col - 1))), L)


def _ngram(s: Typed, n: Typed) -> Typed:
    """Runs of n characters; none if the string is shorter."""
    need("ngram", s, S)
    need("ngram", n, L)
    places = F.when((F.length(s.col) >= n.col) & (n.col > 0), F.sequence(F.lit(1), F.length(s.col) - n.col.cast("int") + 1))
    return Typed(F.explode(F.transform(places, lambda i: F.substring(s.col, i, n.col.cast("int")))), S)


def _bitset(b: Typed) -> Typed:
    """Each bit, the lowest of each byte first."""
    need("bitset", b, "BLOB")
    bits = lambda i: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.shiftright(F.ascii(F.decode(F.substring(b.col, i, 1), "ISO-8859-1")), 0).bitwiseAND(F.call_function("shiftleft", F.lit(1), j)) != 0)
    return Typed(F.explode(F.flatten(F.transform(F.when(F.length(b.col) > 0, F.sequence(F.lit(1), F.length(b.col))), bits))), B)


_least, _greatest = _same("least", F.least), _same("greatest", F.greatest)
#: name -> {arity: builder}; arity None: two or more.
SCALARS: dict[str, dict] = {
    "abs": {1: _abs},
    "ceil": {1: _double("ceil", F.ceil)},
    "floor": {1: _double("floor", F.floor)},
    "cos": {1: _double("cos", F.cos)},
    "sin": {1: _double("sin", F.sin)},
    "tan": {1: _double("tan", F.tan)},
    "sqrt": {1: _double("sqrt", F.sqrt)},
    "log": {1: _double("log", F.ln)},
    "pow": {2: _pow},
    "md5": {1: _md5},
    "len": {1: _len},
    "concat": {2: _concat},
    "substr": {3: _slice(S, "substr")},
    "byterange": {3: _slice("BLOB", "byterange")},
    "head": {2: _head},
    "tail": {2: _tail},
    "year": {1: _part("year", F.year)},
    "month": {1: _part("month", F.month)},
    "day": {1: _part("day", F.dayofmonth)},
    "dateadd": {2: _dateadd},
    "least": {None: _least},
    "greatest": {None: _greatest},
    "lesser": {2: _least},
    "greater": {2: _greatest},
    "safediv": {2: _safe_div, 3: _safe_div},
    "flip": {1: _flip},
    "random": {0: lambda: Typed(F.rand(), D)},
    "worker_id": {0: lambda: Typed(F.spark_partition_id().cast("long"), L)},
    "theanswertolifetheuniverseandeverything": {0: lambda: literal(42, L)},
    "split": {2: _split},
    "sequence": {1: _sequence},
    "ngram": {2: _ngram},
    "bitset": {1: _bitset},
}
FLATMAPS = frozenset(("split", "sequence", "ngram", "bitset"))
AGGREGATES = frozenset(("count", "countall", "sum", "min", "max", "avg", "stdev", "lexmin"))
LIBRARY = frozenset(SCALARS) | AGGREGATES


def builder(name: str, arity: int):
    found = SCALARS.get(name.lower())
    return found and (found.get(arity) or (found.get(None) if arity >= 2 else None))


def fold_and(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
