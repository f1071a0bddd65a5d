"""Scalar expressions: inlining of functions, resolution of columns, typed columns."""

from __future__ import annotations

from collections.abc import Callable

from relspark import errors as E
from relspark.functions.scalar import AGGREGATES, FLATMAPS, SCALARS, builder, case, cast, operate
from relspark.lang import tree as T
from relspark.sources.catalog import Relation, unique
from relspark.types import Typed, literal


class Scope:
    """The columns of a FROM list, in order: by salted name, by place, and by alias."""

    def __init__(self, rels: dict[str, Relation], cols: list[Typed]):
        self.rels, self.cols = rels, cols
        self.names = unique([n for r in rels.values() for n in r.names])
        self.offset, at = {}, 0
        for alias, r in rels.items():
            self.offset[alias] = at
            at += len(r.names)

    def position(self, node) -> int:
        if isinstance(node, T.Name):
            if node.name not in self.names:
                raise E.UndefinedVariable(node.name)
            return self.names.index(node.name)
        if isinstance(node, T.Pos):
            if node.index >= len(self.cols):
                raise E.ColumnIndexOutOfBounds(f"${node.index}")
            return node.index
        alias, field = (node.alias, node.field) if isinstance(node, T.Dot) else (node.relation, node.field or 0)
        if alias not in self.rels:
            raise E.NoSuchRelation(alias)
        names = self.rels[alias].names
        if isinstance(field, int):
            if field >= len(names):
                raise E.ColumnIndexOutOfBounds(f"{alias}.${field}")
            return self.offset[alias] + field
        if field not in names:
            raise E.UndefinedVariable(f"{alias}.{field}")
        return self.offset[alias] + names.index(field)

    def __call__(self, node) -> Typed:
        return self.cols[self.position(node)]

    def source_name(self, node) -> str | None:
        """The name that a plain column reference has in its own relation."""
        if isinstance(node, T.Name):
            return node.name
        if isinstance(node, T.Dot) and isinstance(node.field, str):
            return node.field
        if isinstance(node, (T.Pos, T.Dot)):
            at = self.position(node)
            return [n for r in self.rels.values() for n in r.names][at]
        return None


def inline(node, functions: dict, python: dict | None = None):
    """The expression with calls of defined functions replaced by their bodies. Calls of tuple-valued ones give a tuple."""
    go = lambda n: inline(n, functions, python)
    if isinstance(node, T.Name) and isinstance(functions.get(node.name), T.Function) and not functions[node.name].args:
        return go(T.Call(node.name, ()))
    if not isinstance(node, T.Call):
        return T.rebuild(node, go)
    args = tuple(go(a) for a in node.args)
    f = functions.get(node.name)
    if f is not None:
        if len(args) != len(f.args):
            raise E.WrongArguments(f"{node.name} takes {len(f.args)} arguments")
        if isinstance(f, T.Stateful):
            folds = tuple(T.Fold(f, args, i) for i in range(len(f.outputs)))
            return folds if len(folds) > 1 else folds[0]
        bound = dict(zip(f.args, args, strict=True))
        bodies = tuple(substitute(go_body(b, functions, python, f.args), bound) for b in f.bodies)
        return bodies if len(bodies) > 1 else bodies[0]
    low = node.name.lower()
    if python and node.name in python:
        return T.Call(node.name, args)
    if low in AGGREGATES:
        if low != "lexmin" and len(args) != (0 if low == "countall" else 1):
            raise E.WrongArguments(node.name)
        return T.Call(low, args)
    if low in SCALARS:
        if not builder(low, len(args)):
            raise E.WrongArguments(f"{node.name} with {len(args)} arguments")
        return T.Call(low, args)
    raise E.NoSuchFunction(node.name)


def go_body(body, functions: dict, python, params: tuple):
    """A function's body, inlined; its parameters hide constants of the same name."""
    return inline(body, {k: v for k, v in functions.items() if k not in params}, python)


def substitute(node, bound: dict):
    if isinstance(node, T.Name):
        return bound.get(node.name, node)
    return T.rebuild(node, lambda n: substitute(n, bound))


def is_aggregate(node) -> bool:
    return isinstance(node, T.Call) and node.name in AGGREGATES or isinstance(node, T.Fold) and node.func.aggregate


def has_aggregate(node) -> bool:
    return any(is_aggregate(x) for x in T.walk(node))


def columns_of(node) -> list:
    return [x for x in T.walk(node) if isinstance(x, (T.Name, T.Pos, T.Dot, T.Unbox))]


def compile_(node, lookup: Callable, python: dict | None = None) -> Typed:
    """A typed column; ``lookup`` gives those of column references. Types are checked here."""
    go = lambda n: compile_(n, lookup, python)
    if isinstance(node, T.Lit):
        return literal(node.value, node.type)
    if isinstance(node, T.Op):
        return operate(node.op, [go(a) for a in node.args])
    if isinstance(node, T.Case):
        return case([(go(c), go(v)) for c, v in node.whens], go(node.default))
    if isinstance(node, T.Cast):
        return cast(node.type, go(node.arg))
    if isinstance(node, T.Call):
        if python and node.name in python:
            f, kind = python[node.name]
            return Typed(f(*[go(a).col for a in node.args]), kind)
        if node.name in AGGREGATES:
            raise E.NestedAggregate(node.name)
        return builder(node.name, len(node.args))(*[go(a) for a in node.args])
    if isinstance(node, tuple):
        raise E.InvalidStatement("a tuple-valued function stands alone in an emit list")
    if isinstance(node, T.Fold):
        raise E.InvalidStatement(f"{node.func.name} can't be used here")
    return lookup(node)


def flatmaps(node) -> list:
    return [x for x in T.walk(node) if isinstance(x, T.Call) and x.name in FLATMAPS]
