"""Syntax tree. Expressions and relations are frozen, so equal aggregates can be computed once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Lit:
    value: object
    type: str


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Pos:
    index: int


@dataclass(frozen=True)
class Dot:
    alias: str
    field: str | int


@dataclass(frozen=True)
class Unbox:
    relation: str
    field: str | int | None


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Case:
    whens: tuple
    default: object


@dataclass(frozen=True)
class Cast:
    type: str
    arg: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Fold:
    """A call of a stateful function or aggregate: its definition, arguments and which output is meant."""

    func: object
    args: tuple
    output: int


@dataclass(frozen=True)
class Ref:
    """A resolved column: key of the environment."""

    key: object


@dataclass(frozen=True)
class Emit:
    exprs: tuple
    names: tuple | None


@dataclass(frozen=True)
class Star:
    alias: str | None


# Relations.


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Scan:
    key: str


@dataclass(frozen=True)
class Sample:
    key: str
    size: float
    percent: bool
    kind: str


@dataclass(frozen=True)
class Load:
    path: str
    format: str
    schema: tuple
    options: tuple


@dataclass(frozen=True)
class EmptyRel:
    schema: tuple


@dataclass(frozen=True)
class Literal:
    emits: tuple


@dataclass(frozen=True)
class Bag:
    sources: tuple  # of (alias, relation or None)
    where: object
    emits: tuple
    order: tuple  # of (column, ascending)
    limit: int | None
    distinct: bool = False


@dataclass(frozen=True)
class Rel:
    """cross, union, intersect, diff, unionall, distinct, countall."""

    op: str
    args: tuple


@dataclass(frozen=True)
class JoinRel:
    left: object
    left_cols: tuple
    right: object
    right_cols: tuple


@dataclass(frozen=True)
class LimitRel:
    arg: object
    n: int


# Statements.


@dataclass(frozen=True)
class Assign:
    name: str
    rel: object


@dataclass(frozen=True)
class Store:
    name: str
    key: str
    how: str | None
    columns: tuple


@dataclass(frozen=True)
class Out:
    """sink, dump, export."""

    kind: str
    name: str
    uri: str | None = None


@dataclass(frozen=True)
class DoWhile:
    body: tuple
    cond: object


@dataclass(frozen=True)
class Rule:
    name: str
    emits: tuple
    rel: object


@dataclass(frozen=True)
class Until:
    rules: tuple
    options: tuple


@dataclass(frozen=True)
class Function:
    args: tuple
    bodies: tuple


@dataclass(frozen=True)
class Stateful:
    name: str
    args: tuple
    states: tuple  # of (name, init, update)
    outputs: tuple
    aggregate: bool
    local: object = None
    remote: object = None


def rebuild(node, f: Callable):
    """The node with f applied to each direct child expression."""
    if isinstance(node, tuple):
        return tuple(rebuild(x, f) if isinstance(x, tuple) else f(x) for x in node)
    if isinstance(node, (Op, Call)):
        return replace(node, args=tuple(f(a) for a in node.args))
    if isinstance(node, Fold):
        return replace(node, args=tuple(f(a) for a in node.args))
    if isinstance(node, Cast):
        return replace(node, arg=f(node.arg))
    if isinstance(node, Case):
        return Case(tuple((f(c), f(v)) for c, v in node.whens), f(node.default))
    return node


def walk(node):
    """The node and all expressions and relations below it."""
    if isinstance(node, (tuple, list)):
        for x in node:
            yield from walk(x)
    elif hasattr(node, "__dataclass_fields__"):
        yield node
        for f in fields(node):
            if not (isinstance(node, Fold) and f.name == "func"):
                yield from walk(getattr(node, f.name))
