"""Python lambdas and functions as expressions of the language: their source is parsed and each node has its counterpart."""

from __future__ import annotations

import ast
import inspect
import textwrap

from relspark import errors as E
from relspark.functions.scalar import SCALARS
from relspark.lang import tree as T

_BIN = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%"}
_CMP = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.Gt: ">", ast.LtE: "<=", ast.GtE: ">="}
#: Python names of library functions that have another name here (fixed values).
_CALLS = {"str": "STRING", "int": "LONG", "float": "DOUBLE", "bool": "BOOLEAN"}
_RENAMED = {"min": "least", "max": "greatest", "fabs": "abs"}


def _same_code(node: ast.Lambda, f) -> bool:
    """Whether ``f`` is this lambda, of several in its line."""
    made = next(c for c in compile(ast.Expression(node), "", "eval").co_consts if inspect.iscode(c))
    own = f.__code__
    return (made.co_code, made.co_names, made.co_varnames) == (own.co_code, own.co_names, own.co_varnames) and [c for c in made.co_consts if not inspect.iscode(c)] == [c for c in own.co_consts if not inspect.iscode(c)]


def source_tree(f) -> tuple[list[str], ast.AST]:
    """(parameters, body) of a lambda or of a function that is one return statement."""
    text = textwrap.dedent(inspect.getsource(f))
    try:
        module = ast.parse(text)
    except SyntaxError:
        # A lambda inside a larger expression: the shortest text that parses from its first word on.
        start = text.index("lambda")
        for end in range(len(text), start, -1):
            try:
                module = ast.parse(text[start:end].strip())
                break
            except SyntaxError:
                continue
        else:
            raise E.ProgramError("the lambda's source can't be told apart") from None
    names = f.__code__.co_varnames[: f.__code__.co_argcount]
    for node in ast.walk(module):
        if isinstance(node, ast.Lambda) and _same_code(node, f):
            return list(names), node.body
        if isinstance(node, ast.FunctionDef) and node.name == f.__name__:
            body = [s for s in node.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
            if len(body) == 1 and isinstance(body[0], ast.Return):
                return list(names), body[0].value
            raise E.ProgramError(f"{f.__name__} is more than one return statement")
    raise E.ProgramError("no lambda or function found")


def convert(f, scalars: bool = False, functions: tuple[str, ...] = ()):
    """The expression of ``f``. Its parameters are records (``t.x`` and ``t[0]`` are columns), or values if ``scalars``."""
    names, body = source_tree(f)
    one = len(names) == 1

    def go(n: ast.AST):
        if isinstance(n, ast.Constant):
            kinds = {bool: "BOOLEAN", int: "LONG", float: "DOUBLE", str: "STRING", bytes: "BLOB"}
            if type(n.value) not in kinds:
                raise E.ProgramError(f"constant {n.value!r}")
            return T.Lit(n.value, kinds[type(n.value)])
        if isinstance(n, ast.Name):
            if scalars or n.id not in names:
                return T.Name(n.id)
            raise E.ProgramError(f"{n.id} is a record")
        if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id in names:
            return T.Name(n.attr) if one else T.Dot(n.value.id, n.attr)
        if isinstance(n, ast.Subscript):
            if isinstance(n.slice, ast.Slice):
                if n.slice.step is not None:
                    raise E.ProgramError("slices have no step")
                s = go(n.value)
                begin = go(n.slice.lower) if n.slice.lower else T.Lit(0, "LONG")
                return T.Call("substr", (s, begin, go(n.slice.upper) if n.slice.upper else T.Call("len", (s,))))
            if isinstance(n.value, ast.Name) and n.value.id in names and isinstance(n.slice, ast.Constant):
                k = n.slice.value
                if isinstance(k, str):
                    return T.Name(k) if one else T.Dot(n.value.id, k)
                return T.Pos(k) if one else T.Dot(n.value.id, k)
        if isinstance(n, ast.BinOp):
            if isinstance(n.op, ast.Pow):
                return T.Call("pow", (go(n.left), go(n.right)))
            if type(n.op) in _BIN:
                return T.Op(_BIN[type(n.op)], (go(n.left), go(n.right)))
        if isinstance(n, ast.UnaryOp):
            if isinstance(n.op, ast.Not):
                return T.Op("not", (go(n.operand),))
            if isinstance(n.op, ast.USub):
                return T.Op("neg", (go(n.operand),))
        if isinstance(n, ast.BoolOp):
            out, op = go(n.values[0]), "and" if isinstance(n.op, ast.And) else "or"
            for v in n.values[1:]:
                out = T.Op(op, (out, go(v)))
            return out
        if isinstance(n, ast.Compare):
            out, left = None, n.left
            for op, right in zip(n.ops, n.comparators, strict=True):
                if type(op) not in _CMP:
                    raise E.ProgramError(f"comparison {type(op).__name__}")
                c = T.Op(_CMP[type(op)], (go(left), go(right)))
                out, left = c if out is None else T.Op("and", (out, c)), right
            return out
        if isinstance(n, ast.IfExp):
            return T.Case(((go(n.test), go(n.body)),), go(n.orelse))
        if isinstance(n, ast.Call) and not n.keywords:
            name = n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id if isinstance(n.func, ast.Name) else ""
            args = tuple(go(a) for a in n.args)
            if name in _CALLS and len(args) == 1:
                return T.Cast(_CALLS[name], args[0])
            name = _RENAMED.get(name, name)
            if name in functions or name.lower() in SCALARS:
                return T.Call(name, args)
            raise E.NoSuchFunction(name)
        raise E.ProgramError(f"no counterpart for {ast.dump(n)[:80]}")

    return go(body)


def where(df, f):
    """``df`` filtered by a lambda of its rows."""
    return df.filter(column(df, f).col)


def column(df, f):
    """The typed column that a lambda of the rows of ``df`` means."""
    from pyspark.sql import functions as F

    from relspark.plans.expressions import Scope, compile_, inline
    from relspark.sources.catalog import relation
    from relspark.types import Typed, widened

    rel = relation(df)
    cols = [Typed(widened(F.col(f"`{x.name}`"), x.dataType), t) for x, t in zip(df.schema.fields, rel.types, strict=True)]
    return compile_(inline(convert(f), {}), Scope({"t": rel}, cols))
