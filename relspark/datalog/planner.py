"""Datalog rules to DataFrames.

A body is a join of its atoms on shared variables; constants and repeated variables are filters, and comparisons are filters that
Catalyst turns into join conditions. Rules with the same head are united as bags. Recursive heads keep distinct rows and
are computed to their least fixpoint, whole groups of mutually recursive heads together. Heads that no other rule
reads are the results. ``@h(x)`` deals a head out by columns, ``@*`` hints a broadcast; a timestep ``#t`` is read and has no effect.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from relspark import errors as E
from relspark.lang import tree as T
from relspark.lang.lexer import SAME
from relspark.lang.parser import relation_key
from relspark.operators.fixpoint import solve
from relspark.plans.analyzer import Analyzer
from relspark.session import Session
from relspark.sources.catalog import Relation, broadcast_if_small, frame

_TOKEN = re.compile(r"""\s+|\#[^\n]*(?:\n|$)|(?P<num>\d+\.\d+|\d+)|(?P<str>'[^']*'|"[^"]*")|(?P<id>[A-Za-z_][A-Za-z0-9_]*(?::[A-Za-z_][A-Za-z0-9_]*){0,2})|(?P<op>:-|@\*|<=|>=|!=|==|<>|[-+*/<>=(),.;@])""")
_AGGREGATES = ("count", "sum", "min", "max", "avg", "stdev")


@dataclass(frozen=True)
class Atom:
    name: str
    terms: tuple


@dataclass(frozen=True)
class Clause:
    name: str
    head: tuple
    how: str | None
    how_columns: tuple
    atoms: tuple
    conditions: tuple


class Reader:
    def __init__(self, text: str):
        # A timestep follows its head directly; a comment begins after white space or at a line's start.
        text = re.sub(r"(?<=\))#\w+(?=\s*:-)", "", text)
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise E.ScriptSyntaxError(f"unexpected {text[at : at + 10]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def take(self, value: str) -> bool:
        if self.tokens[self.at] == ("op", value):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise E.ScriptSyntaxError(f"{value!r} expected, not {self.tokens[self.at][1]!r}")

    def ident(self) -> str:
        kind, v = self.tokens[self.at]
        if kind != "id":
            raise E.ScriptSyntaxError(f"name expected, not {v!r}")
        self.at += 1
        return v

    def program(self) -> list[Clause]:
        out = []
        while self.tokens[self.at][0] != "end":
            out.append(self.clause())
        return out

    def clause(self) -> Clause:
        name = self.ident()
        how, columns = None, ()
        if self.take("@*"):
            how = "broadcast"
        elif self.take("@"):
            self.ident()
            self.need("(")
            columns = tuple(self.many(self.ident))
            how = "hash"
        self.need("(")
        head = tuple(self.many(self.expr))
        self.need(":-")
        atoms, conditions = [], []
        while True:
            if self.tokens[self.at][0] == "id" and self.tokens[self.at + 1] == ("op", "(") and self.tokens[self.at][1].lower() not in _AGGREGATES:
                a = self.ident()
                self.need("(")
                atoms.append(Atom(a, tuple(self.many(self.term))))
            else:
                left = self.expr()
                kind, op = self.tokens[self.at]
                if kind != "op" or op not in ("<", ">", "<=", ">=", "=", "==", "!=", "<>"):
                    raise E.ScriptSyntaxError(f"comparison expected, not {op!r}")
                self.at += 1
                conditions.append(T.Op(SAME.get(op, op), (left, self.expr())))
            if not self.take(","):
                break
        if not self.take("."):
            self.take(";")
        return Clause(name, head, how, columns, tuple(atoms), tuple(conditions))

    def many(self, item) -> list:
        out = [item()]
        while self.take(","):
            out.append(item())
        self.need(")")
        return out

    def term(self):
        kind, v = self.tokens[self.at]
        if kind == "id":
            self.at += 1
            return T.Name(v)
        return self.constant()

    def constant(self):
        minus = self.take("-")
        kind, v = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            n = float(v) if "." in v else int(v)
            return T.Lit(-n if minus else n, "DOUBLE" if "." in v else "LONG")
        if kind == "str" and not minus:
            return T.Lit(v[1:-1], "STRING")
        raise E.ScriptSyntaxError(f"constant expected, not {v!r}")

    def expr(self):
        e = self.product()
        while self.tokens[self.at] in (("op", "+"), ("op", "-")):
            op = self.tokens[self.at][1]
            self.at += 1
            e = T.Op(op, (e, self.product()))
        return e

    def product(self):
        e = self.factor()
        while self.tokens[self.at] in (("op", "*"), ("op", "/")):
            op = self.tokens[self.at][1]
            self.at += 1
            e = T.Op(op, (e, self.factor()))
        return e

    def factor(self):
        kind, v = self.tokens[self.at]
        if kind == "id":
            self.at += 1
            if self.take("("):
                if self.take("*"):
                    self.need(")")
                    return T.Call("countall", ())
                return T.Call(v, tuple(self.many(self.expr)))
            return T.Name(v)
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        return self.constant()


def body(clause: Clause, heads: set[str]) -> T.Bag:
    """The clause as a comprehension: a FROM entry for each atom, equalities for shared variables, constants and conditions."""
    sources, where, first = [], [], {}
    for i, atom in enumerate(clause.atoms):
        alias = f"_{i}"
        sources.append((alias, T.Var(atom.name) if atom.name in heads else T.Scan(relation_key(atom.name))))
        for j, t in enumerate(atom.terms):
            here = T.Dot(alias, j)
            if isinstance(t, T.Lit):
                where.append(T.Op("==", (here, t)))
            elif t.name != "_" and t.name in first:
                where.append(T.Op("==", (first[t.name], here)))
            elif t.name != "_":
                first[t.name] = here

    def bind(node):
        if isinstance(node, T.Name):
            if node.name not in first:
                raise E.UndefinedVariable(node.name)
            return first[node.name]
        return T.rebuild(node, bind)

    where += [bind(c) for c in clause.conditions]
    cond = None
    for w in where:
        cond = w if cond is None else T.Op("and", (cond, w))
    emits = tuple(T.Emit((bind(h),), (h.name,) if isinstance(h, T.Name) else None) for h in clause.head)
    return T.Bag(tuple(sources), cond, emits, (), None)


def components(reads: dict[str, set[str]]) -> list[list[str]]:
    """Strongly connected heads, each after those that it reads."""
    reach = {h: set(r) for h, r in reads.items()}
    for k in reach:
        for h in reach:
            if k in reach[h]:
                reach[h] |= reach[k]
    out, done = [], set()
    for h in sorted(reads, key=lambda h: (len(reach[h]), h)):
        if h not in done:
            group = [g for g in reads if g == h or h in reach[g] and g in reach[h]]
            out.append(group)
            done |= set(group)
    out.sort(key=lambda g: len(set().union(*(reach[h] for h in g)) | set(g)))
    return out


def run(session: Session, text: str, all_heads: bool = False) -> dict[str, DataFrame]:
    """Results of the heads that no other rule reads (or of all)."""
    clauses = Reader(text).program()
    heads = list(dict.fromkeys(c.name for c in clauses))
    reads = {h: {a.name for c in clauses if c.name == h for a in c.atoms if a.name in heads} for h in heads}
    variables: dict[str, Relation] = {}
    functions: dict = {}
    for group in components(reads):
        analyzer = Analyzer(session.catalog, functions, variables, session.python, session.seed)
        own = {h: [body(c, set(heads)) for c in clauses if c.name == h] for h in group}
        if len(group) > 1 or group[0] in reads[group[0]]:
            rules = tuple(T.Rule(h, tuple(T.Emit((T.Pos(i),), e.names) for i, e in enumerate(own[h][0].emits)), T.Rel("unionall", tuple(own[h]))) for h in group)
            variables |= solve(analyzer, rules)
        else:
            variables[group[0]] = analyzer.defined(own[group[0]][0] if len(own[group[0]]) == 1 else T.Rel("unionall", tuple(own[group[0]])))
    used = set().union(*(reads[h] - {h} for h in heads)) if heads else set()
    out = {}
    for c in clauses:
        if c.name in out or c.name in used and not all_heads:
            continue
        df = frame(variables[c.name])
        if c.how == "hash":
            df = df.repartition(*[x for x in c.how_columns if x in df.columns])
        elif c.how == "broadcast":
            df = broadcast_if_small(df)
        out[c.name] = df
    return out
