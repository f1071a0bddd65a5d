"""Random programs: the lowering against plain Python."""

import math
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from relspark.functions.evaluate import evaluate
from relspark.lang import tree as T
from relspark.lang.lexer import tokenize
from relspark.plans.expressions import compile_
from relspark.session import Session
from relspark.types import Typed

ROWS = [(-7, 3, 2.5, "abc", True), (5, -2, -0.75, "", False), (0, 11, 4.0, "xyz w", True), (123456, 7, 1e-3, "é", False)]
TYPES = {"i": "LONG", "j": "LONG", "d": "DOUBLE", "s": "STRING", "b": "BOOLEAN"}
FEW = settings(max_examples=6, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))


def longs(depth):
    base = st.one_of(st.integers(-9, 9).map(lambda v: T.Lit(v, "LONG")), st.sampled_from([T.Name("i"), T.Name("j")]))
    if not depth:
        return base
    sub, whole = longs(depth - 1), st.integers(1, 9).flatmap(lambda v: st.sampled_from([T.Lit(v, "LONG"), T.Lit(-v, "LONG")]))
    return st.one_of(
        base, st.tuples(st.sampled_from(["+", "-", "*"]), sub, sub).map(lambda t: T.Op(t[0], t[1:])), st.tuples(st.sampled_from(["//", "%"]), sub, whole).map(lambda t: T.Op(t[0], t[1:])),
        sub.map(lambda x: T.Op("neg", (x,))), sub.map(lambda x: T.Call("abs", (x,))), st.tuples(st.sampled_from(["least", "greatest"]), sub, sub).map(lambda t: T.Call(t[0], t[1:])),
        strings(depth - 1).map(lambda x: T.Call("len", (x,))), st.tuples(booleans(depth - 1), sub, sub).map(lambda t: T.Case(((t[0], t[1]),), t[2])),
    )


def strings(depth):
    base = st.one_of(st.sampled_from(["", "a", "bc", "é!"]).map(lambda v: T.Lit(v, "STRING")), st.just(T.Name("s")))
    if not depth:
        return base
    sub, n = strings(depth - 1), st.integers(0, 4).map(lambda v: T.Lit(v, "LONG"))
    return st.one_of(base, st.tuples(sub, sub).map(lambda t: T.Call("concat", t)), st.tuples(st.sampled_from(["head", "tail"]), sub, n).map(lambda t: T.Call(t[0], t[1:])), st.tuples(sub, n, n).map(lambda t: T.Call("substr", t)))


def booleans(depth):
    base = st.one_of(st.booleans().map(lambda v: T.Lit(v, "BOOLEAN")), st.just(T.Name("b")))
    if not depth:
        return base
    sub, compare = booleans(depth - 1), st.sampled_from(["==", "!=", "<", ">", "<=", ">="])
    return st.one_of(base, st.tuples(st.sampled_from(["and", "or"]), sub, sub).map(lambda t: T.Op(t[0], t[1:])), sub.map(lambda x: T.Op("not", (x,))), st.tuples(compare, longs(depth - 1), longs(depth - 1)).map(lambda t: T.Op(t[0], t[1:])), st.tuples(compare, strings(depth - 1), strings(depth - 1)).map(lambda t: T.Op(t[0], t[1:])))


@FEW
@given(st.lists(st.one_of(longs(3), strings(2), booleans(3)), min_size=12, max_size=12))
def test_expressions(spark, exprs):
    df = spark.createDataFrame(ROWS, "i long, j long, d double, s string, b boolean")
    env = {n: Typed(F.col(n), t) for n, t in TYPES.items()}
    got = df.select(*[compile_(e, lambda n: env[n.name]).col.alias(f"c{k}") for k, e in enumerate(exprs)]).collect()
    for row, out in zip(ROWS, got, strict=True):
        values = dict(zip(TYPES, row, strict=True))
        for e, v in zip(exprs, out, strict=True):
            want = evaluate(e, values)
            assert v == want or isinstance(want, float) and math.isclose(v, want), (e, values)


pairs = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=12)


@FEW
@given(pairs, pairs)
def test_relations(spark, left, right):
    make = lambda rows: spark.createDataFrame(rows, "a long, b long")
    s = Session(spark, {"l": make(left), "r": make(right)})
    run = lambda text: Counter(map(tuple, s.query("l = scan(l); r = scan(r); " + text, "out").collect()))
    a, b = Counter(left), Counter(right)
    assert run("out = l + r;") == a + b
    assert run("out = diff(l, r);") == Counter(set(a) - set(b))
    assert run("out = [from l, r where l.b = r.a and l.a < r.b emit l.a, r.b];") == Counter((x, w) for x, y in left for z, w in right if y == z and x < w)
    by = defaultdict(list)
    for x, y in left:
        by[x].append(y)
    assert run("out = [from l emit a, sum(b), count(*), max(b) - min(b)];") == Counter((x, sum(v), len(v), max(v) - min(v)) for x, v in by.items())


@FEW
@given(pairs)
def test_closure(spark, edges):
    s = Session(spark, {"e": spark.createDataFrame(edges, "a long, b long")})
    got = {tuple(r) for r in s.query("e = scan(e); do p = [a, b] <- e + [from p, e where p.b = e.a emit p.a as a, e.b as b]; until convergence;", "p").collect()}
    want = set(edges)
    while more := {(x, w) for x, y in want for z, w in edges if y == z} - want:
        want |= more
    assert got == want


@given(st.text(alphabet="abc 'x\"\\\n$*=<>-/()[]{},;:.0123456789eE_", max_size=40))
def test_lexer_takes_or_rejects_any_text(text):
    from relspark.errors import ScriptSyntaxError

    try:
        assert tokenize(text)[-1].kind == "end"
    except ScriptSyntaxError:
        pass
