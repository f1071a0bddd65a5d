from collections import Counter

import pytest

from relspark import errors as E
from relspark.datalog.planner import run
from relspark.session import Session

R = [(1, 2), (2, 3), (3, 1), (3, 3), (1, 2)]
T = [(2, 5), (3, 7), (1, 1)]


@pytest.fixture
def go(spark):
    def f(text, name):
        s = Session(spark, {"R": spark.createDataFrame(R, "a long, b long"), "S": spark.createDataFrame(T, "a long, b long")})
        return Counter(map(tuple, run(s, text)[name].collect()))

    return f


def test_join_constants_conditions(go):
    assert go("A(x,z) :- R(x,y), S(y,z), x < 3.", "A") == Counter((a, d) for a, b in R for c, d in T if b == c and a < 3)
    assert go("A(x) :- R(x,3).", "A") == Counter((a,) for a, b in R if b == 3)
    assert go("A(x) :- R(x,x)", "A") == Counter((a,) for a, b in R if a == b)
    assert go("A(x,w) :- R(x,y), S(z,w), y < z.", "A") == Counter((a, d) for a, b in R for c, d in T if b < c)


def test_triangle(go):
    assert go("A(x,y,z) :- R(x,y), R(y,z), R(z,x).", "A") == Counter((a, b, d) for a, b in R for c, d in R for e, f in R if b == c and d == e and f == a)


def test_aggregates_and_unions(go):
    want = Counter()
    for k in {a for a, _ in R}:
        v = [b for a, b in R if a == k]
        want[k, len(v), sum(v)] += 1
    assert go("A(x, count(y), sum(y)) :- R(x,y).", "A") == want
    assert go("A(x) :- R(x,y). A(x) :- S(x,y).", "A") == Counter((a,) for a, _ in R + T)
    assert go("B(x,y) :- R(x,y), x > 1. A(x + y) :- B(x,y). # note", "A") == Counter((a + b,) for a, b in R if a > 1)


def test_recursion(go):
    closure = set(R)
    while more := {(a, d) for a, b in closure for c, d in R if b == c} - closure:
        closure |= more
    assert go("P(x,y) :- R(x,y). P(x,z) :- P(x,y), R(y,z).", "P") == Counter(closure)
    assert go("P(x,y) :- R(x,y). P(x,z) :- P(x,y), P(y,z).", "P") == Counter(closure)


def test_server_and_timestep(go):
    assert go("A@h(x)(x,y) :- R(x,y).", "A") == Counter(R)
    assert go("A@*(x,y)#t :- R(x,y).", "A") == Counter(R)


def test_errors(go):
    with pytest.raises(E.UndefinedVariable):
        go("A(x,z) :- R(x,y).", "A")
    with pytest.raises(E.ScriptSyntaxError):
        go("A(x :- R(x,y).", "A")
