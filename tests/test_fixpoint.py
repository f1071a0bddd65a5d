"""Recursive relations against plain fixpoints."""

from collections import Counter

import pytest

from relspark import errors as E
from relspark.session import Session

EDGES = [(1, 2, 5), (2, 3, 1), (1, 3, 9), (3, 1, 2), (3, 4, 1), (6, 7, 3), (7, 6, 3)]


@pytest.fixture
def run(spark):
    def f(text, name):
        return Counter(map(tuple, Session(spark, {"e": spark.createDataFrame(EDGES, "a long, b long, w long")}).query("E = scan(e); " + text, name).collect()))

    return f


def test_shortest_paths_keep_the_least(run):
    got = run("do D = [v, min(d) as d] <- [1 as v, 0 as d] + [from D, E where D.v = E.a emit E.b as v, D.d + E.w as d]; until convergence async alternate;", "D")
    assert got == Counter([(1, 0), (2, 5), (3, 6), (4, 7)])


def test_lexmin_keeps_whole_tuples(run):
    got = run("do P = [v, lexmin(d, p)] <- [1 as v, 0 as d, 0 as p] + [from P, E where P.v = E.a emit E.b as v, P.d + E.w as d, E.a as p]; until convergence;", "P")
    assert got == Counter([(1, 0, 0), (2, 5, 1), (3, 6, 2), (4, 7, 3)])


def test_mutual_recursion(run):
    got = run("do Odd = [v] <- [from Even, E where Even.v = E.a emit E.b as v]; Even = [v] <- [6 as v] + [from Odd, E where Odd.v = E.a emit E.b as v]; until convergence sync pull_idb;", "Odd")
    assert got == Counter([(7,)])


def test_count_filter(run):
    """A vertex is known if two known ones, or the start, point to it."""
    got = run("do Seen = [v, count(*) as n] <- [1 as v] + [1 as v] + [from Seen, E where Seen.n >= 2 and Seen.v = E.a emit E.b as v]; until convergence;", "Seen")
    assert got == Counter([(1, 2), (2, 1), (3, 1)])


def test_nonlinear_recursion(run):
    got = run("do P = [a, b] <- [from E emit a, b] + [from P as x, P as y where x.b = y.a emit x.a as a, y.b as b]; until convergence;", "P")
    want = {(a, b) for a, b, _ in EDGES}
    while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= more
    assert got == Counter(want)


def test_errors(run):
    with pytest.raises(E.InvalidStatement):
        run("do P = [v, sum(w)] <- [1 as v, 2 as w]; until convergence;", "P")
    with pytest.raises(E.InvalidStatement):
        run("do P = [v] <- [from Q emit v]; Q = [v] <- [from P emit v]; until convergence;", "P")
    with pytest.raises(E.UndefinedVariable):
        run("do P = [nope] <- [1 as v]; until convergence;", "P")
