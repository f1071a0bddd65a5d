"""Closure and components against brute force, and that programs of these forms run no rounds."""

import random
from collections import Counter

import pytest

from relspark.datalog import planner
from relspark.operators import fixpoint, graphs
from relspark.session import Session
from test_recursive_queries import closure


def edges(rng, nodes, number):
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(number)]


def least(pairs):
    root = {v: v for p in pairs for v in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("bits", [1 << 28, 1])
def test_closure(spark, monkeypatch, bits):
    monkeypatch.setattr(graphs, "BITS", bits)
    rng = random.Random(3)
    pairs = [*edges(rng, 60, 70), (100, 100), *((k, k + 1) for k in range(200, 300)), (301, 302), (302, 301)]
    assert Counter(map(tuple, graphs.closure(spark.createDataFrame(pairs, "x long, y long")).collect())) == Counter(closure(set(pairs)))
    named = [(f"n{a}", f"n{b}") for a, b in edges(rng, 30, 35)]
    assert Counter(map(tuple, graphs.closure(spark.createDataFrame(named, "x string, y string")).collect())) == Counter(closure(set(named)))


def test_closure_with_nulls(spark):
    pairs = [(None, 1), (1, 2), (2, 3), (3, None), (None, 9), (8, None), (9, 7), (5, None)]
    want = {(1, 2), (2, 3), (1, 3), (9, 7), *((None, y) for y in (1, 2, 3, 9, 7, None)), *((x, None) for x in (1, 2, 3, 8, 5))}
    assert Counter(map(tuple, graphs.closure(spark.createDataFrame(pairs, "x long, y long")).collect())) == Counter(want)
    assert graphs.closure(spark.createDataFrame([], "x long, y long")).collect() == []


def test_closure_leaves_what_fits_no_task(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "x long, y long")
    monkeypatch.setattr(graphs, "NODES", 2)
    assert graphs.closure(pairs) is None
    got = Session(spark, {"e": pairs}).query("E = scan(e); do P = [x, y] <- E + [from P, E where P.y = E.x emit P.x as x, E.y as y]; until convergence;", "P")
    assert Counter(map(tuple, got.collect())) == Counter([(1, 2), (2, 3), (1, 3)])


@pytest.mark.parametrize("local", [1 << 20, 0, 20])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(graphs, "LOCAL", local)
    pairs = [*edges(random.Random(4), 90, 60), (100, 100), *((k, k + 3) for k in range(200, 260))]
    assert Counter(map(tuple, graphs.components(spark.createDataFrame(pairs, "x long, y long")).collect())) == Counter(least(pairs).items())


@pytest.mark.parametrize("program", [
    "do P = [x, y] <- E + [from P, E where P.y = E.x emit P.x as x, E.y as y]; until convergence;",
    "do P = [x, y] <- [from E emit x, y] + [from E, P where P.x = E.y emit E.x as x, P.y as y]; until convergence;",
    "do P = [x, y] <- E + [from P as p, P as q where q.x = p.y emit p.x as x, q.y as y]; until convergence;"])
def test_programs_of_closures_run_no_rounds(spark, monkeypatch, program):
    monkeypatch.setattr(fixpoint, "stored", None)
    pairs = [*edges(random.Random(5), 25, 30), (40, 41)]
    got = Session(spark, {"e": spark.createDataFrame(pairs, "x long, y long")}).query("E = scan(e); " + program, "P")
    assert Counter(map(tuple, got.collect())) == Counter(closure(set(pairs)))


def test_datalog_closure_runs_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "stored", None)
    pairs = edges(random.Random(6), 25, 30)
    session = Session(spark, {"e": spark.createDataFrame(pairs, "x long, y long")})
    got = planner.run(session, "L(x, y) :- e(x, y). P(x, y) :- L(x, y). P(x, z) :- P(x, y), L(y, z).")["P"]
    assert Counter(map(tuple, got.collect())) == Counter(closure(set(pairs)))


@pytest.mark.parametrize("program, want", [
    # Backwards, other emits, another start or a condition more: other relations, by rounds.
    ("do P = [x, y] <- E + [from P, E where P.x = E.x emit P.x as x, E.y as y]; until convergence;", {(1, 2), (2, 3), (3, 4)}),
    ("do P = [x, y] <- [from E where x = 1 emit x, y] + [from P, E where P.y = E.x emit P.x as x, E.y as y]; until convergence;", {(1, 2), (1, 3), (1, 4)}),
    ("do P = [x, y] <- [from E emit y as x, x as y] + [from P, E where P.y = E.x emit P.x as x, E.y as y]; until convergence;", {(2, 1), (3, 2), (4, 3), (2, 2), (2, 3), (2, 4), (3, 3), (3, 4), (4, 4)}),
    ("do P = [x, y] <- E + [from P, E where P.y = E.x and E.y < 4 emit P.x as x, E.y as y]; until convergence;", {(1, 2), (2, 3), (3, 4), (1, 3)})])
def test_other_recursions_keep_their_results(spark, program, want):
    got = Session(spark, {"e": spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "x long, y long")}).query("E = scan(e); " + program, "P")
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_least_along_pairs_of_one_way(spark, monkeypatch):
    """Where pairs go one way, the least node that leads to each is no component's."""
    program = "E = scan(e); {both} do C = [v, min(c) as c] <- [from E emit x as v, x as c] + [from C, E where C.v = E.x emit E.y as v, C.c as c]; until convergence;"
    run = lambda pairs, both="": Counter(map(tuple, Session(spark, {"e": spark.createDataFrame(pairs, "x long, y long")}).query(program.format(both=both), "C").collect()))
    pairs = [(5, 1), (1, 7), (8, 7), (3, 8), (3, 3)]
    assert run(pairs) == Counter({5: 5, 1: 1, 7: 1, 8: 3, 3: 3}.items())
    assert run([*pairs, (None, 8)]) == Counter({5: 5, 1: 1, 7: 1, 8: 3, 3: 3, None: None}.items())
    both = "E = E + [from E emit y as x, x as y];"
    assert run(pairs, both) == Counter(least(pairs).items())
    monkeypatch.setattr(fixpoint, "ROUNDS", 0)
    monkeypatch.setattr(graphs, "LOCAL", 0)
    assert run(pairs, both) == Counter(least(pairs).items())


@pytest.mark.parametrize("bits", [1 << 28, 1])
@pytest.mark.parametrize("op", ["<", "<=", ">", ">=", None])
def test_closure_of_a_join_makes_no_pairs(spark, monkeypatch, op, bits):
    monkeypatch.setattr(graphs, "BITS", bits)
    monkeypatch.setattr(graphs, "closure", None)
    rng = random.Random(f"{op}")
    a, b = ([(rng.randrange(24) + 200 * (i % 2), rng.randrange(120)) for i in range(90)] for _ in range(2))
    b += [(k, v) for k, v in a if v % 2] + [(None, 5), (None, 6)]
    a += a[:9] + [(None, 5)]
    if op:
        a, b = a + [(3, None)], b + [(3, None)]
    better = {"<": int.__lt__, "<=": int.__le__, ">": int.__gt__, ">=": int.__ge__, None: lambda x, y: True}[op]
    links = {(x, y) for k, x in a for j, y in b if k is not None and k == j and x is not None and y is not None and better(x, y)}
    for kind, of in (("long", lambda v: v), ("string", lambda v: None if v is None else f"{v:03}")):
        session = Session(spark, {n: spark.createDataFrame([(k, of(v)) for k, v in rows], f"k long, v {kind}") for n, rows in (("a", a), ("b", b))})
        program = f"A = scan(a); B = scan(b); E = [from A, B where B.k = A.k {'and A.v ' + op + ' B.v' if op else ''} emit A.v as x, B.v as y]; do P = [x, y] <- E + [from P, E where P.y = E.x emit P.x as x, E.y as y]; until convergence;"
        assert Counter(map(tuple, session.query(program, "P").collect())) == Counter((of(x), of(y)) for x, y in closure(links))


def test_closure_of_a_join_in_datalog(spark, monkeypatch):
    monkeypatch.setattr(graphs, "closure", None)
    rows = [(k, k % 4 if k < 30 else k % 7) for k in range(60)]
    session = Session(spark, {"s": spark.createDataFrame(rows, "x long, k int")})
    got = planner.run(session, "L(x, y) :- s(x, k), s(y, k), x > y. P(x, y) :- L(x, y). P(x, z) :- L(x, y), P(y, z).")["P"]
    assert Counter(map(tuple, got.collect())) == Counter(closure({(x, y) for x, k in rows for y, j in rows if k == j and x > y}))


def test_closure_of_a_join_with_null_ends(spark):
    e = spark.createDataFrame([(1, None), (1, 2), (2, 3), (2, 2)], "k long, v long")
    got = Session(spark, {"e": e}).query("A = scan(e); B = scan(e); E = [from A, B where A.k = B.k emit A.v as x, B.v as y]; do P = [x, y] <- E + [from P, E where P.y = E.x emit P.x as x, E.y as y]; until convergence;", "P")
    assert Counter(map(tuple, got.collect())) == Counter([(None, None), (None, 2), (2, None), (None, 3), (3, None), *((x, y) for x in (2, 3) for y in (2, 3))])


def test_a_variable_written_again_has_its_own_pairs(spark):
    session = Session(spark, {"e": spark.createDataFrame([(1, 2), (1, 3)], "k long, v long")})
    got = session.query("A = scan(e); E = [from A as a, A as b where a.k = b.k and a.v < b.v emit a.v as x, b.v as y]; A = [from A emit k, v + 10 as v]; do P = [x, y] <- E + [from P, E where P.y = E.x emit P.x as x, E.y as y]; until convergence; out = P + [from A emit k as x, v as y];", "out")
    assert Counter(map(tuple, got.collect())) == Counter([(2, 3), (1, 12), (1, 13)])


@pytest.mark.parametrize("seen", [1 << 21, 40])
def test_spanning_pairs_are_few(spark, monkeypatch, seen):
    """As many as nodes or so, however many pairs there are; nodes alone and pairs with a null are among them."""
    monkeypatch.setattr(graphs, "SEEN", seen)
    for kind, of in (("long", lambda v: v), ("string", lambda v: f"n{v:03}")):
        pairs = [(of(a), of(b)) for a, b in [*edges(random.Random(7), 60, 3000), *edges(random.Random(8), 90, 40), (100, 100), (200, 201), (201, 201)]]
        frame = spark.createDataFrame(pairs, f"x {kind}, y {kind}")
        got = [tuple(r) for r in graphs.spanning(frame).collect()]
        assert set(least(got).items()) == set(least(pairs).items()) and len(got) < 4 * 93
        assert Counter(map(tuple, graphs.components(frame).collect())) == Counter(least(pairs).items())
        odd = spark.createDataFrame([*pairs, (None, of(1)), (of(2), None), (None, None)], f"x {kind}, y {kind}")
        got = [tuple(r) for r in graphs.spanning(odd).collect()]
        assert any(None in r for r in got) and set(least([r for r in got if None not in r]).items()) == set(least(pairs).items())
    assert graphs.spanning(spark.createDataFrame([], "x long, y long")).collect() == []


_TURNED = """E = scan(e); D = distinct([from E emit x, y]); Out = [from D emit x * 2 as x, y * 2 as y]; Both = Out + [from Out emit y as x, x as y];
    do C = [v, min(c) as c] <- [from Both emit x as v, x as c] + [from C, Both where C.v = Both.x emit Both.y as v, C.c as c]; until convergence;"""


def test_components_of_pairs_both_ways_need_no_distinct_pairs(spark, monkeypatch):
    pairs = 3 * edges(random.Random(9), 50, 40)
    made, spanning = [], graphs.spanning
    monkeypatch.setattr(fixpoint, "stored", None)
    monkeypatch.setattr(graphs, "spanning", lambda df: [made.append(df._jdf.queryExecution().optimizedPlan().toString()), spanning(df)][1], raising=False)
    got = Session(spark, {"e": spark.createDataFrame(pairs, "x long, y long")}).query(_TURNED, "C")
    assert Counter(map(tuple, got.collect())) == Counter({2 * v: 2 * c for v, c in least(pairs).items()}.items())
    assert len(made) == 1 and "Aggregate" not in made[0] and "Union" not in made[0]


@pytest.mark.parametrize("program", [
    _TURNED,
    _TURNED.replace("[from Out emit y as x, x as y]", "[from Out where x > 8 emit y as x, x as y]"),
    _TURNED.replace("[from Out emit y as x, x as y]", "[from D emit y as x, x as y]"),
    _TURNED.replace("Both = Out", "Was = Out; Out = [from D emit y as x, x + 7 as y]; Both = Was"),
    _TURNED.replace("distinct([from E emit x, y])", "[from E emit x, max(y) as y]")])
def test_pairs_both_ways_give_what_rounds_give(spark, monkeypatch, program):
    """Nulls, turned pairs of other rows, and names written again."""
    for extra in ([], [(None, 3)], [(4, None), (None, None)]):
        pairs = [(5, 1), (1, 7), (8, 7), (3, 8), (3, 3), (10, 11), (11, 10), (12, 12), (4, 2), *extra]
        run = lambda: Counter(map(tuple, Session(spark, {"e": spark.createDataFrame(2 * pairs, "x long, y long")}).query(program, "C").collect()))
        got = run()
        with monkeypatch.context() as m:
            m.setattr(fixpoint, "direct", lambda *a: None)
            assert got == run()


@pytest.mark.parametrize("pairs", [[(1, k) for k in range(2, 30)], edges(random.Random(10), 400, 900), edges(random.Random(11), 400, 100)])
def test_stars_of_parts(monkeypatch, pairs):
    """A task looks at so many pairs together; trees that are small against that go on, others leave it."""
    import pyarrow as pa

    monkeypatch.setattr(graphs, "SEEN", 100)
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pairs[i : i + 16], strict=True)], names=["x", "y"]) for i in range(0, len(pairs), 16)]
    got = [(a, b) for batch in graphs._stars(iter(20 * batches)) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    assert set(least(got).items()) == set(least(pairs).items()) and all(a <= b for a, b in got)
    assert len(pairs) > 50 or len(got) < 2 * len(least(pairs))


def test_nodes_of_one_pair_need_no_rounds(spark, monkeypatch):
    """A star around one node, and what hangs on it, end without contraction."""
    monkeypatch.setattr(graphs, "LOCAL", 5)
    monkeypatch.setattr(graphs.F, "xxhash64", None)
    pairs = [*((0, k) for k in range(1, 40)), *((50, k) for k in range(51, 70)), (80, 81), (90, 90)]
    assert Counter(map(tuple, graphs.components(spark.createDataFrame(pairs, "x long, y long")).collect())) == Counter(least(pairs).items())
