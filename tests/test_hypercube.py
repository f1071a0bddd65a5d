import random
from collections import Counter

from relspark.operators import hypercube
from relspark.operators.hypercube import cyclic, multiway_join, sides
from relspark.plans import analyzer
from relspark.session import Session


def test_triangles(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(60)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = multiway_join([df.toDF("x", "y"), df.toDF("y", "z"), df.toDF("z", "x")], cells=8)
    want = Counter((a, b, d) for a, b in edges for c, d in edges if b == c for e, f in edges if e == d and f == a)
    assert Counter((r.x, r.y, r.z) for r in got.collect()) == want


def test_sides():
    assert sides(["x", "y", "z"], [{"x", "y"}, {"y", "z"}, {"z", "x"}], [100, 100, 100], 8) == {"x": 2, "y": 2, "z": 2}
    assert sides(["x"], [{"x"}, {"x"}], [10, 10], 4) == {"x": 4}
    assert max(sides(list("vwxyz"), [{"v", "w"}, {"w", "x"}, {"x", "y"}, {"y", "z"}, {"z", "v"}], [9] * 5, 64).values()) <= 4


def test_cycles():
    assert cyclic([{"x", "y"}, {"y", "z"}, {"z", "x"}]) and cyclic([{"a", "b"}, {"b", "c"}, {"c", "d"}, {"d", "a"}, {"a", "e"}])
    assert not cyclic([{"x", "y"}, {"y", "z"}, {"z", "u"}]) and not cyclic([{"x", "y"}, {"y", "z"}, {"z", "x"}, {"x", "y", "z"}]) and not cyclic([set(), set()])


def test_programs_join_large_cycles_on_a_grid(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(70)]
    tables = {"e": spark.createDataFrame([*edges, (None, 3)], "a long, b long")}
    program = "E = scan(e); out = [from E as p, E as q, E as r where p.b = q.a and q.b = r.a and r.b = p.a and p.a < q.a emit p.a as x, q.a as y, r.a as z];"
    want = Counter((a, b, d) for a, b in edges for c, d in edges if b == c for e, f in edges if e == d and f == a and a < b)
    assert Counter(map(tuple, Session(spark, dict(tables)).query(program, "out").collect())) == want
    assert "_cell" not in Session(spark, dict(tables)).explain(program, "out")
    monkeypatch.setattr(analyzer, "GRID_BYTES", 0)
    assert Counter(map(tuple, Session(spark, dict(tables)).query(program, "out").collect())) == want
    assert "_cell" in Session(spark, dict(tables)).explain(program, "out")


def test_cells_are_joined_without_another_shuffle(spark, monkeypatch):
    """Ways of two edges are many more than edges: they are neither shuffled nor sorted."""
    monkeypatch.setattr(analyzer, "GRID_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(3)
        edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(70)]
        tables = {"e": spark.createDataFrame([*edges, (4, None)], "a long, b long")}
        program = "E = scan(e); out = [from E as p, E as q, E as r where p.b = q.a and q.b = r.b and p.a = r.a and p.a < p.b emit p.a as x, q.a as y, r.b as z, p.b as w];"
        plan = Session(spark, dict(tables)).explain(program, "out")
        assert plan.count("REPARTITION_BY_NUM") > 0 and "ENSURE_REQUIREMENTS" not in plan and "SortMergeJoin" not in plan
        want = Counter((a, b, d, b) for a, b in edges for c, d in edges if b == c for e, f in edges if f == d and a == e and a < b)
        assert Counter(map(tuple, Session(spark, dict(tables)).query(program, "out").collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cells_grow_with_the_rows(spark, monkeypatch):
    """A cell's relations are in memory, so there are more cells for more rows."""
    monkeypatch.setattr(hypercube, "CELL_ROWS", 30)
    df = spark.createDataFrame([(i % 20, i // 20) for i in range(400)], "a long, b long")
    got = multiway_join([df.toDF("x", "y"), df.toDF("y", "z"), df.toDF("z", "x")], cells=8)
    assert got.count() == 20**3 and "hashpartitioning(_cell" in got._jdf.queryExecution().toString() and ", 64)" in got._jdf.queryExecution().toString()
