"""Recursive queries over whole tables against brute force."""

from collections import Counter

import pytest

from relspark.queries import QUERIES

KEYS = range(1, 61)
ORDERS = [(i, 1 + (i * 5) % 23) for i in range(60)]
LINES = [(i % 60, 1 + (i * 11) % 37) for i in range(120)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, f"s{k}", k % 9, 1.0 * k) for k in KEYS], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(LINES, "l_orderkey long, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
    return d


def closure(pairs):
    out = set(pairs)
    while more := {(a, d) for a, b in out for c, d in pairs if b == c} - out:
        out |= more
    return out


def rows(spark, name, tables):
    return Counter(map(tuple, QUERIES[name](spark, tables).collect()))


def test_reachable(spark, tables):
    customer = dict(ORDERS)
    want = {1} | {y for x, y in closure({(customer[o], s) for o, s in LINES}) if x == 1}
    assert len(want) > 10
    assert rows(spark, "reachable", tables) == Counter((v,) for v in want)


def test_levels_and_components(spark, tables):
    customer = dict(ORDERS)
    trade = {(customer[o], s) for o, s in LINES}
    level, edge = {1: 0}, {1}
    while edge:
        edge = {s for b, s in trade if b in edge} - set(level)
        level |= dict.fromkeys(edge, max(level.values()) + 1)
    assert rows(spark, "reachable_levels", tables) == Counter(level.items())
    root = {x: x for b, s in trade for x in (2 * b, 2 * s + 1)}
    for _ in root:
        for b, s in trade:
            root[2 * b] = root[2 * s + 1] = min(root[2 * b], root[2 * s + 1])
    assert rows(spark, "connected_components", tables) == Counter(root.items())


def test_links(spark, tables):
    links = {(k, k + 7) for k in KEYS if k + 7 in KEYS}
    assert rows(spark, "transitive_closure", tables) == Counter(closure(links))
    starts, ends = Counter(x for x, _ in links), Counter(y for _, y in links)
    assert rows(spark, "recursive_count", tables) == Counter((k, starts[k] + ends[k]) for k in KEYS)


def test_datalog_recursive(spark, tables):
    assert rows(spark, "datalog_recursive", tables) == Counter((a, b) for a in KEYS for b in KEYS if a < b and a % 9 == b % 9)


def test_loops_compute_once_what_they_only_read(spark, monkeypatch):
    """Neither the next round nor the next statement computes a join before the loop, or a statement's result, again."""
    from relspark import session

    plans, kept = [], session.stored
    monkeypatch.setattr(session, "stored", lambda df: [plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df)][1])
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a long, b long")
    program = """E = scan(e); Two = distinct([from E as p, E as q where p.b = q.a emit p.a as x, q.b as y]); Edge = [1 as v]; Met = Edge;
        do Next = distinct([from Edge, Two where Edge.v = Two.x emit Two.y as v]); Edge = diff(Next, Met); Met = Met + Edge; while [from Edge emit count(*) > 0]; out = Met;"""
    assert Counter(map(tuple, session.Session(spark, {"e": e}).query(program, "out").collect())) == Counter([(1,), (3,), (5,)])
    # The join before the loop; then, each round, the new rows (one join for them, one for what is known) and all rows (none).
    assert [p.count("Join ") for p in plans] == [1] + [2, 0] * 3
