"""Rows near others, counted, against all pairs."""

import random
from collections import Counter

import pytest

from relspark.session import Session

ODD = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 50.0, 100.1, 50.1, 149.99999999999999, 1e308, -1e308]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    value = lambda: rng.choice(ODD) if rng.random() < 0.2 else round(rng.uniform(-150, 150), 2) if rng.random() < 0.8 else rng.uniform(-150, 150)
    a = [(i % 70, rng.choice(["p", "q", None]), value()) for i in range(150)]
    b = [(i, rng.choice(["p", "q", "r", None]), value()) for i in range(300)]
    b += [(0, k, round(u + s * 50, 2)) for _, k, u in a if u is not None and abs(u) < 1000 for s in (1, -1)]
    return a, b, {"a": spark.createDataFrame(a, "i long, g string, u double"), "b": spark.createDataFrame(b, "j long, h string, v double")}


def plain(a, b, near):
    return Counter(i for i, g, u in a for _, h, v in b if g is not None and g == h and u is not None and v is not None and near(abs(u - v)))


@pytest.mark.parametrize("where, near", [
    ("g = h and abs(u - v) < 50", lambda d: d < 50), ("abs(v - u) <= 50 and h = g", lambda d: d <= 50), ("g = h and abs(u - v) < 0", lambda d: d < 0),
    ("g = h and abs(u - v) <= 0", lambda d: d <= 0), ("g = h and abs(u - v) < 0.5", lambda d: d < 0.5)])
def test_counts(spark, tables, where, near):
    a, b, frames = tables
    want = Counter(plain(a, b, near).items())
    for order in ("A, B", "B, A"):
        text = f"A = scan(a); B = scan(b); out = [from {order} where {where} emit i, count(*) as n];"
        assert Counter(map(tuple, Session(spark, dict(frames)).query(text, "out").collect())) == want
    assert "Join" not in Session(spark, dict(frames)).explain(text, "out")


@pytest.mark.parametrize("rest, emits", [("and i < 9", "i, count(*) as n"), ("", "i, j, count(*) as n"), ("", "i, sum(j) as n"), ("", "count(*) as n"), ("and u < 1", "i, count(*) as n")])
def test_other_forms_are_joins(spark, tables, rest, emits):
    text = f"A = scan(a); B = scan(b); out = [from A, B where g = h and abs(u - v) < 50 {rest} emit {emits}];"
    assert "Join" in Session(spark, dict(tables[2])).explain(text, "out")
