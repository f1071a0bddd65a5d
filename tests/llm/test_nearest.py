import numpy as np
import pytest

from relspark.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_is_a_curve(dims, bits):
    cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
    keys = N.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(1 << (bits * dims)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def brute(rows, k=20, every=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % every == 0:
            s = sorted(((-float(v @ w), j) for j, w in ok if j != i))[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall(spark):
    d = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    want = brute([(r.vec_id, list(r.embedding)) for r in df.collect()])
    got = result(N.nearest(df))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 2.0]) for i in range(60)] + [(i, rng.normal(size=3).tolist()) for i in range(60, 140)]
    rows += [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 1.0]), (260, [1.0, float("nan"), 1.0]), (280, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (300, []), (320, [1.0, 2.0])]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], SCHEMA)
    want, got = brute([r for r in rows if r[0] != 320]), result(N.nearest(df))
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0)], SCHEMA)
    assert result(N.nearest(df)) == {0: [(1, 0.5)]}
    assert N.nearest(df.limit(0)).count() == 0
    assert N.nearest(df.filter("vec_id = 1")).count() == 0


def test_best_breaks_ties_by_id():
    x = np.array([[1.0], [3.0], [3.0], [3.0], [2.0]])
    row, col, score = N.best(np.array([[1.0], [-1.0]]), x, np.array([9, 8, 5, 7, 6]), 3)
    assert row.tolist() == [0, 0, 0, 1, 1, 1] and col.tolist() == [2, 3, 1, 0, 4, 2] and score.tolist() == [3, 3, 3, -1, -2, -3]
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(7, 40)), rng.normal(size=(900, 40))
    x[500:] = x[:400]
    ids = rng.permutation(900)
    row, col, score = N.best(q, x, ids, 25)
    for i in range(7):
        every = sorted((-sum_(q[i], x[j]), ids[j]) for j in range(900))[:25]
        assert [(-a, b) for a, b in every] == list(zip(score[row == i].tolist(), ids[col[row == i]].tolist(), strict=True))


def sum_(a, b):
    out = 0.0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        out += x * y
    return out


@pytest.mark.parametrize("kind", ["clusters", "none"])
def test_recall_and_comparisons(spark, kind):
    """12,000 vectors. In clusters, few are compared; without structure, never more than all."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(150, 48)) if kind == "clusters" else np.zeros((1, 48))
    x = (centre[rng.integers(0, len(centre), 12_000)] + rng.normal(size=(12_000, 48)) * (0.15 if kind == "clusters" else 1.0)).astype(np.float32)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], SCHEMA).repartition(6)
    report = {}
    got = result(N.nearest(df, report=report))
    x = x.astype(float)
    score = x[::20] @ x.T
    score[np.arange(600), np.arange(0, 12_000, 20)] = -np.inf
    want = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len({j for j, _ in got[20 * i]} & set(w.tolist())) / 20 for i, w in enumerate(want)]) >= 0.9
    assert all(s == sum_(x[q], x[j]) for q in list(got)[:20] for j, s in got[q])
    assert report["compared"] <= (report["rows"] / 4 if kind == "clusters" else report["rows"])


def test_tied_classes_go_to_the_smaller_id(spark):
    """Different vectors with the same product with the query."""
    rows = [(0, [1.0, 0.0])] + [(i, [0.5, i / 64]) for i in range(1, 60)]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], SCHEMA)
    assert result(N.nearest(df, k=4, every=1000))[0] == [(1, 0.5), (2, 0.5), (3, 0.5), (4, 0.5)]
