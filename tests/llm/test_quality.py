import zlib

import numpy as np
from pyspark.sql import functions as F

from relspark.llm import quality
from relspark.llm.queries import QUERIES


def test_features_by_hand():
    texts = ["a b c a b c", "", "THE!! cat", "a b c a b c"]
    doc, place = quality.features(texts)
    sets = [set(place[doc == i].tolist()) for i in range(4)]
    assert sets[0] == sets[3] and sets[1] == set() and len(sets[2]) == 2 + 2 + 1
    assert all(len(place[doc == i]) == len(s) for i, s in enumerate(sets))
    # Words a, b, c; tokens 0 0 0 1 0 0 (1: the three words from here on came before): 0 and 1; 00 01 10; 000 001 010 100.
    assert len(sets[0]) == 3 + 2 + 3 + 4
    alone = quality.features(["THE!! cat"])
    assert set(alone[1].tolist()) == sets[2]


def test_dual_descent_is_optimal():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(120):
        label = i % 2
        rows.append(np.unique(np.concatenate([rng.integers(0, 40, 6), [100 + label] if rng.random() < 0.9 else [102]])))
        y.append(label)
    y = np.array(y)
    w, bias = quality.fit(rows, y, epochs=400)
    counts = [np.full(quality.DIM, 1.0), np.full(quality.DIM, 1.0)]
    for r, label in zip(rows, y, strict=True):
        counts[label][r] += 1
    ratio = np.where(counts[0] + counts[1] > 2, np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum())), 0)
    used = np.unique(np.concatenate(rows))
    X = np.zeros((len(rows), len(used) + 1))
    for i, r in enumerate(rows):
        X[i, np.searchsorted(used, r)] = ratio[r] / np.sqrt(len(r))
        X[i, -1] = 1
    s = np.where(y == 1, 1.0, -1.0)
    raw = np.divide(w[used], ratio[used], out=np.zeros(len(used)), where=ratio[used] != 0)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - s * (X @ v)).sum()
    best = np.append(raw, bias)
    for _ in range(300):
        assert loss(best) <= loss(best + rng.normal(size=len(best)) * 10.0 ** rng.integers(-3, 0)) + 1e-2


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality.score(docs, quality.learn(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    assert (out.predicted == out.quality).mean() >= 0.9
    pos, neg = out.score[out.quality == 1].to_numpy(), out.score[out.quality == 0].to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > 0.9


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (9, 1, 0), (9, 0, 0), (None, 1, 0), (6, None, 0), (2, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(awkward, labels)
    rows = quality.score(awkward, model).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1 and len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert quality.keep(awkward, model).columns == awkward.columns
    assert quality.score(nothing, model).count() == 0
    none = quality.learn(awkward, labels.limit(0))
    assert {r.score for r in quality.score(awkward, none).collect()} == {0.5}
    assert quality.score(awkward, quality.learn(nothing, labels)).count() == 12


def test_held_out_is_by_crc(spark):
    import zlib

    got = {r.doc_id: r.h for r in spark.range(200).select(F.col("id").alias("doc_id"), quality.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)}


def test_bound_on_features(spark):
    """The bound cuts by row: it takes as many texts, in order of their draw, as it allows, also where ids repeat."""
    good, bad = "a fine and quiet text about rivers", "BUY!! NOW 99 99 99"
    a, b = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    rows = [(a, f"{good} {i}") for i in range(20)] + [(b, f"{bad} {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(a, 1), (b, 0)], "doc_id long, quality int")
    per_row = [len(quality.features([t])[1]) for _, t in rows]
    free = quality.learn(docs, labels)
    bound = quality.learn(docs, labels, features=sum(per_row) - 1)
    tight = quality.learn(docs, labels, features=1)
    assert free["w"].any() and bound["w"].any() and not np.array_equal(free["w"], bound["w"]) and not tight["w"].any()
    one = quality.learn(docs.union(docs).union(docs), labels)
    assert np.array_equal(one["w"], free["w"]) and one["bias"] == free["bias"]


def test_scores_like_brute_force(spark, small):
    """Scores of the query against a plain reading of the texts: indicators by text, log-count ratios, the weights' sum, the sigmoid."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = docs.select("doc_id", "text").collect()
    known = {}
    for r in labels.collect():
        if r.quality is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            known[r.doc_id] = min(known.get(r.doc_id, 1), r.quality)
    order = {r.doc_id: r.d for r in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id").alias("d")).collect()}
    train = sorted((order[r.doc_id], r.doc_id, r.text) for r in rows if r.doc_id in known)
    places = [np.unique(quality.features([t])[1]) for *_, t in train]
    model = quality.train(places, np.array([known[i] for _, i, _ in train]))
    got = {r.doc_id: r.score for r in QUERIES["op3_quality_classifier"](spark, small).collect()}
    assert len(got) == len(rows)
    for r in rows:
        p = quality.features([r.text])[1]
        m = model["w"][p].astype(float).sum() / max(len(p), 1) ** 0.5 + model["bias"]
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-(model["a"] * m + model["b"])))) < 1e-6
