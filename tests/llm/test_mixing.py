import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from relspark.llm import mixing
from relspark.llm.queries import MIX_SQL, ORACLE_SQL, QUERIES


def sql_rows(pdf, extra=""):
    con = duckdb.connect()
    con.register("t", pdf)
    return sorted(con.execute("WITH " + MIX_SQL.format(docs="t") + "SELECT doc_id, source, size, target, copies FROM mixed").fetchall(), key=repr)


def test_like_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = con.execute(ORACLE_SQL["op1_mixing"]).fetchdf()
    got = QUERIES["op1_mixing"](spark, small).toPandas()
    key = ["doc_id"]
    assert got.sort_values(key).reset_index(drop=True)[want.columns].equals(want.sort_values(key).reset_index(drop=True))
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), largest=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.largest).all() and (by.target <= 2 * by["size"]).all()
    assert abs(by.target.sum() - 1.5 * got["size"].sum()) < 1e-6 and (got.taken <= 2 * got["size"]).all()


def test_awkward_rows(awkward, nothing):
    rows = mixing.mix_sizes(awkward).collect()
    assert len(rows) == 12
    assert all(r.taken == r.size * r.copies and 0 <= r.copies <= 2 for r in rows)
    assert {(r.doc_id, r.size) for r in rows if r.doc_id in (3, 4)} == {(3, 0), (4, 0)}
    assert sorted(rows, key=repr) == sorted(mixing.mix_sizes(awkward.repartition(5)).collect(), key=repr)
    mixed = mixing.mix(awkward)
    assert mixed.columns == awkward.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_sizes(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_hot_source(spark):
    rows = [(i, "w " * (i % 7 + 1), "hot" if i % 3 else f"s{i % 5}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sizes(df).toPandas()
    assert sorted(((r.doc_id, r.source, r.size, r.target, r.copies) for r in got.itertuples()), key=repr) == sql_rows(df.toPandas())
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= 4).all()


@pytest.mark.parametrize("seed", ["a", "b"])
def test_inclusion_follows_rate(spark, seed):
    df = spark.createDataFrame([(i, "one two", "x" if i % 4 else "y") for i in range(4000)], "doc_id long, text string, source string")
    got = mixing.mix_sizes(df, seed=seed).groupBy("source").agg({"copies": "avg", "target": "max", "source_size": "max"}).collect()
    for r in got:
        assert abs(r["avg(copies)"] - r["max(target)"] / r["max(source_size)"]) < 2e-3


def test_inclusion_by_size(spark):
    """Of a source, documents with more words are likelier to be taken once more, in proportion to their weight."""
    sizes = [1, 5, 30, 120] * 60
    rows = [(i, "w " * n, "big") for i, n in enumerate(sizes)] + [(1000 + i, "w " * 10, s) for i in range(200) for s in ("other", "more")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    sized, _ = mixing.plan_mix(df)
    rates = {r._mix_key: r for r in mixing.source_rates(sized, mixing.source_targets(sized)).collect()}
    r = rates["0big"]
    runs = [mixing.mix_sizes(df, seed=str(s)).filter("source = 'big'").groupBy("size").agg(F.avg("copies").alias("n")).collect() for s in range(12)]
    weights = {1: 2, 5: 4, 30: 8, 120: 16}
    for size, w in weights.items():
        p = 1.0 if r._mix_full is not None and w >= r._mix_full else r._mix_c * w
        got = np.mean([x.n for run in runs for x in run if x["size"] == size])
        assert abs(got - r._mix_whole - p) < 4 * np.sqrt(p * (1 - p) / (60 * 12)) + 0.02, (size, got, p)
    assert 0 < r._mix_c * 2 < r._mix_c * 8 < 1


def test_certain_documents_first(spark):
    """A document so large that its chance would pass 1 is taken for certain, whatever the seed, and never more than twice."""
    rows = [(0, "w " * 4000, "a")] + [(i, "w " * 10, "a") for i in range(1, 401)] + [(1000 + i, "w " * 10, "b") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    for seed in "xyz":
        got = mixing.mix_sizes(df, seed=seed).filter("source = 'a'").toPandas()
        whole = int(got.target[0] // got.source_size[0])
        assert got[got.doc_id == 0].copies.iloc[0] == min(whole + 1, 2) and got.copies.max() <= 2
        assert abs(got.taken.sum() - got.target[0]) <= 10


def test_buckets_follow_the_rows(spark, small, monkeypatch):
    want = sorted(map(repr, QUERIES["op1_mixing"](spark, small).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    monkeypatch.setattr(mixing, "BUCKETS", 1)
    assert sorted(map(repr, QUERIES["op1_mixing"](spark, small).collect())) == want
