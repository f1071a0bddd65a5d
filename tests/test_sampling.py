"""Exact samples without replacement by a cut through draws."""

from relspark.operators import sampling


def test_large_samples_are_cut_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(sampling, "TAKE", 40)
    df = spark.range(5000).repartition(5)
    for n in (41, 777, 4999, 5000, 6000):
        got = [r.id for r in sampling.without_replacement(df, n, 3).collect()]
        assert len(got) == len(set(got)) == min(n, 5000)
    hits = [0] * 5000
    for seed in range(6):
        for r in sampling.without_replacement(df, 2500, seed).collect():
            hits[r.id] += 1
    assert abs(sum(hits[:2500]) - 7500) < 300 and sampling.without_replacement(df.limit(0), 100, 1).count() == 0
    plan = sampling.exact_sample(df, 50, True, False, 1)._jdf.queryExecution().executedPlan().toString()
    assert "limit=2500" not in plan
