from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from relspark.llm import jaccard_join, mixing, quality


def test_stages_take_effect(spark, tmp_path):
    """Each stage against a plain reading of its rule, on its own input."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("score", F.lit(1))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "jaccard_join", "mixing", "segmentation"]
    steps = dict(corpus_pipeline.STAGES)
    model = quality.learn(docs, spark.read.parquet(f"{d}/labels.parquet"))
    good = steps["quality_classifier"](spark, docs, d)
    wanted = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == wanted and 0 < len(wanted) < docs.count()
    good.write.parquet(str(tmp_path / "a"))
    good = spark.read.parquet(str(tmp_path / "a"))
    one = steps["jaccard_join"](spark, good, d)
    kept = [r.doc_id for r in one.collect()]
    groups = {r.doc_id: r.class_id for r in jaccard_join.near_duplicates(good).collect()}
    assert one.columns == docs.columns and sorted(kept) == sorted(set(groups.values()))
    one.write.parquet(str(tmp_path / "b"))
    one = spark.read.parquet(str(tmp_path / "b"))
    mixed = steps["mixing"](spark, one, d)
    copies = {r.doc_id: r.copies for r in mixing.mix_sizes(one).collect() if r.copies}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter(copies)
    mixed.write.parquet(str(tmp_path / "c"))
    mixed = spark.read.parquet(str(tmp_path / "c"))
    last = steps["segmentation"](spark, mixed, d).filter("sample = 1")
    assert Counter(r.doc_id for r in last.collect()) == Counter(r.doc_id for r in mixed.collect()) and last.filter("not round_trip").isEmpty()


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "pieces" in out.columns
