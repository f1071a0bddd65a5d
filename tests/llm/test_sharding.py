import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from relspark.llm import sharding
from relspark.llm.common import fresh_path


def test_fisher_yates_is_uniform():
    n = Counter(tuple(sharding._fisher_yates(3, [1, i])) for i in range(6000))
    assert len(n) == 6 and all(800 < v < 1200 for v in n.values())
    assert sorted(sharding._fisher_yates(50, [0])) == list(range(50)) and len(sharding._fisher_yates(0, [0])) == 0


def test_law(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = sharding.external_shuffle(docs, fresh_path(spark, "shards"), bucket_bytes=20_000).collect()
    assert len(out) == docs.count() and {r.doc_id for r in out} == {r.doc_id for r in docs.select("doc_id").collect()}
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(8))
    again = sharding.external_shuffle(docs.repartition(7), fresh_path(spark, "shards"), bucket_bytes=20_000).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in again}
    first = sorted((r for r in out if r.shard == 0), key=lambda r: r.slot)
    assert [r.doc_id for r in first] != sorted(r.doc_id for r in first)


def test_growth_moves_rows_only_into_the_new_shard(spark):
    ids = spark.range(20_000).select(sharding.rendezvous(F.col("id"), 8).alias("a"), sharding.rendezvous(F.col("id"), 9).alias("b")).collect()
    assert all(r.b in (r.a, 8) for r in ids)
    counts = np.bincount([r.a for r in ids])
    assert counts.min() > 2300 and counts.max() < 2700


def test_equal_rows_are_spread_over_the_buckets(spark):
    """A third of all rows are equal in all columns; their shard's buckets share them, and slots are the same again."""
    rows = [(None, "same text " * 40)] * 400 + [(i, f"text {i} " * 40) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
    path = fresh_path(spark, "shards")
    out = sharding.external_shuffle(docs, path, bucket_bytes=5_000)
    back = spark.read.parquet(path)
    sizes = [r["count"] for r in back.groupBy("_shard", "_part").count().collect()]
    assert max(sizes) < 60
    slots = defaultdict(list)
    for r in out.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == 1200
    again = sharding.external_shuffle(docs, fresh_path(spark, "shards"), bucket_bytes=5_000).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out.collect()))


def test_rows_that_differ_in_other_columns_keep_their_slots(spark):
    rows = [(i % 3, "t", j) for i in range(6) for j in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more int")
    runs = [Counter(map(tuple, sharding.external_shuffle(docs.repartition(n), fresh_path(spark, "shards")).collect())) for n in (2, 5)]
    assert runs[0] == runs[1]


def test_awkward_rows(spark, awkward, nothing):
    out = sharding.external_shuffle(awkward, fresh_path(spark, "shards"))
    rows = out.collect()
    assert len(rows) == 12 and "score" in out.columns and "_shard" in out.columns and "_place" in out.columns and [c for c in out.columns].count("shard") == 1
    digest = out.select("doc_id", sharding.text_size(F.col("text")).alias("n"), sharding.text_crc32(F.col("text")).alias("c"), "text").collect()
    assert all(r.n == len((r.text or "").encode()) + 1 and r.c == zlib.crc32((r.text or "").encode()) for r in digest)
    assert sharding.external_shuffle(nothing, fresh_path(spark, "shards")).count() == 0
