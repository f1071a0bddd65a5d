"""Two-pass external shuffle into shards.

Pass one scatters rows by seeded hashes into buckets that fit in memory: shard by rendezvous hashing of the doc_id (the shard whose
hash with the doc_id is largest, so doc_id and the number of shards decide, and one more shard takes rows only into
itself), bucket within the shard by a second hash, of all columns. The number of buckets follows the total size, and there is a task for each. Pass two
reads one bucket at a time, puts it in a fixed order, applies a Fisher-Yates shuffle seeded by the bucket, and writes it. A row's slot is its
place in its bucket plus the rows of the shard's buckets before it.

Rows that are equal in all columns have equal hashes. Where that makes a bucket larger than ``HOT`` buckets (a sum by bucket tells), its rows are dealt
out by their number in the scan too; equal rows are interchangeable, so slots are repeatable over the same files.

Defined cases: a null text has size 1 (its bytes: none) and crc32 0; null doc_ids all have one shard, which the law asks for; rows with the same doc_id
stay in one shard but are spread over its buckets by their other columns; an empty table gives an empty result; other columns are
written along, whatever their names, but one that is named like an output column (``law``, ``shard``, ``slot``, ``grown_shard``) is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from relspark.llm.common import by_place, maybe_broadcast, placed

OUT = ("law", "shard", "slot", "grown_shard")
BUCKET_BYTES = 32 << 20
#: A bucket of more than so many times its share is one of equal rows.
HOT = 4
SEED = 7


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1)


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def rendezvous(key: Column, shards: int, seed: int = SEED) -> Column:
    draws = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("i")) for i in range(shards)]
    return F.array_max(F.array(*draws))["i"]


def _fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform order of n places; numpy's shuffle is Fisher and Yates's, from the last place on."""
    at = np.arange(n)
    np.random.Generator(np.random.PCG64(seed)).shuffle(at)
    return at


def _shuffler(names: list[str], seed: int):
    """A task's rows, which are those of one bucket, in the bucket's shuffled order."""

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        bucket, row, ident = (np.asarray(table.column(c).combine_chunks()) for c in ("_bucket", "_row", "_id"))
        order = np.lexsort([row, ident, bucket])
        ends = np.flatnonzero(np.diff(bucket[order], append=-1))
        first = 0
        for end in (ends + 1).tolist():
            at = order[first:end][_fisher_yates(end - first, [seed, int(bucket[order[first]])])]
            yield from table.take(pa.array(at)).select(names).append_column("_place", pa.array(np.arange(len(at)))).to_batches()
            first = end

    return run


def external_shuffle(docs: DataFrame, path: str, *, shards: int = 8, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Write the rows, shuffled, under ``path`` (Parquet, a folder per shard) and return what is read back: the columns of ``docs`` with law, shard, slot, grown_shard."""
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in OUT])
    rows, doc_id, text = by_place(docs), F.col(placed(docs, "doc_id")), F.col(placed(docs, "text"))
    hashed = [F.col(f"c{i}") for i, f in enumerate(docs.schema) if "map<" not in f.dataType.simpleString()]
    kept = rows.columns
    total = rows.agg(F.sum(text_size(text))).first()[0] or 0
    per_shard = max(1, -(-int(total) // (shards * bucket_bytes)))
    rows = rows.select(*kept, rendezvous(doc_id, shards, seed).alias("_shard"), rendezvous(doc_id, shards + 1, seed).alias("_grown"), F.xxhash64(doc_id).alias("_id"), F.xxhash64(F.lit(seed + 1), *hashed).alias("_row"))
    bucket = lambda part: F.col("_shard").cast("long") * per_shard + part
    own = F.pmod(F.col("_row"), F.lit(per_shard)).cast("int")
    if per_shard > 1:
        sums = rows.groupBy(bucket(own).alias("_hot")).agg(F.sum(text_size(text)).alias("n")).filter(F.col("n") > HOT * bucket_bytes)
        hot = [r[0] for r in sums.select("_hot").collect()]
        if hot:
            more = F.pmod(F.xxhash64("_row", F.monotonically_increasing_id()), F.lit(per_shard)).cast("int")
            own = F.when(F.array_contains(F.lit(hot), bucket(own)), more).otherwise(own)
    rows = rows.withColumn("_part", own).withColumn("_bucket", bucket(F.col("_part")))
    names = [*kept, "_shard", "_grown", "_part"]
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in rows.select(*names).schema), T.StructField("_place", T.LongType())])
    dealt = rows.repartitionById(shards * per_shard, F.col("_bucket").cast("int"))
    mixed = dealt.mapInArrow(_shuffler(names, seed), schema)
    mixed.withColumn("_in", F.col("_shard")).write.partitionBy("_in").parquet(path)
    back = docs.sparkSession.read.schema(schema).parquet(path)
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = back.groupBy("_shard", "_part").count().select("_shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    out = back.join(maybe_broadcast(counts), ["_shard", "_part"])
    slot = F.col("_start") + F.col("_place")
    return out.select(*kept, F.lit("key"), "_shard", slot, "_grown").toDF(*docs.columns, *OUT)
