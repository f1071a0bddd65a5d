"""Token ids as Parquet list columns that can be read selectively.

A file row holds doc_id, n_tokens, part (the task that wrote it), part_start (ids of the part's documents before it) and the ids as a
list<int>. Ids are dictionary-encoded (a vocabulary has few distinct ids; where the dictionary would grow too large
Parquet falls back to delta encoding in its version 2 pages); row groups and pages are small, and Parquet's column and
offset indexes let a reader take one document's pages, or the counts without the ids.

Rows are written in ascending order of doc_id (null first; equal ids by a 64-bit hash of the text). The tokens before a document are
its part's tokens before it, stored, plus those of the parts before, a table of one row per written part.

Defined cases: a null text is empty, so its only id is the end id; null and repeated doc_ids are rows like others; an empty
table writes no rows; other columns are not written.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from relspark.llm.common import maybe_broadcast
from relspark.llm.units import UnitEncoder, byte_chunks, release

END_ID = 0
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def _encoder(path: str, end_id: int):
    def run(batches):
        encoder, start = UnitEncoder.get(path), 0
        for batch in batches:
            for a, b in byte_chunks(batch.column("text")):
                ids, count = encoder.encode(batch.column("text")[a:b])
                ends = np.cumsum(count)
                ids = np.insert(ids, ends, end_id).astype(np.int32)
                count = count + 1
                offsets = np.concatenate([[0], np.cumsum(count)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], batch.column("part")[a:b], pa.array(start + offsets[:-1]), pa.array(count), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                start += int(offsets[-1])
                release()

    return run


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = END_ID, row_group_bytes: int = 32 << 20, page_rows: int = 2000) -> DataFrame:
    """Encode the texts, write the files and return them as read back, with ``start``: the tokens of all documents before."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    out = rows.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(_encoder(tokenizer, end_id), SCHEMA)
    write = out.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows)
    write.option("parquet.enable.dictionary", "true").option("parquet.writer.version", "v2").parquet(path)
    return read_token_ids(docs.sparkSession, path)


def read_token_ids(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids. The starts need only the counts, so their columns are all that is read for them."""
    back = spark.read.schema(SCHEMA).parquet(path)
    totals = back.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = maybe_broadcast(totals.select("part", before.alias("_base")))
    return back.join(bases, "part").select("doc_id", (F.col("_base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _crc(batches):
    for batch in batches:
        lists = batch.column("ids")
        ends = np.asarray(lists.offsets)
        raw = np.asarray(lists.values).astype("<u4", copy=False)
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """The ids of each row as a crc32 of little-endian unsigned 32-bit integers."""
    return tokens.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
