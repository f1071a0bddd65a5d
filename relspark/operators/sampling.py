"""Samples of an exact size."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window, functions as F

from relspark.operators.durable import checkpoint

#: Rows that one task may sort.
TAKE = 50_000


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with _n, 0 up to its rows - 1: rows are counted by partition, so none moves."""
    rows = checkpoint(df.withColumn("_id", F.monotonically_increasing_id()))
    part, inside = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("_p")).count()
    starts = counts.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return rows.withColumn("_p", part).join(starts, "_p").withColumn("_n", F.col("_start") + inside).drop("_p", "_id", "_start")


def without_replacement(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows (all, if there are fewer), those of the smallest draws. Draws are counted by bucket to find the one in which the sample ends; only that bucket is sorted."""
    if n <= TAKE:
        return df.orderBy(F.rand(seed)).limit(n)
    rows = checkpoint(df.withColumn("_u", F.rand(seed)))
    buckets = 1 << max(10, (rows.count() // (TAKE // 4)).bit_length())
    rows = rows.withColumn("_b", F.floor(F.col("_u") * buckets))
    counts = rows.groupBy("_b").count().withColumn("_upto", F.sum("count").over(Window.orderBy("_b")))
    end = counts.filter(F.col("_upto") >= n).orderBy("_b").first()
    if end is None:
        return rows.select(*df.columns)
    last = rows.filter(F.col("_b") == end["_b"]).orderBy("_u").limit(n - end["_upto"] + end["count"])
    return rows.filter(F.col("_b") < end["_b"]).union(last).select(*df.columns)


def exact_sample(df: DataFrame, size: float, percent: bool, replacement: bool, seed: int | None = None) -> DataFrame:
    """``size`` rows (or that percentage of them, rounded), with or without replacement."""
    seed = random.randrange(1 << 31) if seed is None else seed
    total = df.count() if percent or replacement else 0
    n = round(total * size / 100) if percent else int(size)
    if not replacement:
        return without_replacement(df, n, seed)
    if not total:
        return df.limit(0)
    draws = df.sparkSession.range(n).select(F.floor(F.rand(seed) * total).alias("_n")).groupBy("_n").count()
    rows = numbered(df).join(draws, "_n")
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).select(*df.columns)
