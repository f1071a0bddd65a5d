"""What several operators share: the shared folder, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A lookup table is broadcast only when a count has shown that it has at most so many (short) rows.
BROADCAST_ROWS = 100_000
#: Fewer files than cores are spread only if the table has at most so many bytes.
SPREAD_BYTES = 1 << 30


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names. A folder of one machine would not do, so there is none in its place."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and spark.sparkContext.master.startswith("local"):
        # Driver and executors are one process here.
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if not found:
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, which survive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``most`` rows (counted up to that bound); else leave the choice to Spark."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ..., so that none clashes with an operator's own, which begin otherwise."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def placed(df: DataFrame, name: str) -> str:
    """What ``by_place`` calls a column."""
    return f"c{df.columns.index(name)}"


def named_again(placed_df: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of ``df``, under their own names, from rows that ``by_place`` named."""
    return placed_df.select(*[f"c{i}" for i in range(len(df.columns))]).toDF(*df.columns)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many partitions as there are cores, if it is a small table in fewer files than that: a file of one row group is read by
    one task, and Python work that follows would keep one core busy. Larger tables stay as their files are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and 0 < len(df.inputFiles()) < cores else df


def uniform(*parts: Column | str, bits: int = 52) -> Column:
    """A repeatable draw from (0, 1): the first 52 bits of the md5 of the parts, joined by '|'. Null parts count as ''."""
    text = F.concat_ws("|", *[F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**bits))
