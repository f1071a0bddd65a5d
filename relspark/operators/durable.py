"""Cutting a plan's lineage with files that survive a lost executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, types as S


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that spark.checkpoint.dir names. Without one, a folder in the warehouse does where driver and executors are one process; a cluster needs the setting."""
    _folder(df)
    return df.checkpoint()


def _folder(df: DataFrame) -> str:
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows as Parquet files in the folder of checkpoints: several times smaller than a checkpoint, and of known size, so small relations are broadcast. Types that Parquet lacks are checkpointed."""
    if any(isinstance(f.dataType, (S.NullType, S.CalendarIntervalType)) for f in df.schema.fields):
        return checkpoint(df)
    path = f"{_folder(df).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def costly(df: DataFrame) -> bool:
    """Whether the plan does more than read, filter and compute columns."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().split()[0] not in ("Project", "Filter", "Relation", "LogicalRelation", "LocalRelation", "LogicalRDD", "Scan", "Union", "Range", "OneRowRelation"):
            return True
        below = node.children()
        todo += [below.apply(i) for i in range(below.size())]
    return False


def bytes_of(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
