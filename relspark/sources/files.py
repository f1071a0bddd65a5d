"""Reading delimited files with a given schema, and writing one CSV file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from relspark.errors import InvalidStatement
from relspark.types import SPARK


def sniff(spark: SparkSession, path: str, skip: int) -> str:
    """The delimiter that the first line after ``skip`` has most of."""
    lines = spark.read.text(path).limit(skip + 1).collect()
    line = lines[-1][0] if len(lines) > skip else ""
    return max(",|\t; ", key=line.count)


def load(spark: SparkSession, path: str, kind: str, schema: tuple, options: dict) -> DataFrame:
    """CSV with delimiter, quote, escape and skip (leading lines to leave out). Other formats need a reader of their own."""
    if kind != "csv":
        raise InvalidStatement(f"{kind.upper()} files can't be read here")
    skip = int(options.get("skip", 0))
    delimiter = options.get("delimiter") or sniff(spark, path, skip)
    struct = T.StructType([T.StructField(n, SPARK[t]) for n, t in schema])
    how = {"sep": delimiter, "quote": options.get("quote", '"'), "escape": options.get("escape", "\\"), "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "FAILFAST"}
    if not skip:
        return spark.read.csv(path, schema=struct, **how)
    # Line numbers of each file's first lines: only its first split can hold them.
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    first = lines.filter("_start = 0").groupBy("_file").agg(F.min("_id").alias("_first"))
    kept = lines.join(F.broadcast(first), "_file", "left").filter((F.col("_start") > 0) | (F.col("_id") >= F.col("_first") + skip))
    row = F.from_csv("value", F.lit(struct.simpleString()[7:-1].replace(":", " ")), how)
    return kept.select(row.alias("r")).select("r.*")


def export(df: DataFrame, uri: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(uri)
