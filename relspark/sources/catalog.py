"""Where relations come from and go to: keys user:program:relation to DataFrames."""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from relspark.errors import NoSuchRelation
from relspark.lang.parser import relation_key
from relspark.operators.durable import bytes_of
from relspark.types import type_of, widened


#: A broadcast that a program asks for is done up to this size.
BROADCAST_BYTES = 64 << 20


class Made(NamedTuple):
    """How a variable's rows are made: the tree, and what its names stood for."""

    df: DataFrame
    node: object
    variables: dict
    frames: dict


class Relation(NamedTuple):
    """A bag of rows: columns are told by place; names are the public ones and may repeat in no relation."""

    df: DataFrame  # columns c0, c1, ...
    names: tuple[str, ...]
    types: tuple[str, ...]
    made: Made | None = None  # of these rows only if its ``df`` is this one


def unique(names: list[str]) -> tuple[str, ...]:
    """Later ones of equal names get a 1 appended until they differ from all before."""
    out: list[str] = []
    for n in names:
        while n in out:
            n += "1"
        out.append(n)
    return tuple(out)


def relation(df: DataFrame) -> Relation:
    fields = df.schema.fields
    cols = [widened(F.col(f"`{f.name}`"), f.dataType).alias(f"c{i}") for i, f in enumerate(fields)]
    return Relation(df.select(*cols), unique([f.name for f in fields]), tuple(type_of(f.dataType) for f in fields))


def frame(rel: Relation) -> DataFrame:
    """With the public names."""
    return rel.df.toDF(*rel.names)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if the optimizer's estimate of its size is at most ``most`` bytes; else Spark chooses."""
    return df.hint("broadcast") if bytes_of(df) <= most else df


class Catalog:
    """Registered DataFrames first, then Parquet under ``root`` (``name.parquet`` or u__p__r), then tables of Spark's own catalog."""

    def __init__(self, spark: SparkSession, root: str | None = None, tables: dict[str, DataFrame] | None = None):
        self.spark, self.root = spark, root
        self.frames: dict[str, DataFrame] = {}
        for key, df in (tables or {}).items():
            self.register(key, df)

    def register(self, key: str, df: DataFrame) -> None:
        self.frames[relation_key(key)] = df

    def register_sql(self, key: str, query: str, url: str | None = None, **options) -> None:
        """A relation that is the result of a SQL string: of Spark's own, or, with ``url``, of a database by JDBC, which runs the query."""
        if url is None:
            self.register(key, self.spark.sql(query))
        else:
            self.register(key, self.spark.read.format("jdbc").options(url=url, query=query, **options).load())

    def path(self, key: str) -> str:
        return str(PurePosixPath(key.replace(":", "__")))

    def get(self, key: str) -> DataFrame:
        if key in self.frames:
            return self.frames[key]
        name = key.split(":")[2]
        if self.root:
            for file in (f"{self.root}/{self.path(key)}", f"{self.root}/{name}.parquet"):
                if self._exists(file):
                    return self.spark.read.parquet(file)
        table = self.path(key)
        if self.spark.catalog.tableExists(table):
            return self.spark.table(table)
        raise NoSuchRelation(key)

    def _file_system(self, file: str):
        """(file system, path) of a file name."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(file)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, file: str) -> bool:
        fs, path = self._file_system(file)
        return fs.exists(path)

    def store(self, key: str, df: DataFrame, how: str | None = None, columns: list[str] = ()) -> None:
        """Overwrite a relation; with ``root`` as Parquet there, else as a registered DataFrame. HASH deals rows out by the columns; a relation stored with BROADCAST is hinted where it is read, if it is small."""
        if how == "hash" and columns:
            df = df.repartition(*columns)
        elif how == "round_robin":
            df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
        if self.root:
            path, fresh = f"{self.root}/{self.path(key)}", f"{self.root}/.{self.path(key)}-{uuid.uuid4().hex}"
            # Written aside first: the rows may come from the very relation that is overwritten.
            df.write.parquet(fresh)
            # The old files are moved aside and deleted last, so no step leaves the relation without any.
            fs, place = self._file_system(path)
            aside = self._file_system(f"{fresh}-old")[1]
            if fs.exists(place):
                fs.rename(place, aside)
            fs.rename(self._file_system(fresh)[1], place)
            fs.delete(aside, True)
            df = df.sparkSession.read.schema(df.schema).parquet(path)
        self.register(key, broadcast_if_small(df) if how == "broadcast" else df)
