"""The language's types and their Spark types."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F, types as T

from relspark.errors import TypeSafetyError

SPARK = {"LONG": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "STRING": T.StringType(), "DATETIME": T.TimestampType(), "BLOB": T.BinaryType()}


class Typed(NamedTuple):
    col: Column
    type: str


def type_of(spark_type: T.DataType) -> str:
    """Integers widen to LONG and floats and decimals to DOUBLE; types that the language lacks pass through as OTHER."""
    if isinstance(spark_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "LONG"
    if isinstance(spark_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "DOUBLE"
    for name, own in SPARK.items():
        if spark_type == own:
            return name
    if isinstance(spark_type, (T.StringType, T.CharType, T.VarcharType)):
        return "STRING"
    if isinstance(spark_type, (T.DateType, T.TimestampNTZType)):
        return "DATETIME"
    return "OTHER"


def widened(col: Column, spark_type: T.DataType) -> Column:
    kind = type_of(spark_type)
    return col if kind == "OTHER" or spark_type == SPARK[kind] else col.cast(SPARK[kind])


def literal(value, kind: str) -> Typed:
    return Typed(F.lit(bytearray(value)) if kind == "BLOB" else F.lit(value).cast(SPARK[kind]), kind)


def need(what: str, arg: Typed, *kinds: str) -> None:
    if arg.type not in kinds:
        raise TypeSafetyError(f"{what}: {arg.type} where {' or '.join(kinds)} is needed")


def numeric(what: str, *args: Typed) -> str:
    for a in args:
        need(what, a, "LONG", "DOUBLE")
    return "DOUBLE" if any(a.type == "DOUBLE" for a in args) else "LONG"
