"""How many rows of a relation lie within a distance of each row of another, without their pairs.

Rows meet where their keys are equal. A key's values are sorted once, each different one with its number of rows, and two binary searches a row find where the band begins and ends, by the condition itself:
a difference of doubles never grows as what is subtracted does, so what the condition holds for is one run of the sorted values, rounding included. The cost is n log n, a key's rows are a task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as S


def band_counts(left: DataFrame, right: DataFrame, keys: list[str], reach: float, closed: bool) -> DataFrame:
    """``left`` with ``n``: rows of ``right`` with equal ``keys`` and ``abs(left.u - right.v) < reach`` (``closed``: <=), where there are any. Nulls and what is not finite are near nothing."""

    def usable(df: DataFrame, value: str) -> DataFrame:
        for k in keys:
            df = df.filter(F.col(k).isNotNull())
        return df.filter(F.abs(value) <= F.lit(1.7976931348623157e308))

    right = usable(right, "v").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    schema = S.StructType([*left.schema.fields, S.StructField("n", S.LongType())])

    def count(near, far):
        import numpy as np
        import pyarrow as pa

        u, v = near.column("u").to_numpy(), far.column("v").to_numpy()
        order = np.argsort(v)
        v, total = v[order], np.concatenate([[0], np.cumsum(far.column("n").to_numpy()[order])])

        def first(holds) -> np.ndarray:
            low, high = np.zeros(len(u), dtype=np.int64), np.full(len(u), len(v), dtype=np.int64)
            while (open_ := low < high).any():
                mid = (low + high) // 2
                yes = holds(u - v[np.minimum(mid, len(v) - 1)])
                high, low = np.where(open_ & yes, mid, high), np.where(open_ & ~yes, mid + 1, low)
            return low

        with np.errstate(over="ignore"):
            begin = first((lambda d: d <= reach) if closed else (lambda d: d < reach)) if len(v) else np.zeros(len(u), dtype=np.int64)
            end = first((lambda d: d < -reach) if closed else (lambda d: d <= -reach)) if len(v) else begin
        n = total[end] - total[begin]
        return near.append_column("n", pa.array(n, pa.int64())).filter(pa.array(n > 0))

    return usable(left, "u").groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(count, schema)
