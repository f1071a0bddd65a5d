"""Multiway equi-joins in one round: rows are dealt to the cells of a grid with a dimension for each join attribute.

A row's coordinates are hashes of the attributes it has; along the others it is copied. Each result row is made in exactly one cell, so
the relations are joined cell by cell, each cell in a task of its own, and no intermediate result is shuffled, sorted or stored: rows of the first relation run through hash tables of the others.
Spark by default deals both sides of a join anew unless they are dealt by all of its keys, so that setting is turned off in the session; other joins keep their results. The grid's sides are chosen to send the fewest rows
to each cell. For joins whose intermediate results are much larger than inputs and output (triangles on skewed graphs);
otherwise a chain of binary joins, which Catalyst plans, is better.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame, SparkSession, functions as F

from relspark.errors import SchemaMismatch


CELL_ROWS, MOST_CELLS = 1 << 21, 1 << 12


def sides(attributes: list[str], has: list[set[str]], rows: list[int], cells: int) -> dict[str, int]:
    """Side of the grid along each attribute, a power of two: at most ``cells`` cells, the least rows in a cell, then the smallest longest side."""
    best, least = dict.fromkeys(attributes, 1), (float("inf"), 0)
    for powers in _powers(len(attributes), cells.bit_length() - 1):
        side = {a: 1 << p for a, p in zip(attributes, powers, strict=True)}
        cost = (sum(n / prod(side[a] for a in own & set(attributes)) for n, own in zip(rows, has, strict=True)), max(powers, default=0))
        if cost < least:
            best, least = side, cost
    return best


def _powers(places: int, most: int):
    """All tuples of ``places`` exponents whose sum is at most ``most``."""
    if not places:
        yield ()
        return
    for first in range(most + 1):
        for rest in _powers(places - 1, most - first):
            yield (first, *rest)


def cyclic(has: list[set[str]]) -> bool:
    """Whether relations with these attributes form a cycle: leaving out attributes that one relation alone has, and relations within another, again and again, some are left over."""
    left = [set(h) for h in has]
    while True:
        slim = [{a for a in h if sum(a in other for other in left) > 1} for h in left]
        kept = [h for i, h in enumerate(slim) if h and not any(h <= other and (h != other or j < i) for j, other in enumerate(slim) if j != i)]
        if kept == left:
            return bool(kept)
        left = kept


def labels(spark: SparkSession, places: int) -> list[int]:
    """A number for each of ``places`` partitions that Spark's hash sends to it."""
    number, found = 32 * places, {}
    while len(found) < places:
        rows = spark.range(number).select(F.col("id").cast("int").alias("n")).select("n", F.pmod(F.hash("n"), F.lit(places)).alias("p"))
        found = {r.p: r.n for r in rows.groupBy("p").agg(F.min("n").alias("n")).collect()}
        number *= 2
    return [found[p] for p in range(places)]


def multiway_join(frames: list[DataFrame], cells: int = 64, sizes: list[int] | None = None) -> DataFrame:
    """The natural join of ``frames`` on their common column names. ``sizes``: rows or bytes of each, to choose the grid by; by default they are counted. More than ``cells`` cells are made where a relation has more than ``CELL_ROWS`` in one, as a task holds them in memory."""
    has = [set(f.columns) for f in frames]
    if any(len(h) != len(f.columns) for h, f in zip(has, frames, strict=True)):
        raise SchemaMismatch("column names repeat")
    shared = sorted({a for i, h in enumerate(has) for a in h if any(a in other for j, other in enumerate(has) if j != i)})
    rows: dict = {}
    for f in frames if sizes is None else ():
        if f.semanticHash() not in rows:
            rows[f.semanticHash()] = f.count()
    sizes = sizes or [rows[f.semanticHash()] for f in frames]
    side = sides(shared, has, sizes, cells)
    while cells < MOST_CELLS and max(n / prod(side[a] for a in own & set(shared)) for n, own in zip(sizes, has, strict=True)) > CELL_ROWS:
        cells *= 2
        side = sides(shared, has, sizes, cells)
    spark, places = frames[0].sparkSession, prod(side.values())
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    label = F.array(*map(F.lit, labels(spark, places)))
    dealt = []
    for f, own in zip(frames, has, strict=True):
        for a in shared:
            coordinate = F.pmod(F.xxhash64(F.lit(a), F.col(a)), F.lit(side[a])).cast("int") if a in own else F.explode(F.sequence(F.lit(0), F.lit(side[a] - 1)))
            f = f.withColumn(f"_c_{a}", coordinate)
        cell = F.lit(0)
        for a in shared:
            cell = cell * side[a] + F.col(f"_c_{a}")
        dealt.append(f.withColumn("_cell", label[cell]).drop(*[f"_c_{a}" for a in shared]).repartition(places, "_cell"))
    out, known = dealt[0], set(frames[0].columns)
    for f, own in zip(dealt[1:], has[1:], strict=True):
        out = out.join(f.hint("shuffle_hash"), ["_cell", *sorted(known & own)])
        known |= own
    return out.drop("_cell")
