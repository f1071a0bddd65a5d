"""Approximate nearest neighbours by inner product on shifted space-filling curves.

Vectors are first put as points whose distance orders like the inner product: a vector gets one more coordinate, so that all have the
largest norm; a query is scaled to that norm. Each of at most ``CURVES`` curves projects the points on ``DIMS`` random directions among the principal ones (those that hold
``VARIANCE`` of a bounded sample's variance), shifts and cuts them into
cells, and orders them by the cells' Hilbert index. Spark range-partitions and sorts these keys; places on a curve are counted by partition, and
cut into blocks. A query is compared with the vectors of a window of blocks around its own on each curve, in double precision, and
the best of all curves are merged. Products of whole blocks choose the candidates; the scores of those near the cut are computed again, component after component, so a
score depends on its two vectors alone.

The index's fitted figures are the number of curves and the window: for a sample of ``SAMPLE`` queries the true nearest are computed against all rows,
and of the pairs on a fixed ladder that find ``RECALL`` of them the cheapest is taken (comparisons, and rows moved to blocks); it never compares more than everything. Clustered vectors get by with short windows; for vectors without
structure no index avoids most comparisons, and a window grows to most of the table. Every row is indexed. A block is at most ``BLOCK_MOST`` rows in one task;
wider windows take more blocks.

Equal vectors are one class, of which the smallest vec_ids are kept for the answers, so copies neither fill blocks nor hide others. Classes are made by a 64-bit hash and
verified by another; if two vectors collide, the first hash is drawn anew.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or have another length than most take no part, neither do null
vec_ids; rows with the same vec_id are rows like others; ties go to the smaller vec_id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from relspark.llm.common import checkpoint, maybe_broadcast

NEAREST = 20
CURVES = 16
DIMS = 16
SAMPLE = 64
RECALL = 0.94
BLOCK_LEAST, BLOCK_MOST, STEPS = 64, 32_768, 4
#: Comparisons that take as long as moving one row to a block.
MOVE = 25
#: Vectors (those of smallest hash) and bytes of them that principal directions are computed from.
FIT, FIT_BYTES = 20_000, 32 << 20
VARIANCE = 0.9
SPREAD = 3.0
SEED = 5


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of rows of cell coordinates (each below 2**bits), as unsigned 64-bit numbers. Works bit plane by bit plane: undo the curve's excess rotations, take the Gray code, interleave."""
    n, dims = cells.shape
    x = [cells[:, i].astype(np.uint64) for i in range(dims)]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        plane, below = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(dims):
            on = (x[i] & plane) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(n, np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | (((x[i] ^ turn) >> np.uint64(b)) & one)
    return key


class Curves:
    """Projections, shifts and scale of all curves, from a sample of vectors."""

    def __init__(self, vectors: np.ndarray, largest: float, curves: int = CURVES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.largest, dim = largest, vectors.shape[1] + 1
        points = self._points(vectors, False)
        self.middle = points.mean(axis=0)
        value, vector = np.linalg.eigh(np.cov(points.T, bias=True))
        value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
        main = max(min(DIMS, dim), int(np.searchsorted(np.cumsum(value), VARIANCE * value.sum())) + 1)
        self.dims = min(DIMS, dim)
        self.bits = min(16, 64 // self.dims)
        self.axes = [vector[:, :main] @ np.linalg.qr(rng.normal(size=(main, main)))[0][:, : self.dims] for _ in range(curves)]
        self.shift = rng.random((curves, self.dims))
        self.scale = max(np.sqrt(value[:main].mean()) * SPREAD, 1e-300)

    def _points(self, x: np.ndarray, query: bool) -> np.ndarray:
        square = (x * x).sum(axis=1)
        if query:
            return np.column_stack([x * (self.largest / np.sqrt(square))[:, None], np.zeros(len(x))])
        return np.column_stack([x, np.sqrt(np.maximum(self.largest**2 - square, 0))])

    def keys(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Signed keys, a row of them for each vector, a column for each curve."""
        points = self._points(x, query) - self.middle
        cells = 1 << self.bits
        out = np.empty((len(x), len(self.axes)), np.int64)
        for c, axes in enumerate(self.axes):
            at = (points @ axes / self.scale + 1) / 2 * (cells - 1) + self.shift[c]
            key = hilbert(np.clip(np.floor(at), 0, cells - 1).astype(np.int64), self.bits)
            out[:, c] = (key ^ np.uint64(1 << 63)).view(np.int64)
        return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _keyed(curves: Curves, dim: int):
    def run(batches):
        for batch in batches:
            x = matrix(batch.column("embedding"), dim)
            ids = np.asarray(batch.column("cid"))
            asks = np.asarray(batch.column("asks").cast(pa.int8()))
            count = len(curves.axes)
            parts = [(ids, curves.keys(x, False), 0)]
            if asks.any():
                on = asks > 0
                parts.append((ids[on], curves.keys(x[on], True), 1))
            for own, keys, role in parts:
                columns = [pa.array(np.tile(np.arange(count, dtype=np.int32), len(own))), pa.array(keys.ravel()), pa.array(np.repeat(own, count)), pa.array(np.full(len(own) * count, role, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["curve", "key", "cid", "role"])

    return run


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, component after component: they don't depend on what else is computed."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, step: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of the k best of each row of q, ties to smaller ``ids``, in order. Rows of x that a rounding might put below the cut are looked at, too."""
    scores = q @ x.T
    k = min(k, len(x))
    cut = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
    slack = np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max()) * q.shape[1] * 2.0**-50
    row, col = np.nonzero(scores >= (cut - slack)[:, None])
    s = np.concatenate([exact(q[row[i : i + step]], x[col[i : i + step]]) for i in range(0, len(row), step)])
    order = np.lexsort((ids[col], -s, row))
    row, col, s = row[order], col[order], s[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], s[keep]


def _exhaustive(asked: np.ndarray, dim: int, k: int):
    """Best rows of each batch for a bounded sample of queries."""

    def run(batches):
        for batch in batches:
            ids, low = np.asarray(batch.column("cid")), np.asarray(batch.column("low"))
            x = matrix(batch.column("embedding"), dim)
            if len(x):
                row, col, s = best(asked, x, low, k)
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(ids[col]), pa.array(low[col]), pa.array(s)], names=["q", "cid", "low", "score"])

    return run


def _compare(dim: int, k: int):
    def run(key, table):
        role = np.asarray(table.column("role"))
        ids, low = np.asarray(table.column("cid")), np.asarray(table.column("low"))
        x = matrix(table.column("embedding").combine_chunks(), dim)
        on, asked = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        there = x[on]
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for i in range(0, len(asked), 256) if len(on) else ():
            part = asked[i : i + 256]
            row, col, s = best(x[part], there, low[on], k)
            for values, new in zip(out, (ids[part][row], ids[on][col], low[on][col], s), strict=True):
                values.append(new)
        return pa.table(dict(zip(("qid", "cid", "low", "score"), map(np.concatenate, out), strict=True)))

    return run


def ladder(least: int, most: int):
    size = least
    while size < most:
        yield size
        size = max(size + 1, int(size * 1.08))
    yield most


def window(half: int) -> tuple[int, int]:
    """(block length, blocks on either side) of a window that reaches ``half`` places or little more to either side of any place."""
    block = min(max(BLOCK_LEAST, half // STEPS), BLOCK_MOST)
    return block, -(-half // block)


def fit_index(places: dict[int, np.ndarray], asked: dict[int, np.ndarray], truth: list[tuple[int, int]], total: int, recall: float, every: int) -> tuple[int, int, float, float]:
    """(curves, half window, rows compared by a query, recall): the cheapest choice for which windows on the first curves hold the true neighbours of the sample's
    queries, ``recall`` of them. It costs what a query is compared with, and the moves of its copies and of ``every`` rows to the blocks of each curve. ``total``: rows on
    a curve; a window over all of them is among the choices, so no more are compared."""
    q = np.array([asked[a] for a, _ in truth])
    x = np.array([places[b] for _, b in truth])
    own = np.array(list(asked.values()))
    found, least = (1, total, float(total), 1.0), np.inf
    curves, most = 1, q.shape[1]
    while True:
        for half in [*ladder(BLOCK_LEAST, max(total, BLOCK_LEAST)), 2 * total]:
            block, reach = window(half)
            first = np.maximum(own[:, :curves] // block - reach, 0) * block
            compared = float((np.minimum((own[:, :curves] // block + reach + 1) * block, total) - first).sum(axis=1).mean())
            cost = compared + MOVE * curves * (every + min(2 * reach + 1, total // block + 1))
            if compared > total or cost >= least:
                break
            got = float((np.abs(q[:, :curves] // block - x[:, :curves] // block) <= reach).any(axis=1).mean())
            if got >= recall:
                found, least = (curves, half, compared, got), cost
                break
        if curves == most:
            return found
        curves = min(2 * curves, most)


def classes_of(vectors: DataFrame, asks, keep: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(cid, embedding, asks: whether a member is a query, low: the smallest vec_id; cid, vec_id of the ``keep`` smallest members of each class; query_id, qid)."""
    e = F.col("embedding")
    fit = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & fit)
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return None
    rows = rows.filter(F.size("embedding") == length[0])
    for seed in range(100):
        named = rows.withColumn("cid", F.xxhash64(F.lit(seed), "embedding"))
        second = F.xxhash64(F.lit(-1 - seed), "embedding")
        classes = checkpoint(named.groupBy("cid").agg(F.first("embedding").alias("embedding"), F.max(asks(F.col("vec_id"))).alias("asks"), F.min("vec_id").alias("low"), F.min(second).alias("_a"), F.max(second).alias("_b")))
        if classes.filter("_a != _b").isEmpty():
            break
    salted = Window.partitionBy("cid", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    members = named.select("cid", "vec_id").withColumn("_r", F.row_number().over(salted)).filter(F.col("_r") <= keep)
    members = members.withColumn("_r", F.row_number().over(Window.partitionBy("cid").orderBy("vec_id"))).filter(F.col("_r") <= keep).drop("_r")
    return classes.drop("_a", "_b"), checkpoint(members), named.filter(asks(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid"))


def nearest(vectors: DataFrame, *, k: int = NEAREST, every: int = 20, curves: int = CURVES, recall: float = RECALL, sample: int = SAMPLE, report: dict | None = None) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: query_id, rank (from 1), vec_id, score of its ``k`` nearest others found.

    ``report`` gets the fitted figures: rows (on a curve), curves, block, reach, and of the sample's queries the mean of places compared and the recall.
    """
    spark = vectors.sparkSession
    asks = lambda c: F.pmod(c, F.lit(every)) == 0
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = classes_of(vectors, asks, k + 1)
    if found is None:
        return empty
    classes, members, queries = found
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
    stats = classes.agg(F.max(norm), F.max(F.size("embedding"))).first()
    dim = stats[1]
    drawn = classes.select("cid", "embedding").orderBy(F.xxhash64(F.lit(4), "cid"), "cid").limit(max(2, min(FIT, FIT_BYTES // (8 * dim)))).toArrow()
    shape = Curves(matrix(drawn.column("embedding").combine_chunks(), dim)[np.argsort(np.asarray(drawn.column("cid").combine_chunks()))], float(np.sqrt(stats[0])), curves)
    keyed = classes.mapInArrow(_keyed(shape, dim), "curve int, key long, cid long, role int")
    placed = checkpoint(keyed.repartitionByRange("curve", "key", "cid", "role").sortWithinPartitions("curve", "key", "cid", "role").withColumn("_id", F.monotonically_increasing_id()))
    part, inside = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_p")).count()
    starts = sizes.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    rows_on_curve = placed.filter("curve = 0").count()
    place = F.col("_start") + inside - F.col("curve") * F.lit(rows_on_curve)
    placed = checkpoint(placed.withColumn("_p", part).join(maybe_broadcast(starts), "_p").select("curve", "cid", "role", place.alias("place")))
    # Fit the index on a bounded sample of queries.
    drawn = classes.filter("asks").orderBy(F.xxhash64(F.lit(3), "cid"), "cid").limit(sample).select("cid", "embedding").collect()
    if not drawn:
        return empty
    asked = np.array([r.embedding for r in drawn], np.float64)
    true = classes.mapInArrow(_exhaustive(asked, dim, k + 1), "q int, cid long, low long, score double")
    true = true.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "low", "cid"))).filter(F.col("_r") <= k + 1).select("q", "cid").collect()
    wanted = spark.createDataFrame([(int(c),) for c in {r.cid for r in true} | {r.cid for r in drawn}], "cid long")
    at = placed.join(F.broadcast(wanted), "cid").collect()
    places, own = {}, {}
    for r in at:
        (places if r.role == 0 else own).setdefault(r.cid, np.zeros(curves, np.int64))[r.curve] = r.place
    truth = [(drawn[r.q].cid, r.cid) for r in true if drawn[r.q].cid != r.cid]
    used, half, compared, got = fit_index(places, own, truth, rows_on_curve, recall, every) if truth else (1, rows_on_curve, rows_on_curve, 1.0)
    block, reach = window(half)
    if report is not None:
        report |= {"rows": rows_on_curve, "curves": used, "block": block, "reach": reach, "compared": round(compared), "recall": got}
    number = F.floor(F.col("place") / F.lit(block)).cast("int")
    placed = placed.filter(F.col("curve") < used)
    here = placed.filter("role = 0").select("curve", number.alias("block"), "cid", "role")
    there = placed.filter("role = 1").select("curve", F.explode(F.sequence(F.greatest(number - reach, F.lit(0)), F.least(number + reach, F.lit(rows_on_curve // block)))).alias("block"), "cid", "role")
    pairs = here.union(there).join(classes.select("cid", "low", "embedding"), "cid")
    hits = pairs.groupBy("curve", "block").applyInArrow(_compare(dim, k + 1), "qid long, cid long, low long, score double").distinct()
    nearest_classes = Window.partitionBy("qid").orderBy(F.desc("score"), "low", "cid")
    hits = hits.withColumn("_r", F.row_number().over(nearest_classes)).filter(F.col("_r") <= k + 1).select("qid", "cid", "score")
    out = queries.join(hits, "qid").join(members, "cid").filter("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
