"""Whole graphs at once: connected components and transitive closure of a relation's pairs, for fixpoints whose rounds would follow the longest way or derive each row too often.

Components: pairs are cut down to little more than the nodes first (``spanning``). Then nodes of one pair go with the other end, each node joins the one of least hash among itself and its neighbours, and edges are drawn between what is left, which at least halves a way on average;
once ``LOCAL`` edges are left, one task ends it. Rounds grow with the logarithm of the longest way.

Closure: a component's edges go to tasks, one for each block of its nodes as ends. A task goes through the strongly connected parts, ends first, and keeps a bit for each node and end (``BITS`` at most),
so a pair that is derived in many ways costs a bit's OR each and is a row once. Pairs that are a join's on equal keys, and an order maybe, are never made: a task gets the joined rows. Rows leave in batches; none is shuffled. Components with more than ``NODES`` nodes or ``EDGES`` edges don't fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame, functions as F, types as S

from relspark.operators.durable import stored

LOCAL = 1 << 20
#: Pairs that a task looks at together.
SEEN = 1 << 21
BITS, NODES, EDGES = 1 << 28, 1 << 17, 1 << 24
#: Bits looked at before rows are given out.
CHUNK = 1 << 22


def components(edges: DataFrame, spanned: bool = False) -> DataFrame:
    """(v, c): each node of the pairs (x, y), which hold no null, and the least node connected with it. ``spanned``: the rows are ``spanning``'s."""
    if not spanned:
        edges = spanning(edges)
    left, hooks = edges.filter("x != y"), []
    while (number := left.count()) > LOCAL:
        hook, left = _leaves(left)
        hooks.append(hook)
        if (number := left.count()) <= LOCAL:
            break
        at = F.xxhash64(F.lit(len(hooks)), F.col("x"))
        both = left.unionAll(left.select(F.col("y").alias("x"), F.col("x").alias("y")))
        near = both.groupBy("x").agg(F.min(F.struct(F.xxhash64(F.lit(len(hooks)), F.col("y")).alias("h"), "y")).alias("m"))
        hook = stored(near.select(F.col("x").alias("v"), F.least("m", F.struct(at.alias("h"), F.col("x").alias("y")))["y"].alias("c")))
        hooks.append(hook)
        ends = left.join(hook.toDF("x", "a"), "x").join(hook.toDF("y", "b"), "y").filter("a != b")
        left = spanning(ends.select(F.col("a").alias("x"), F.col("b").alias("y")))
    label = left.repartition(1).mapInArrow(_roots, left.toDF("v", "c").schema) if number else left.toDF("v", "c")
    for hook in reversed(hooks):
        known = label.toDF("c", "top")
        label = hook.join(known, "c", "left").select("v", F.coalesce("top", "c").alias("c"))
    label = stored(label)
    least = label.groupBy("c").agg(F.min("v").alias("low"))
    label = label.join(least, "c").select("v", F.col("low").alias("c"))
    alone = edges.filter("x = y").select(F.col("x").alias("v"), F.col("x").alias("c")).distinct()
    return label.unionAll(alone.join(label.select("v"), "v", "left_anti").select("v", "c"))


def _leaves(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, c): each node of the pairs (x, y), with x if it is y with this x alone and no x, else with itself; and the pairs of the other y, as stored rows."""
    ends = left.groupBy("y").agg(F.min("x").alias("x"), F.max("x").alias("last"))
    starts = left.select(F.col("x").alias("y"), F.lit(True).alias("start")).distinct()
    nodes = stored(ends.join(starts, "y", "full").select(F.col("y").alias("v"), F.when(F.col("start").isNull() & (F.col("x") == F.col("last")), F.col("x")).otherwise(F.col("y")).alias("c")))
    return nodes, stored(left.join(nodes.filter("v = c").select(F.col("v").alias("y")), "y", "left_semi").select("x", "y"))


def spanning(edges: DataFrame) -> DataFrame:
    """Pairs that connect what the pairs (x, y) connect, and hold the same nodes: of what a task sees, each node with the least that it is connected with (itself, if it is alone), before rows are dealt
    by the former and after. They number little more than the nodes, in whatever order pairs come and however often. Pairs that hold a null are there, if not all."""
    found = edges.mapInArrow(_stars, edges.schema).hint("rebalance", "y").mapInArrow(_stars, edges.schema)
    return stored(found)


def _stars(batches: Iterator) -> Iterator:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows > SEEN:
            held = [_star(held)]
            rows = len(held[0])
            if rows > SEEN // 2:
                yield held[0]
                held, rows = [], 0
    if rows:
        yield _star(held)


def _star(held: list):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    x, y = (pa.chunked_array([b.column(i) for b in held]) for i in (0, 1))
    odd = pc.or_(pc.is_null(x), pc.is_null(y))
    xs, ys, values = _codes(x.filter(pc.invert(odd)), y.filter(pc.invert(odd)))
    root = _least(xs, ys, len(values))
    kept = np.flatnonzero((root != np.arange(len(root))) | (np.bincount(root, minlength=len(root)) == 1))
    columns = [pa.chunked_array([values.take(pa.array(at)), c.filter(odd).slice(0, 1).combine_chunks()], c.type).combine_chunks() for c, at in ((x, root[kept]), (y, kept))]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["x", "y"])


def _least(xs, ys, n: int):
    """The least of the nodes 0 to n - 1 that each is connected with."""
    import numpy as np

    root = np.arange(n)
    while len(xs):
        np.minimum.at(root, np.maximum(xs, ys), np.minimum(xs, ys))
        while not np.array_equal(root, up := root[root]):
            root = up
        xs, ys = root[xs], root[ys]
        xs, ys = xs[xs != ys], ys[xs != ys]
    return root


def _roots(batches: Iterator) -> Iterator:
    import pyarrow as pa

    table = pa.Table.from_batches(list(batches))
    xs, ys, values = _codes(pa.chunked_array([*table.column(0).chunks]), pa.chunked_array([*table.column(1).chunks]))
    yield pa.RecordBatch.from_arrays([values, values.take(pa.array(_least(xs, ys, len(values))))], names=["v", "c"])


def _codes(x, y):
    """Places of the values of two columns among their distinct values, and these in order."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    both = pa.chunked_array([*x.chunks, *y.chunks]).combine_chunks()
    coded = (both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    codes = place[coded.indices.to_numpy(zero_copy_only=False)]
    return codes[: len(x)], codes[len(x) :], coded.dictionary.take(pa.array(order))


def closure(pairs: DataFrame) -> DataFrame | None:
    """(x, y): y is reached from x over one pair or more. None if a component is too large for a task. Nulls meet nothing, but pairs that hold one are pairs."""
    pairs = stored(pairs.distinct())
    whole = pairs.filter("x is not null and y is not null")
    label = stored(components(whole))
    size = label.groupBy("c").agg(F.count("*").alias("nodes"))
    size = stored(whole.join(label, whole.x == label.v).groupBy("c").agg(F.count("*").alias("edges")).join(size, "c").withColumn("g", F.monotonically_increasing_id()))
    width = f"greatest(64, cast(64 * ({BITS} div (64 * nodes)) as long))"
    size = size.withColumn("blocks", F.expr(f"cast((nodes + {width} - 1) div {width} as int)"))
    most = size.agg(F.max("nodes"), F.max("edges"), F.sum("blocks")).head()
    if (most[0] or 0) > NODES or (most[1] or 0) > EDGES:
        return None
    home = stored(label.join(size, "c").select("v", "g", "blocks", F.expr(width).alias("width")))
    dealt = whole.join(home, whole.x == home.v).select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "width", "x", "y")
    found = _tasks(dealt, most[2], _closures, pairs.schema)
    odd = pairs.filter("x is null or y is null")
    if odd.isEmpty():
        return found
    # Ways from a null go on, ways to a null end there.
    first, last = odd.filter("y is not null"), odd.filter("x is not null")
    step = found.toDF("y", "z")
    first = first.unionAll(first.join(step, "y").select("x", F.col("z").alias("y"))).distinct()
    ends = last.unionAll(last.join(found.toDF("w", "x"), "x").select(F.col("w").alias("x"), "y")).distinct()
    both = first.toDF("s", "x").join(last, "x").select(F.col("s").alias("x"), "y").unionAll(odd.filter("x is null and y is null")).distinct()
    return found.unionAll(first).unionAll(ends).unionAll(both)


def join_closure(left: DataFrame, right: DataFrame, op: str | None) -> DataFrame | None:
    """The closure of the pairs (v of ``left``, v of ``right``) with equal keys k0, k1, ... and v ``op`` v, without making a pair that is no result: tasks get the rows and go through a node
    for each, which leads to the ends from its place in the key's order on. None if the values that keys connect are too many for a task, or nulls are among those that nothing compares."""
    keys = left.columns[:-1]
    has = " and ".join(f"{k} is not null" for k in keys)
    both = left.select("*", F.lit(True).alias("l"), F.lit(False).alias("r")).unionAll(right.select("*", F.lit(False).alias("l"), F.lit(True).alias("r"))).filter(has)
    members = stored((both.filter("v is not null") if op else both).groupBy(*keys, "v").agg(F.max("l").alias("l"), F.max("r").alias("r")))
    if not op and not members.filter("v is null").isEmpty():
        return None
    hub = stored(members.groupBy(*keys).agg(F.min("v").alias("x")).withColumn("k", F.monotonically_increasing_id()))
    members = stored(members.join(hub, keys).select("k", "x", "v", "l", "r"))
    label = stored(components(members.select("x", F.col("v").alias("y"))))
    size = members.join(label, "v").groupBy("c").agg(F.count("*").alias("rows"), F.countDistinct("v").alias("nodes")).withColumn("g", F.monotonically_increasing_id())
    width = f"greatest(64, cast(64 * ({BITS} div (64 * (nodes + rows))) as long))"
    size = stored(size.withColumn("width", F.expr(width)).withColumn("blocks", F.expr("cast((nodes + width - 1) div width as int)")))
    most = size.agg(F.max("nodes"), F.max("rows"), F.sum("blocks")).head()
    if (most[0] or 0) > NODES or 3 * (most[1] or 0) > EDGES:
        return None
    home = label.join(size, "c").select("v", "g", "blocks", "width")
    dealt = members.join(home, "v").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "width", "k", "v", "l", "r")
    kind = members.schema["v"].dataType
    return _tasks(dealt, most[2], partial(_closures, graph=partial(_ordered, op=op)), S.StructType([S.StructField("x", kind), S.StructField("y", kind)]))


def _tasks(dealt: DataFrame, blocks: int | None, work, schema) -> DataFrame:
    return dealt.repartition(min(4 * (blocks or 1), 2048), "g", "block").sortWithinPartitions("g", "block").mapInArrow(work, schema)


def _pairs(table):
    """The graph of rows (x, y): places of edges' ends, the nodes' values in order, and the number of nodes."""
    xs, ys, values = _codes(table.column(0), table.column(1))
    return xs, ys, values, len(values)


def _ordered(table, op: str | None):
    """The graph of rows (k, v, l, r), as ``_pairs``; nodes past the values only lead on. ``l`` and ``r``: v is a start, an end."""
    import numpy as np

    codes, _, values = _codes(table.column(1), table.column(1).slice(0, 0))
    k, left, right = (table.column(i).to_numpy() for i in (0, 2, 3))
    order = np.lexsort((codes, k))
    k, codes, left, right = k[order], codes[order], left[order], right[order]
    n, m = len(values), len(codes)
    if op is None:
        at = n + np.cumsum(np.append(0, k[1:] != k[:-1]))
        return np.concatenate([codes[left], at[right]]), np.concatenate([at[left], codes[right]]), values, n + m
    at, same = n + np.arange(m), np.flatnonzero(k[1:] == k[:-1])
    # The node at a row leads to the row's own value, if that is an end, and to the node at the next row (that before, for >) of its key.
    here, there = (same, same + 1) if op[0] == "<" else (same + 1, same)
    if len(op) == 2:
        begin, to = codes[left], at[left]
    else:
        begin, to = codes[here[left[here]]], at[there[left[here]]]
    return np.concatenate([begin, at[right], at[here]]), np.concatenate([to, codes[right], at[there]]), values, n + m


def _closures(batches: Iterator, graph=_pairs) -> Iterator:
    """Each group of rows (g, block, width, and what ``graph`` takes) that follow each other: the pairs whose end is in the block."""
    import numpy as np
    import pyarrow as pa

    def reached() -> Iterator:
        return _reached(*graph(pa.Table.from_batches(held)), now[1] * width, width)

    now, held, width = None, [], 0
    for batch in batches:
        if not len(batch):
            continue
        g, block, widths = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (block[1:] != block[:-1])) + 1), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if now != (g[a], block[a]):
                if held:
                    yield from reached()
                now, held, width = (g[a], block[a]), [], int(widths[a])
            held.append(batch.slice(a, b - a).select([*range(3, batch.num_columns)]))
    if held:
        yield from reached()


def _reached(xs, ys, values, nodes: int, low: int, width: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    n, end = len(values), min(low + width, len(values))
    order = np.argsort(xs, kind="stable")
    xs, ys = xs[order], ys[order]
    start = np.searchsorted(xs, np.arange(nodes + 1))
    part = np.full(nodes, -1, dtype=np.int64)
    full = np.zeros((nodes, (end - low + 7) // 8), dtype=np.uint8)
    loops = np.zeros(nodes, dtype=bool)
    for number, members in enumerate(_parts(nodes, start.tolist(), ys.tolist())):
        part[members] = number
        loops[members] = len(members) > 1
        for u in members:
            to = ys[start[u] : start[u + 1]]
            if len(to):
                others = part[to]
                loops[u] |= bool((to == u).any())
                full[number] |= np.bitwise_or.reduce(full[np.unique(others) if len(members) > 1 else others], axis=0)
        for u in members:
            if low <= u < end:
                full[number, (u - low) >> 3] |= 1 << ((u - low) & 7)
    step = max(1, CHUNK // (end - low))
    for a in range(0, n, step):
        some = np.arange(a, min(a + step, n))
        bits = np.unpackbits(full[part[some]], axis=1, count=end - low, bitorder="little")
        own = some[(some >= low) & (some < end) & ~loops[some]]
        bits[own - a, own - low] = 0
        x, y = np.nonzero(bits)
        if len(x):
            yield pa.RecordBatch.from_arrays([values.take(pa.array(x + a)), values.take(pa.array(y + low))], names=["x", "y"])


def _parts(n: int, start: list[int], ys: list[int]) -> Iterator[list[int]]:
    """Strongly connected parts, each after those that it leads to (Tarjan's way, without recursion)."""
    seen, low, done, stack, count = [0] * n, [0] * n, [False] * n, [], 0
    for first in range(n):
        if seen[first]:
            continue
        count += 1
        seen[first] = low[first] = count
        stack.append(first)
        way, at = [first], [start[first]]
        while way:
            u, i = way[-1], at[-1]
            end = start[u + 1]
            while i < end:
                w = ys[i]
                i += 1
                if not seen[w]:
                    break
                if not done[w] and seen[w] < low[u]:
                    low[u] = seen[w]
            else:
                way.pop()
                at.pop()
                if way and low[u] < low[way[-1]]:
                    low[way[-1]] = low[u]
                if low[u] == seen[u]:
                    members = []
                    while not members or members[-1] != u:
                        members.append(stack.pop())
                        done[members[-1]] = True
                    yield members
                continue
            at[-1] = i
            count += 1
            seen[w] = low[w] = count
            stack.append(w)
            way.append(w)
            at.append(start[w])
