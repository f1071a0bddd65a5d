"""User-defined folds: aggregates over groups, and running states over rows.

A state whose update adds something (``s + x``), or takes the lesser or greater (``least(s, x)``), folds as a native
aggregate or a running window; so does, as an aggregate, the choice of the row with the greatest or least value (``case when v > top then x else best end``,
``top`` being kept likewise). Other folds are a higher-order function over the group's sorted arguments, which stays in
the JVM; its memory is that of one group's arguments. A fold declared with a local and a remote part runs the local one in each
partition, where rows are, and the remote one over these results: only states are shuffled.

Rows have no order of their own: folds go through them in ascending order of the arguments (aggregates) or of all columns (running
states).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relspark import errors as E
from relspark.lang import tree as T
from relspark.operators.durable import bytes_of
from relspark.plans.expressions import compile_
from relspark.types import SPARK, Typed

#: Groups whose states one task holds.
STATES = 100_000
SPREAD_BYTES = 1 << 30
_EXTREMES = {"least": "min", "lesser": "min", "greatest": "max", "greater": "max"}


def state_types(func: T.Stateful, args: list[Typed]) -> list[str]:
    """Types of the states: of their inits, widened from LONG to DOUBLE as far as the updates ask."""
    no_columns = lambda n: (_ for _ in ()).throw(E.UndefinedVariable(str(n)))
    kinds = [compile_(init, no_columns).type for _, init, _ in func.states]
    names = [s[0] for s in func.states]
    while True:
        env = dict(zip(names, [Typed(F.lit(None), k) for k in kinds], strict=True)) | dict(zip(func.args, args, strict=True))
        new = [compile_(update, lambda n: env[n.name]).type for _, _, update in func.states]
        merged = []
        for a, b in zip(kinds, new, strict=True):
            if a != b and {a, b} != {"LONG", "DOUBLE"}:
                raise E.TypeSafetyError(f"{func.name}: state of type {a} updated with {b}")
            merged.append("DOUBLE" if "DOUBLE" in (a, b) else a)
        if merged == kinds:
            return kinds
        kinds = merged


def native(func: T.Stateful) -> list[tuple[str, object]] | None:
    """(sum, min or max; the expression of the arguments) for each state, if all fold that way."""
    names = {s[0] for s in func.states}
    free = lambda n: not any(isinstance(x, T.Name) and x.name in names for x in T.walk(n))
    out = []
    for name, _, update in func.states:
        own = T.Name(name)
        if isinstance(update, T.Op) and update.op == "+" and own in update.args:
            other = update.args[1 - update.args.index(own)]
            kind = "sum"
        elif isinstance(update, T.Call) and update.name.lower() in _EXTREMES and len(update.args) == 2 and own in update.args:
            other = update.args[1 - update.args.index(own)]
            kind = _EXTREMES[update.name.lower()]
        else:
            return None
        if not free(other):
            return None
        out.append((kind, other))
    return out


def picks(func: T.Stateful, args: list[Typed]) -> tuple[int, object, bool, dict] | None:
    """(place of the state that holds the best value so far, its expression, whether greatest is best, the expression that each state takes from the best row), if all states
    follow one comparison ``value > top`` or ``value < top``. None otherwise."""
    names = [s[0] for s in func.states]
    free = lambda n: not any(isinstance(x, T.Name) and x.name in names for x in T.walk(n))
    conditions, taken = set(), {}
    for i, (name, _, update) in enumerate(func.states):
        if not (isinstance(update, T.Case) and len(update.whens) == 1 and update.default == T.Name(name)):
            return None
        ((condition, value),) = update.whens
        conditions.add(condition)
        taken[i] = value
    if len(conditions) != 1 or not all(free(v) for v in taken.values()):
        return None
    (condition,) = conditions
    if not (isinstance(condition, T.Op) and condition.op in ("<", ">")):
        return None
    a, b = condition.args
    for value, top, greatest in ((a, b, condition.op == ">"), (b, a, condition.op == "<")):
        if isinstance(top, T.Name) and top.name in names and free(value) and taken[names.index(top.name)] == value:
            kind = compile_(value, lambda n: dict(zip(func.args, args, strict=True))[n.name]).type
            return (names.index(top.name), value, greatest, taken) if kind in ("LONG", "DOUBLE") else None
    return None


def _picked_states(func: T.Stateful, args: list[Typed], kinds: list[str]) -> Column:
    """The struct of final states of a fold that ``picks``: of the rows with the best value the first in order of the arguments decides, if it beats the initial one."""
    at, value, greatest, taken = picks(func, args)
    env = dict(zip(func.args, args, strict=True))
    go = lambda e: compile_(e, lambda n: env[n.name])
    best = go(value)
    order = best.col
    if greatest:
        # Turned around; not-a-number is the greatest of all.
        order = F.bitwise_not(best.col) if best.type == "LONG" else F.struct(~F.isnan(best.col), -best.col)
    parts = [order.alias("o"), *[a.col.alias(f"a{i}") for i, a in enumerate(args)], *[go(e).col.cast(SPARK[kinds[i]]).alias(f"x{i}") for i, e in taken.items()]]
    first = F.min(F.when(best.col.isNotNull(), F.struct(*parts)))
    start = [compile_(init, lambda n: env[n.name]).col.cast(SPARK[k]) for (_, init, _), k in zip(func.states, kinds, strict=True)]
    wins = F.coalesce(first[f"x{at}"] > start[at] if greatest else first[f"x{at}"] < start[at], F.lit(False))
    return F.struct(*[F.when(wins, first[f"x{i}"]).otherwise(s).alias(f"s{i}") for i, s in enumerate(start)])


def _native_states(func: T.Stateful, args: list[Typed], kinds: list[str], over=None) -> list[Column]:
    env = dict(zip(func.args, args, strict=True))
    cols = []
    for (how, e), (_, init, _), kind in zip(native(func), func.states, kinds, strict=True):
        x = compile_(e, lambda n: env[n.name]).col.cast(SPARK[kind])
        start = compile_(init, lambda n: env[n.name]).col.cast(SPARK[kind])
        total = {"sum": F.sum, "min": F.min, "max": F.max}[how](x)
        total = total.over(over) if over is not None else total
        cols.append(start + F.coalesce(total, F.lit(0).cast(SPARK[kind])) if how == "sum" else (F.least if how == "min" else F.greatest)(start, total))
    return cols


def aggregate_column(func: T.Stateful, args: list[Typed], kinds: list[str]) -> Column:
    """The struct of final states s0, s1, ..."""
    if native(func):
        return F.struct(*[c.alias(f"s{i}") for i, c in enumerate(_native_states(func, args, kinds))])
    if picks(func, args):
        return _picked_states(func, args, kinds)
    rows = F.sort_array(F.collect_list(F.struct(*[a.col.alias(f"a{i}") for i, a in enumerate(args)] or [F.lit(0).alias("a0")])))
    names = [s[0] for s in func.states]

    def states(env: dict, which: int) -> Column:
        return F.struct(*[compile_(s[which], lambda n: env[n.name]).col.cast(SPARK[k]).alias(f"s{i}") for i, (s, k) in enumerate(zip(func.states, kinds, strict=True))])

    def step(acc: Column, row: Column) -> Column:
        env = {n: Typed(acc[f"s{i}"], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}
        return states(env | {n: Typed(row[f"a{i}"], a.type) for i, (n, a) in enumerate(zip(func.args, args, strict=True))}, 2)

    return F.aggregate(rows, states({}, 1), step)


def output(func: T.Stateful, which: int, struct: Column, kinds: list[str]) -> Typed:
    env = {s[0]: Typed(struct[f"s{i}"], k) for i, (s, k) in enumerate(zip(func.states, kinds, strict=True))}
    return compile_(func.outputs[which], lambda n: env[n.name])


def two_stage(df: DataFrame, keys: list[str], func: T.Stateful, args: list[Typed], name: str) -> tuple[DataFrame, list[str]]:
    """(keys and a struct of the remote part's states as ``name``, their types) of a fold declared in two parts."""
    local, remote = func.local, func.remote
    kinds = state_types(local, args)
    if native(local) or picks(local, args):
        parts = df.groupBy(*keys, F.spark_partition_id().alias("_part")).agg(aggregate_column(local, args, kinds).alias("_l"))
    else:
        parts = _by_partition(df, keys, local, args, kinds)
    outs = [output(local, i, F.col("_l"), kinds) for i in range(len(local.outputs))]
    parts = parts.select(*keys, *[o.col.alias(f"_a{i}") for i, o in enumerate(outs)])
    middle = [Typed(F.col(f"_a{i}"), o.type) for i, o in enumerate(outs)]
    kinds = state_types(remote, middle)
    return parts.groupBy(*keys).agg(aggregate_column(remote, middle, kinds).alias(name)), kinds


def _by_partition(df: DataFrame, keys: list[str], func: T.Stateful, args: list[Typed], kinds: list[str]) -> DataFrame:
    """Keys and states (_l) of the fold over each partition's rows, in their order there. At most ``STATES`` groups are held; when there are more, states go out and begin anew, which the remote part undoes."""
    from pyspark.sql import types as S

    from relspark.functions.evaluate import evaluate

    rows = df.select(*keys, *[a.col.alias(f"_a{i}") for i, a in enumerate(args)])
    cores = df.sparkSession.sparkContext.defaultParallelism
    if bytes_of(rows) <= SPREAD_BYTES and 0 < len(rows.inputFiles()) < cores:
        # A small table in fewer files than cores would keep one Python worker busy.
        rows = rows.repartition(cores)
    schema = S.StructType([*rows.select(*keys).schema, S.StructField("_l", S.StructType([S.StructField(f"s{i}", SPARK[k]) for i, k in enumerate(kinds)]))])
    states, params, n_keys, most = func.states, func.args, len(keys), STATES
    cast = [{"DOUBLE": float, "LONG": int}.get(k, lambda x: x) for k in kinds]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        start = tuple(evaluate(init, {}) for _, init, _ in states)
        names = [s[0] for s in states]
        held: dict = {}

        def out():
            rows = [[*k, {f"s{i}": v for i, v in enumerate(s)}] for k, s in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                key = row[:n_keys]
                env = dict(zip(names, held.get(key, start), strict=True)) | dict(zip(params, row[n_keys:], strict=True))
                held[key] = tuple(v if v is None else c(v) for c, v in zip(cast, (evaluate(u, env) for _, _, u in states), strict=True))
            if len(held) > most:
                yield out()
        if held:
            yield out()

    return rows.mapInArrow(run, schema)


def running(df: DataFrame, order: list[str], folds: list[tuple[T.Stateful, list[Typed]]]) -> tuple[DataFrame, list[list[str]]]:
    """``df`` with a struct column _f0, _f1, ... of each fold's states after each row, in ascending order of ``order``.

    Native folds: rows are dealt out in ranges of the order, each range runs its own window, and the totals of the ranges before,
    one row a range, are added. Other folds go through the rows in one Python task, as each state needs the one before.
    """
    kinds = [state_types(f, a) for f, a in folds]
    if all(native(f) for f, _ in folds):
        from relspark.operators.durable import checkpoint

        flat: list[tuple[str, str]] = []  # (column, how)
        cols = []
        for i, ((f, args), ks) in enumerate(zip(folds, kinds, strict=True)):
            env = dict(zip(f.args, args, strict=True))
            for j, ((how, e), k) in enumerate(zip(native(f), ks, strict=True)):
                cols.append(compile_(e, lambda n, env=env: env[n.name]).col.cast(SPARK[k]).alias(f"_x{i}_{j}"))
                flat.append((f"_x{i}_{j}", how))
        ranged = df.select("*", *cols).repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]) if order else df.select("*", *cols).coalesce(1)
        ranged = checkpoint(ranged.withColumn("_range", F.spark_partition_id()))
        f_of = {"sum": F.sum, "min": F.min, "max": F.max}
        totals = ranged.groupBy("_range").agg(*[f_of[h](c).alias(c) for c, h in flat])
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("_range", *[f_of[h](c).over(before).alias(f"_b{c}") for c, h in flat])
        inside = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order] or [F.lit(0)]).rowsBetween(Window.unboundedPreceding, 0)
        rows = ranged.select("*", *[f_of[h](c).over(inside).alias(f"_w{c}") for c, h in flat]).join(F.broadcast(totals), "_range")  # one row a range
        out = []
        no_columns = lambda n: None
        for i, ((f, _), ks) in enumerate(zip(folds, kinds, strict=True)):
            parts = []
            for j, ((how, _), (_, init, _), k) in enumerate(zip(native(f), f.states, ks, strict=True)):
                c, start = f"_x{i}_{j}", compile_(init, no_columns).col.cast(SPARK[k])
                zero = F.lit(0).cast(SPARK[k])
                if how == "sum":
                    col = start + F.coalesce(F.col(f"_b{c}"), zero) + F.coalesce(F.col(f"_w{c}"), zero)
                else:
                    col = (F.least if how == "min" else F.greatest)(start, F.col(f"_b{c}"), F.col(f"_w{c}"))
                parts.append(col.alias(f"s{j}"))
            out.append(F.struct(*parts).alias(f"_f{i}"))
        return rows.select(*df.columns, *out), kinds
    return _one_by_one(df, order, folds, kinds), kinds


def _one_by_one(df: DataFrame, order: list[str], folds, kinds) -> DataFrame:
    from pyspark.sql import types as S

    from relspark.functions.evaluate import evaluate

    schema = S.StructType(list(df.schema.fields))
    args, specs = [], []
    for i, ((f, own), ks) in enumerate(zip(folds, kinds, strict=True)):
        args += [a.col.alias(f"_a{i}_{j}") for j, a in enumerate(own)]
        specs.append((f.states, f.args, ks))
        schema = schema.add(f"_f{i}", S.StructType([S.StructField(f"s{j}", SPARK[k]) for j, k in enumerate(ks)]))
    keep = df.columns

    def run(frames):
        import pandas as pd

        states = [[evaluate(init, {}) for _, init, _ in spec[0]] for spec in specs]
        for pdf in frames:
            out = pdf[keep].copy()
            found = [[] for _ in specs]
            for row in pdf.itertuples(index=False):
                row = dict(zip(pdf.columns, row, strict=True))
                for i, (spec, names, ks) in enumerate(specs):
                    env = {s[0]: v for s, v in zip(spec, states[i], strict=True)} | {n: row[f"_a{i}_{j}"] for j, n in enumerate(names)}
                    states[i] = [(float if k == "DOUBLE" else int if k == "LONG" else lambda x: x)(evaluate(s[2], env)) for s, k in zip(spec, ks, strict=True)]
                    found[i].append({f"s{j}": v for j, v in enumerate(states[i])})
            for i, col in enumerate(found):
                out[f"_f{i}"] = pd.Series(col, dtype=object)
            yield out

    rows = df.select("*", *args).repartition(1).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    return rows.mapInPandas(run, schema)
