"""From the syntax tree to DataFrames: each relational expression becomes a lazy DataFrame, which Catalyst optimizes as a whole."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F, types as S

from relspark import errors as E
from relspark.lang import tree as T
from relspark.functions.scalar import FLATMAPS
from relspark.operators import folds as fold_ops, sampling
from relspark.operators.band import band_counts
from relspark.operators.durable import bytes_of
from relspark.operators.hypercube import cyclic, multiway_join
from relspark.plans.expressions import Scope, compile_, columns_of, flatmaps, has_aggregate, inline, is_aggregate
from relspark.plans.liveness import reads
from relspark.sources import files
from relspark.sources.catalog import Catalog, Made, Relation, relation, unique
from relspark.types import SPARK, Typed, need, numeric


#: Relations of fewer bytes in all are joined two by two, as Catalyst plans them.
GRID_BYTES, UNKNOWN = 1 << 30, 1 << 60


def plain(df: DataFrame, names, types) -> Relation:
    """A relation of ``df``'s columns by place."""
    return Relation(df.toDF(*[f"c{i}" for i in range(len(types))]), unique(list(names)), tuple(types))


class Analyzer:
    def __init__(self, catalog: Catalog, functions: dict, variables: dict[str, Relation], python: dict | None = None, seed: int | None = None):
        self.catalog, self.functions, self.variables, self.python, self.seed = catalog, functions, variables, python or {}, seed
        self.spark = catalog.spark

    # Relations.

    def rel(self, node) -> Relation:
        """A relational expression as a relation."""
        return self.combined(node) if isinstance(node, T.Rel) else getattr(self, type(node).__name__.lower())(node)

    def defined(self, node) -> Relation:
        """The relation, with its tree: a variable's value."""
        rel = self.rel(node)
        return rel._replace(made=Made(rel.df, node, dict(self.variables), dict(self.catalog.frames)))

    def definition(self, node):
        """The tree that a variable stands for, if it would give the same rows here; else the node."""
        rel = self.variables.get(node.name) if isinstance(node, T.Var) else None
        if rel is None or rel.made is None or rel.made.df is not rel.df or any(isinstance(x, (T.Sample, T.LimitRel)) for x in T.walk(rel.made.node)):
            return node
        frames = self.catalog.frames
        same = all(self.variables.get(n) is rel.made.variables.get(n) for n in reads(rel.made.node)) and len(frames) == len(rel.made.frames) and all(frames.get(k) is df for k, df in rel.made.frames.items())
        return rel.made.node if same else node

    def loose(self, node):
        """A tree with the same rows, each any number of times: what makes rows distinct is left out as far as one relation is all that is read."""
        tree = self.definition(node)
        if isinstance(tree, T.Rel) and tree.op == "distinct":
            return self.loose(tree.args[0])
        if isinstance(tree, T.Rel) and tree.op in ("union", "unionall"):
            return T.Rel("unionall", tuple(map(self.loose, tree.args)))
        if isinstance(tree, T.Bag) and tree.limit is None:
            emitted = [inline(x, self.functions, self.python) for e in tree.emits for x in getattr(e, "exprs", ())]
            if len(tree.sources) == 1 and not any(isinstance(x, (T.Fold, T.Unbox)) or is_aggregate(x) for x in T.walk([*emitted, tree.where])):
                ((alias, source),) = tree.sources
                return replace(tree, sources=((alias, self.loose(T.Var(alias) if source is None else source)),), distinct=False)
            return replace(tree, distinct=False)
        return node

    def var(self, node: T.Var) -> Relation:
        if node.name not in self.variables:
            raise E.NoSuchRelation(node.name)
        return self.variables[node.name]

    def scan(self, node: T.Scan) -> Relation:
        return relation(self.catalog.get(node.key))

    def sample(self, node: T.Sample) -> Relation:
        base = relation(self.catalog.get(node.key))
        return base._replace(df=sampling.exact_sample(base.df, node.size, node.percent, node.kind == "WR", self.seed))

    def load(self, node: T.Load) -> Relation:
        return relation(files.load(self.spark, node.path, node.format, node.schema, dict(node.options)))

    def emptyrel(self, node: T.EmptyRel) -> Relation:
        schema = S.StructType([S.StructField(n, SPARK[t]) for n, t in node.schema])
        return relation(self.spark.createDataFrame([], schema))

    def literal(self, node: T.Literal) -> Relation:
        return self.bag(T.Bag((), None, node.emits, (), None))

    def limitrel(self, node: T.LimitRel) -> Relation:
        r = self.rel(node.arg)
        return r._replace(df=r.df.limit(node.n))

    def joinrel(self, node: T.JoinRel) -> Relation:
        left, right = self.rel(node.left), self.rel(node.right)
        scope, df = self.product({"l": left, "r": right})
        pairs = [(scope(T.Dot("l", a)), scope(T.Dot("r", b))) for a, b in zip(node.left_cols, node.right_cols, strict=True)]
        for a, b in pairs:
            if a.type != b.type and not {a.type, b.type} <= {"LONG", "DOUBLE"}:
                raise E.TypeSafetyError(f"join of {a.type} with {b.type}")
            df = df.filter(a.col == b.col)
        return plain(df, scope.names, [c.type for c in scope.cols])

    def combined(self, node: T.Rel) -> Relation:
        args = [self.rel(a) for a in node.args]
        first = args[0]
        if node.op == "distinct":
            return first._replace(df=first.df.distinct())
        if node.op == "countall":
            return plain(first.df.agg(F.count(F.lit(1))), ("_COLUMN0_",), ("LONG",))
        if node.op == "cross":
            scope, df = self.product({"l": args[0], "r": args[1]})
            return plain(df, scope.names, [c.type for c in scope.cols])
        for other in args[1:]:
            if len(other.types) != len(first.types):
                raise E.SchemaMismatch(f"{node.op}: {len(first.types)} and {len(other.types)} columns")
            if other.types != first.types:
                raise E.SchemaMismatch(f"{node.op}: {first.types} and {other.types}")
        df = first.df
        for other in args[1:]:
            df = df.intersect(other.df) if node.op == "intersect" else df.subtract(other.df) if node.op == "diff" else df.union(other.df)
        return first._replace(df=df.distinct() if node.op == "union" else df)

    # Comprehensions.

    def generated(self, df: DataFrame, scope: Scope, emits) -> tuple[DataFrame, list]:
        """Calls that make rows, wherever they stand in the emitted expressions, become columns of their own, each distinct call one; the rows multiply."""
        made: dict = {}

        def hoist(node):
            nonlocal df
            node = T.rebuild(node, hoist)
            if not (isinstance(node, T.Call) and node.name in FLATMAPS):
                return node
            if node not in made:
                if has_aggregate(node):
                    raise E.NestedAggregate(f"{node.name} of an aggregate")
                column = compile_(node, scope, self.python)
                df = df.withColumn(f"g{len(made)}", column.col)
                scope.cols.append(Typed(F.col(f"g{len(made)}"), column.type))
                made[node] = T.Pos(len(scope.cols) - 1)
            return made[node]

        emits = [(n, hoist(e) if flatmaps(e) else e) for n, e in emits]
        return df, emits

    def product(self, rels: dict[str, Relation], where=None) -> tuple[Scope, DataFrame]:
        """The cross product in order. Equalities in a later filter make it a join, which Catalyst sees to. If ``where`` joins three or more large relations in a cycle, they are joined on a grid."""
        df, cols = None, []
        frames = [r.df.toDF(*[f"t{i}_{j}" for j in range(len(r.names))]) for i, r in enumerate(rels.values())]
        for r, own in zip(rels.values(), frames, strict=True):
            cols += [Typed(F.col(n), t) for n, t in zip(own.columns, r.types, strict=True)]
            df = own if df is None else df.crossJoin(own)
        if df is None:
            df = self.spark.range(1).select()
        scope = Scope(rels, cols)
        grid = self.grid(scope, frames, where) if len(frames) > 2 and where is not None else None
        return scope, df if grid is None else grid

    def grid(self, scope: Scope, frames: list[DataFrame], where) -> DataFrame | None:
        """The frames, joined on all equalities of ``where`` in one round, if these form a cycle and the frames are large; rows that the rest of ``where`` drops are still there."""
        owner = [i for i, f in enumerate(frames) for _ in f.columns]
        root = list(range(len(owner)))

        def find(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        todo = [where]
        while todo:
            node = todo.pop()
            if isinstance(node, T.Op) and node.op == "and":
                todo += node.args
            elif isinstance(node, T.Op) and node.op == "==" and all(isinstance(a, (T.Name, T.Pos, T.Dot)) for a in node.args):
                a, b = (scope.position(x) for x in node.args)
                if scope.cols[a].type == scope.cols[b].type:
                    root[find(b)] = find(a)
        classes = {c for c in map(find, range(len(owner))) if len({owner[x] for x in range(len(owner)) if find(x) == c}) > 1}
        has = [{f"j{c}" for c in classes if any(find(x) == c and owner[x] == i for x in range(len(owner)))} for i in range(len(frames))]
        if not cyclic(has):
            return None
        sizes = [bytes_of(f) for f in frames]
        # A plan whose size nobody knows counts as small.
        if sum(x for x in sizes if x < UNKNOWN) < GRID_BYTES or max(sizes) >= UNKNOWN and GRID_BYTES:
            return None
        # Columns that must be equal travel once.
        keyed, at, out = [], 0, []
        for f in frames:
            first: dict = {}
            for j, c in enumerate(f.columns):
                first.setdefault(find(at + j), c)
            named = {c: f"j{k}" for k, c in first.items() if k in classes}
            for j, c in enumerate(f.columns):
                if c not in named and find(at + j) in classes:
                    f = f.filter(F.col(c) == F.col(first[find(at + j)])).drop(c)
                    named[c] = f"j{find(at + j)}"
            keyed.append(f.select(*[F.col(c).alias(named.get(c, c)) for c in f.columns]))
            out += [F.col(named.get(c, c)).alias(c) for c in frames[len(keyed) - 1].columns]
            at += len(frames[len(keyed) - 1].columns)
        return multiway_join(keyed).select(*out)

    def near(self, scope: Scope, rels: dict[str, Relation], where, emits) -> tuple[DataFrame, list[str]] | None:
        """Numbers of rows of one relation that are near rows of another, counted without pairs: if ``where`` is equalities and one ``abs(a - b) < number``, and columns of one side and COUNT(*) are emitted."""
        (left, right), width = rels.values(), len(next(iter(rels.values())).types)
        column = (T.Name, T.Pos, T.Dot)
        equal, bands, todo = [], [], [where]
        while todo:
            x = todo.pop()
            if not isinstance(x, T.Op) or len(x.args) != 2:
                return None
            a, b = x.args
            if x.op == "and":
                todo += [a, b]
            elif x.op == "==" and isinstance(a, column) and isinstance(b, column):
                equal.append(sorted((scope.position(a), scope.position(b))))
            elif x.op in ("<", "<=") and isinstance(a, T.Call) and a.name == "abs" and isinstance(b, T.Lit) and b.type in ("LONG", "DOUBLE") and isinstance(a.args[0], T.Op) and a.args[0].op == "-" and all(isinstance(c, column) for c in a.args[0].args):
                bands.append((sorted(map(scope.position, a.args[0].args)), float(b.value), x.op == "<="))
            else:
                return None
        if not equal or len(bands) != 1 or any(a >= width or b < width for a, b in [*equal, bands[0][0]]):
            return None
        counts = [i for i, (_, e) in enumerate(emits) if isinstance(e, T.Call) and e.name == "countall"]
        if len(counts) != 1 or not all(i in counts or isinstance(e, column) for i, (_, e) in enumerate(emits)):
            return None
        kept = [scope.position(e) for i, (_, e) in enumerate(emits) if i not in counts]
        second = bool(kept) and all(p >= width for p in kept)
        types = [scope.cols[p].type for p in kept]
        if not kept or not second and any(p >= width for p in kept) or any(scope.cols[p].type != "DOUBLE" for p in bands[0][0]):
            return None
        if any(scope.cols[a].type != scope.cols[b].type or scope.cols[a].type not in ("LONG", "STRING") for a, b in equal):
            return None
        here, there = (right, left) if second else (left, right)
        own, other = lambda pair: f"c{pair[1] - width if second else pair[0]}", lambda pair: f"c{pair[0] if second else pair[1] - width}"
        keys = [f"g{i}" for i in range(len(equal))]
        probes = here.df.select(*[F.col(f"c{p - width if second else p}").alias(f"k{i}") for i, p in enumerate(kept)], *[F.col(own(e)).alias(k) for k, e in zip(keys, equal, strict=True)], F.col(own(bands[0][0])).alias("u"))
        values = there.df.select(*[F.col(other(e)).alias(k) for k, e in zip(keys, equal, strict=True)], F.col(other(bands[0][0])).alias("v"))
        found = band_counts(probes, values, keys, *bands[0][1:]).groupBy(*[f"k{i}" for i in range(len(kept))]).agg(F.sum("n").alias("n"))
        names = [f"k{i}" for i in range(len(kept))]
        names.insert(counts[0], "n")
        types.insert(counts[0], "LONG")
        return found.select(*[F.col(n).alias(f"c{i}") for i, n in enumerate(names)]), types

    def expand(self, emits, rels: dict[str, Relation], scope: Scope) -> list[tuple[str | None, object]]:
        out: list[tuple[str | None, object]] = []
        for e in emits:
            if isinstance(e, T.Star):
                if e.alias is not None and e.alias not in rels:
                    raise E.NoSuchRelation(e.alias)
                for alias in rels if e.alias is None else (e.alias,):
                    out += [(n, T.Dot(alias, n)) for n in rels[alias].names]
                continue
            for raw in e.exprs:
                x = inline(raw, self.functions, self.python)
                xs = x if isinstance(x, tuple) else (x,)
                if e.names and len(e.names) != len(xs):
                    raise E.SchemaMismatch(f"{len(e.names)} names for {len(xs)} columns")
                names = e.names or [None] * len(xs)
                for name, y in zip(names, xs, strict=True):
                    if isinstance(y, T.Call) and y.name == "lexmin":
                        raise E.InvalidStatement("lexmin stands in the head of a recursive rule")
                    out.append((name or scope.source_name(y), y))
        return out

    def bag(self, node: T.Bag) -> Relation:
        aliases = [a for a, _ in node.sources]
        if len(set(aliases)) != len(aliases):
            raise E.DuplicateAlias(str(aliases))
        rels = {a: self.rel(r) if r is not None else self.var(T.Var(a)) for a, r in node.sources}
        scope = Scope(rels, [Typed(F.lit(None), t) for r in rels.values() for t in r.types])
        emits = self.expand(node.emits, rels, scope)
        where = inline(node.where, self.functions, self.python) if node.where is not None else None
        n_own = len(scope.cols)
        for x in T.walk([e for _, e in emits] + [where]):
            if isinstance(x, T.Unbox) and x.relation not in rels:
                rels[x.relation] = self.var(T.Var(x.relation))
        if flatmaps(where):
            raise E.InvalidStatement("split, sequence, ngram and bitset make rows, which a condition can't")
        counted = self.near(scope, rels, where, emits) if where is not None and len(rels) == 2 else None
        scope, df = self.product(rels, where)
        if where is not None and counted is None:
            cond = compile_(where, scope, self.python)
            need("where", cond, "BOOLEAN") if cond.type not in ("LONG", "DOUBLE", "STRING") else None
            df = df.filter(cond.col if cond.type == "BOOLEAN" else cond.col != "" if cond.type == "STRING" else cond.col != 0)
        names = [n for n, _ in emits]
        extra = range(n_own, len(scope.cols))
        df, emits = self.generated(df, scope, emits)
        if counted is not None:
            df, types = counted
        elif any(has_aggregate(e) for _, e in emits):
            df, types = self.grouped(df, scope, emits, extra)
        elif any(isinstance(x, T.Fold) for x in T.walk([e for _, e in emits])):
            df, types = self.stateful(df, scope, emits)
        elif len(rels) == 1 and len(node.emits) == 1 and isinstance(node.emits[0], T.Star):
            types = [c.type for c in scope.cols]
        else:
            cols = [compile_(e, scope, self.python) for _, e in emits]
            df, types = df.select(*[c.col.alias(f"c{i}") for i, c in enumerate(cols)]), [c.type for c in cols]
        names = [n if n is not None and not (n.startswith("_COLUMN") and n.endswith("_")) else f"_COLUMN{i}_" for i, n in enumerate(names)]
        out = plain(df, names, types)
        if node.order:
            own = Scope({"": out}, [Typed(F.col(f"c{i}"), t) for i, t in enumerate(out.types)])
            keys = []
            for c, up in node.order:
                k = own(T.Pos(c) if isinstance(c, int) else T.Name(c)).col
                keys.append(k.asc() if up else k.desc())
            out = out._replace(df=out.df.orderBy(*keys).limit(node.limit))
        return out._replace(df=out.df.distinct()) if node.distinct else out

    def grouped(self, df: DataFrame, scope: Scope, emits, extra) -> tuple[DataFrame, list[str]]:
        """Group by the emitted expressions without aggregates and the unboxed columns; compute each distinct aggregate once."""
        keys: list[Typed] = []
        place: dict[int, int] = {}
        finals: list = []
        for _, e in emits:
            if has_aggregate(e):
                finals.append(e)
                continue
            if isinstance(e, (T.Name, T.Pos, T.Dot, T.Unbox)):
                place[scope.position(e)] = len(keys)
            finals.append(T.Ref(("key", len(keys))))
            keys.append(compile_(e, scope, self.python))
        for at in extra:
            place[at] = len(keys)
            keys.append(scope.cols[at])
        found: dict = {}

        def hoist(node):
            if is_aggregate(node):
                if any(has_aggregate(a) for a in node.args):
                    raise E.NestedAggregate(str(node))
                if isinstance(node, T.Fold):
                    found.setdefault((node.func, node.args), len(found))
                    return T.Ref(("fold", found[node.func, node.args], node.output))
                found.setdefault(node, len(found))
                return T.Ref(("agg", found[node]))
            if isinstance(node, T.Ref):
                return node
            if node in columns_of(node):
                at = scope.position(node)
                if at not in place:
                    raise E.NonGroupedAccess(str(node))
                return T.Ref(("key", place[at]))
            return T.rebuild(node, hoist)

        finals = [hoist(f) for f in finals]
        names = [f"k{i}" for i in range(len(keys))]
        base = df.select("*", *[k.col.alias(n) for k, n in zip(keys, names, strict=True)])
        aggs, results, split = [], {}, []
        for spec, i in found.items():
            if isinstance(spec, tuple):
                func, args = spec[0], [compile_(a, scope, self.python) for a in spec[1]]
                if func.local:
                    split.append((i, func, args))
                    continue
                kinds = fold_ops.state_types(func, args)
                aggs.append(fold_ops.aggregate_column(func, args, kinds).alias(f"a{i}"))
                results[i] = (func, kinds)
            else:
                col = aggregate(spec, [compile_(a, scope, self.python) for a in spec.args])
                aggs.append(col.col.alias(f"a{i}"))
                results[i] = col.type
        out = base.groupBy(*names).agg(*aggs) if aggs else None
        for i, func, args in split:
            part, kinds = fold_ops.two_stage(base, names, func, args, f"a{i}")
            results[i] = (func, kinds)
            if out is None:
                out = part
            elif names:
                other = part.toDF(*[f"o_{c}" for c in names], f"a{i}")
                cond = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in names]
                out = out.join(other, cond).drop(*[f"o_{c}" for c in names])
            else:
                out = out.crossJoin(part)

        def lookup(node) -> Typed:
            kind, i, *which = node.key
            if kind == "key":
                return Typed(F.col(names[i]), keys[i].type)
            if kind == "agg":
                return Typed(F.col(f"a{i}"), results[i])
            func, kinds = results[i]
            return fold_ops.output(func, which[0], F.col(f"a{i}"), kinds)

        cols = [compile_(f, lookup, self.python) for f in finals]
        return out.select(*[c.col.alias(f"c{i}") for i, c in enumerate(cols)]), [c.type for c in cols]

    def stateful(self, df: DataFrame, scope: Scope, emits) -> tuple[DataFrame, list[str]]:
        specs: dict = {}
        for x in T.walk([e for _, e in emits]):
            if isinstance(x, T.Fold):
                specs.setdefault((x.func, x.args), len(specs))
        runs = [(f, [compile_(a, scope, self.python) for a in args]) for f, args in specs]
        out, kinds = fold_ops.running(df, df.columns, runs)

        def resolve(node):
            if isinstance(node, T.Fold):
                return T.Ref((specs[node.func, node.args], node.output))
            return T.rebuild(node, resolve)

        def lookup(node) -> Typed:
            if isinstance(node, T.Ref):
                i, which = node.key
                return fold_ops.output(runs[i][0], which, F.col(f"_f{i}"), kinds[i])
            return scope(node)

        cols = [compile_(resolve(e), lookup, self.python) for _, e in emits]
        return out.select(*[c.col.alias(f"c{i}") for i, c in enumerate(cols)]), [c.type for c in cols]


def aggregate(spec: T.Call, args: list[Typed]) -> Typed:
    """A built-in aggregate. SUM of nothing is 0; STDEV is that of the population, 0 for fewer than two values."""
    name = spec.name
    if name == "countall":
        return Typed(F.count(F.lit(1)), "LONG")
    (a,) = args
    if name == "count":
        return Typed(F.count(a.col), "LONG")
    if name in ("min", "max"):
        return Typed((F.min if name == "min" else F.max)(a.col), a.type)
    numeric(name, a)
    if name == "sum":
        return Typed(F.coalesce(F.sum(a.col), F.lit(0)).cast(SPARK[a.type]), a.type)
    if name == "avg":
        return Typed(F.avg(a.col), "DOUBLE")
    return Typed(F.coalesce(F.stddev_pop(a.col.cast("double")), F.lit(0.0)), "DOUBLE")

