"""Least fixpoints of recursive relations, by rounds over DataFrames.

A head without aggregates keeps distinct rows: each round derives from the newest rows alone where a branch reads one recursive relation
once, so known rows are not derived again. A head with MIN or LEXMIN keeps the least values of each key; old and new values meet in one aggregation, which also tells
what changed. A head with COUNT(*) counts what the current state derives. Rounds end when no relation changes.

What a round adds is written to the shared folder, and so is, once, what the rounds read but don't change. A distinct relation is the union of what its rounds added, written as one only
every ``MERGE`` rounds, so known rows are not written again each time.

Two forms need no rounds (``graphs``): the transitive closure of a relation's pairs, and the least node connected with each, if the pairs go both ways.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, functions as F

from relspark import errors as E
from relspark.lang import tree as T
from relspark.operators import graphs
from relspark.operators.durable import costly, stored
from relspark.plans import liveness
from relspark.plans.analyzer import Analyzer, plain
from relspark.plans.expressions import Scope, inline
from relspark.sources.catalog import Relation
from relspark.types import Typed

ROUNDS = 10_000
MERGE = 10
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def branches(rel) -> list:
    return [b for a in rel.args for b in branches(a)] if isinstance(rel, T.Rel) and rel.op == "unionall" else [rel]


def reads(rel, names) -> list[str]:
    found = []
    for x in T.walk(rel):
        if isinstance(x, T.Var) and x.name in names:
            found.append(x.name)
        if isinstance(x, T.Bag):
            found += [a for a, r in x.sources if r is None and a in names]
        if isinstance(x, T.Unbox) and x.relation in names:
            found.append(x.relation)
    return found


class Head:
    """What a rule's emit list keeps: keys, and at most one aggregate after or between them."""

    def __init__(self, emits, types: list[str] | None = None):
        self.emits = [x for e in emits for x in e.exprs]
        self.names = [e.names[0] if e.names else None for e in emits]
        found = [(i, e) for i, e in enumerate(self.emits) if isinstance(e, T.Call) and e.name.lower() in ("min", "lexmin", "countall", "count", "max", "sum", "avg")]
        if len(found) > 1 or any(e.name.lower() not in ("min", "lexmin", "countall") for _, e in found):
            raise E.InvalidStatement("a recursive head takes one MIN, LEXMIN or COUNT(*)")
        self.at, self.agg = found[0] if found else (None, None)
        self.kind = self.agg.name.lower() if self.agg else "distinct"

    def columns(self, rel: Relation) -> tuple[list[int], list[int]]:
        """Places in ``rel`` of the keys and of the values compared."""
        def at(e) -> int:
            if isinstance(e, T.Pos):
                if e.index >= len(rel.names):
                    raise E.ColumnIndexOutOfBounds(f"${e.index}")
                return e.index
            field = e.field if isinstance(e, T.Dot) else e.name if isinstance(e, T.Name) else None
            if isinstance(field, int):
                return field
            if field not in rel.names:
                raise E.UndefinedVariable(str(e))
            return rel.names.index(field)

        keys = [at(e) for i, e in enumerate(self.emits) if i != self.at]
        return keys, [at(a) for a in self.agg.args] if self.agg and self.agg.args else []

    def keep(self, rel: Relation) -> tuple[DataFrame, list[str], list[str]]:
        """Rows of ``rel`` as the head keeps them; names and types."""
        keys, values = self.columns(rel)
        k = [f"c{i}" for i in keys]
        place = len(k) if self.at is None else self.at
        names = [self.names[i] or (rel.names[x] if not rel.names[x].startswith("_COLUMN") else f"_COLUMN{i}_") for i, x in zip([j for j in range(len(self.emits)) if j != self.at], keys, strict=True)]
        types = [rel.types[i] for i in keys]
        rows = rel.df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(k)], *[F.col(f"c{v}").alias(f"v{i}") for i, v in enumerate(values)])
        own = [f"k{i}" for i in range(len(k))]
        if self.kind == "distinct":
            return rows.distinct(), names, types
        if self.kind == "countall":
            out = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
            got, kinds, labels = ["n"], ["LONG"], [self.names[self.at] or f"_COLUMN{self.at}_"]
        else:
            out = rows.groupBy(*own).agg(F.min(F.struct(*[f"v{i}" for i in range(len(values))])).alias("m")).select(*own, "m.*")
            got, kinds = [f"v{i}" for i in range(len(values))], [rel.types[v] for v in values]
            labels = [self.names[self.at] if i == 0 and self.names[self.at] else rel.names[v] for i, v in enumerate(values)]
        out = out.select(*own[:place], *got, *own[place:])
        return out, [*names[:place], *labels, *names[place:]], [*types[:place], *kinds, *types[place:]]


def solve(analyzer: Analyzer, rules: tuple[T.Rule, ...], rounds: int = ROUNDS) -> dict[str, Relation]:
    """The least fixpoint of mutually recursive rules: name -> relation."""
    names = [r.name for r in rules]
    if len(set(names)) != len(names):
        raise E.DuplicateVariable(str(names))
    heads = {r.name: Head(r.emits) for r in rules}
    parts = {r.name: branches(r.rel) for r in rules}
    state: dict[str, Relation] = {}

    fixed: dict[str, Relation] = {}

    def inner(variables: dict[str, Relation]) -> Analyzer:
        return Analyzer(analyzer.catalog, analyzer.functions, analyzer.variables | fixed | variables, analyzer.python, analyzer.seed)

    def analyze(rel, variables: dict[str, Relation]) -> Relation:
        return inner(variables).rel(rel)

    def kept(name: str, rows: Relation) -> Relation:
        return plain(*heads[name].keep(rows))

    # Rows that need no recursive relation; then schemas of those that have none such, as others become known.
    for r in rules:
        first = [analyze(b, {}) for b in parts[r.name] if not reads(b, names)]
        if first:
            state[r.name] = kept(r.name, first[0]._replace(df=_union(first)))
    while len(state) < len(rules):
        before = len(state)
        for r in rules:
            if r.name not in state:
                ready = [b for b in parts[r.name] if set(reads(b, names)) <= set(state)]
                if ready:
                    shape = kept(r.name, analyze(ready[0], state))
                    state[r.name] = shape._replace(df=shape.df.limit(0))
        if len(state) == before:
            raise E.InvalidStatement("a recursive relation has no branch to begin with")
    if len(rules) == 1 and (whole := direct(inner(state), rules[0], heads[names[0]], parts[names[0]])) is not None:
        return {names[0]: state[names[0]]._replace(df=whole)}
    repeated = [b for r in rules for b in parts[r.name] if reads(b, names) or heads[r.name].kind == "countall"]
    for name in set().union(*map(liveness.reads, repeated)) - set(names):
        if name in analyzer.variables and costly(analyzer.variables[name].df):
            fixed[name] = analyzer.variables[name]._replace(df=stored(analyzer.variables[name].df))
    state = {n: r._replace(df=stored(r.df)) for n, r in state.items()}
    fresh = dict(state)
    for number in range(1, rounds + 1):
        new, changed = {}, False
        for r in rules:
            head, own = heads[r.name], state[r.name]
            found = []
            for b in parts[r.name]:
                used = reads(b, names)
                if not used:
                    if head.kind == "countall":
                        found.append(analyze(b, state))
                elif len(used) == 1 and head.kind != "countall":
                    found.append(analyze(b, state | {used[0]: fresh[used[0]]}))
                else:
                    found.append(analyze(b, state))
            if not found:
                new[r.name] = (own, own.df.limit(0))
                continue
            got = kept(r.name, found[0]._replace(df=_union(found)))
            if got.types != own.types:
                raise E.SchemaMismatch(f"{r.name}: {own.types} and {got.types}")
            if head.kind == "distinct":
                delta = stored(got.df.subtract(own.df))
                total = own.df.union(delta)
                if number % MERGE == 0:
                    total = stored(total)
            elif head.kind == "countall":
                total = stored(got.df)
                delta = stored(total.subtract(own.df).union(own.df.subtract(total)))
            else:
                values = [f"c{i}" for i in range(head.at, head.at + len(head.agg.args))]
                keys = [c for c in own.df.columns if c not in values]
                both = own.df.withColumn("old", F.struct(*values)).unionByName(got.df.withColumn("old", F.lit(None)), allowMissingColumns=True)
                best = both.groupBy(*keys).agg(F.min(F.struct(*values)).alias("m"), F.min("old").alias("old"))
                best = stored(best.select(*keys, "m.*", (~F.col("m").eqNullSafe(F.col("old"))).alias("fresh")))
                total, delta = best.select(*own.df.columns), best.filter("fresh").select(*own.df.columns)
            new[r.name] = (own._replace(df=total), delta)
        for name, (rel, delta) in new.items():
            any_new = not delta.isEmpty()
            changed |= any_new
            state[name] = rel if any_new else state[name]
            fresh[name] = rel._replace(df=delta)
        if not changed:
            return state
    raise E.InvalidStatement(f"no fixpoint after {rounds} rounds")


def direct(analyzer: Analyzer, rule: T.Rule, head: Head, parts: list) -> DataFrame | None:
    """The fixpoint without rounds, if the rule has one of the forms (P: the head, E: any relation's two columns):

    P(x, y) from E(x, y), and from P(x, y), E(y, z) or E(x, y), P(y, z) or P(x, y), P(y, z): the closure of E;
    P(v, min(c)) from E(x, _) as x, x, and from P(v, c), E(v, y) as y, c, where E holds each pair both ways: components.
    """
    me, base, again = T.Var(rule.name), [b for b in parts if not reads(b, [rule.name])], [b for b in parts if reads(b, [rule.name])]
    if head.kind not in ("distinct", "min") or len(head.emits) != 2 or len(base) != 1 or len(again) != 1:
        return None
    (base,), (again,) = base, again
    if not isinstance(again, T.Bag) or len(again.sources) != 2 or again.limit is not None:
        return None
    where = inline(again.where, analyzer.functions, analyzer.python) if again.where is not None else None
    rels, scope, to = _columns(analyzer, again)
    source, first = _plain(analyzer, base)
    if to is None or first is None or not (isinstance(where, T.Op) and where.op == "==" and all(isinstance(a, (T.Name, T.Pos, T.Dot)) for a in where.args)):
        return None
    met = {scope.position(a) for a in where.args}
    at = list(scope.offset.values())
    own = [i for i, (_, r) in enumerate(rels) if r == me]
    if len(own) != len(reads(again, [rule.name])):
        return None
    (ka, va), (kb, vb) = head.columns(analyzer.rel(base)), head.columns(analyzer.rel(again))
    begin, to = [first[i] for i in ka + va], [to[i] for i in kb + vb]
    pairs = None
    if len(own) == 2 and head.kind == "distinct":
        for p, q in (at, at[::-1]):
            if met == {p + 1, q} and to == [p, q + 1]:
                pairs = begin
    elif len(own) == 1 and len(begin) == len(to) == 2 and rels[1 - own[0]][1] == source:
        p, e, width = at[own[0]], at[1 - own[0]], len(analyzer.rel(source).types)
        for j in range(e, e + width):
            for i in range(e, e + width):
                if head.kind == "distinct" and begin == [i - e, j - e] and (met == {p + 1, i} and to == [p, j] or met == {p, j} and to == [i, p + 1]):
                    pairs = begin
                if head.kind == "min" and begin == [i - e, i - e] and met == {p + 1 - head.at, i} and to == [j, p + head.at]:
                    pairs = [i - e, j - e]
    if pairs is None:
        return None
    rel = analyzer.rel(source)
    if rel.types[pairs[0]] != rel.types[pairs[1]] or rel.types[pairs[0]] not in ("LONG", "STRING"):
        return None
    df = rel.df.select(F.col(f"c{pairs[0]}").alias("x"), F.col(f"c{pairs[1]}").alias("y"))
    if head.kind == "distinct":
        sides = _sides(analyzer, analyzer.definition(source), pairs)
        found = graphs.join_closure(*sides) if sides is not None else None
        found = graphs.closure(df) if found is None else found
        return None if found is None else found.toDF("c0", "c1")
    half = _half(analyzer, analyzer.definition(source))
    if half is not None and sorted(pairs) == [0, 1]:
        once = graphs.spanning(analyzer.rel(analyzer.loose(half)).df.toDF("x", "y"))
        if not once.filter("x is null or y is null").isEmpty():
            return None
        found = graphs.components(once, spanned=True).toDF("c0", "c1")
        return found if head.at else found.select(F.col("c1").alias("c0"), F.col("c0").alias("c1"))
    low, high = F.least("x", "y"), F.greatest("x", "y")
    once = stored(df.groupBy(low.alias("x"), high.alias("y")).agg(F.max(F.col("x") <= F.col("y")).alias("up"), F.max(F.col("x") >= F.col("y")).alias("down"), F.max(F.col("x").isNull() | F.col("y").isNull()).alias("odd")))
    if not once.filter("odd or not up or not down").isEmpty():
        return None
    found = graphs.components(once.select("x", "y")).toDF("c0", "c1")
    return found if head.at else found.select(F.col("c1").alias("c0"), F.col("c0").alias("c1"))


def _half(analyzer: Analyzer, tree):
    """One of the trees if ``tree`` is two united, of which the other is this one's two columns turned."""
    if not isinstance(tree, T.Rel) or tree.op not in ("union", "unionall") or len(tree.args) != 2:
        return None
    for one, other in (tree.args, tree.args[::-1]):
        if len(analyzer.rel(one).types) == 2 and isinstance(other, T.Bag) and _plain(analyzer, other) == (one, [1, 0]):
            return one
    return None


def _sides(analyzer: Analyzer, bag, pairs: list[int]) -> tuple[DataFrame, DataFrame, str | None] | None:
    """If the bag's columns ``pairs`` come from the two sides of a join on equal columns, with at most a comparison of these two besides:
    keys k0, k1, ... and the column v of each side, and how v of the first compares with that of the second."""
    if not isinstance(bag, T.Bag) or len(bag.sources) != 2 or bag.where is None or bag.limit is not None:
        return None
    sources, scope, places = _columns(analyzer, bag)
    if places is None:
        return None
    rels = [analyzer.rel(r) for _, r in sources]
    width = len(rels[0].types)
    x, y = (places[p] for p in pairs)
    keys, op, todo = [], None, [inline(bag.where, analyzer.functions, analyzer.python)]
    while todo:
        node = todo.pop()
        if not isinstance(node, T.Op) or len(node.args) != 2:
            return None
        if node.op == "and":
            todo += node.args
            continue
        if not all(isinstance(a, (T.Name, T.Pos, T.Dot)) for a in node.args):
            return None
        a, b = (scope.position(c) for c in node.args)
        if node.op == "==" and (a < width) != (b < width) and scope.cols[a].type == scope.cols[b].type and scope.cols[a].type in ("LONG", "STRING"):
            keys.append((min(a, b), max(a, b)))
        elif node.op in _TURNED and op is None and {a, b} == {x, y}:
            op = node.op if a == x else _TURNED[node.op]
        else:
            return None
    if not keys or (x < width) == (y < width):
        return None

    def side(at: int) -> DataFrame:
        second = at >= width
        cols = rels[second].df.columns
        return rels[second].df.select(*[F.col(cols[k[second] - second * width]).alias(f"k{i}") for i, k in enumerate(keys)], F.col(cols[at - second * width]).alias("v"))

    return side(x), side(y), op


def _columns(analyzer: Analyzer, bag: T.Bag):
    """Sources of a comprehension, its scope, and the places of the columns that it emits; None for these if it emits anything else."""
    sources = [(a, T.Var(a) if r is None else r) for a, r in bag.sources]
    rels = {a: analyzer.rel(r) for a, r in sources}
    scope = Scope(rels, [Typed(F.lit(None), t) for r in rels.values() for t in r.types])
    emitted = [inline(x, analyzer.functions, analyzer.python) for e in bag.emits for x in getattr(e, "exprs", (None,))]
    plain_ones = all(isinstance(x, (T.Name, T.Pos, T.Dot)) for x in emitted)
    return sources, scope, [scope.position(x) for x in emitted] if plain_ones else None


def _plain(analyzer: Analyzer, branch):
    """A relation and the places of its columns that the branch emits."""
    if not isinstance(branch, T.Bag):
        return branch, list(range(len(analyzer.rel(branch).types)))
    if len(branch.sources) != 1 or branch.where is not None or branch.limit is not None:
        return branch, None
    ((_, source),), _, places = _columns(analyzer, branch)
    return source, places


def _union(rels: list[Relation]) -> DataFrame:
    df = rels[0].df
    for r in rels[1:]:
        if r.types != rels[0].types:
            raise E.SchemaMismatch(f"{rels[0].types} and {r.types}")
        df = df.union(r.df)
    return df


__all__ = ["Head", "branches", "direct", "reads", "solve"]
