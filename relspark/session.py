"""Running programs: statements in order, loops on the driver, everything else lazily."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relspark import errors as E
from relspark.lang import tree as T
from relspark.lang.parser import parse, relation_key
from relspark.operators.durable import costly, stored
from relspark.operators.fixpoint import solve
from relspark.plans.analyzer import Analyzer
from relspark.plans.liveness import Unread, live, reads
from relspark.sources import files
from relspark.sources.catalog import Catalog, Relation, frame


class Session:
    """``run`` executes a program against a catalog and returns what it stored; ``query`` returns one relation."""

    def __init__(self, spark: SparkSession, catalog: Catalog | dict | None = None, root: str | None = None, seed: int | None = None):
        self.spark = spark
        self.catalog = catalog if isinstance(catalog, Catalog) else Catalog(spark, root, catalog)
        self.seed = seed
        self.expressions: dict = {}
        self.python: dict = {}
        self.stored: dict[str, DataFrame] = {}
        self.printed: list[str] = []

    def register_function(self, name: str, f, return_type: str) -> None:
        """A Python function for programs: a plain one runs row by row, one made by pandas_udf in batches."""
        from pyspark.sql import functions as F

        from relspark.types import SPARK

        self.python[name] = (f if hasattr(f, "returnType") else F.udf(f, SPARK[return_type]), return_type)

    def register_expression(self, name: str, f, arity_names: tuple[str, ...]) -> None:
        """A Python lambda or function of records' fields, converted to an expression."""
        from relspark.pyexpr import convert

        self.expressions[name] = T.Function(tuple(arity_names), (convert(f, scalars=True),))

    def run(self, text: str) -> dict[str, DataFrame]:
        statements, functions = parse(text)
        if not statements:
            raise E.InvalidStatement("an empty program")
        functions = self.expressions | functions
        statements, _ = live(statements, set())
        self.variables: dict[str, Relation] = {}
        for s in statements:
            self.statement(s, functions)
        return self.stored

    def query(self, text: str, name: str) -> DataFrame:
        """The variable ``name`` after a program, or a single relational expression if ``text`` is one."""
        statements, functions = parse(text)
        functions = self.expressions | functions
        statements, _ = live(statements, {name})
        self.variables = {}
        for s in statements:
            self.statement(s, functions)
        if name not in self.variables:
            raise E.NoSuchRelation(name)
        return frame(self.variables[name])

    def explain(self, text: str, name: str) -> str:
        df = self.query(text, name)
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def analyzer(self, functions: dict) -> Analyzer:
        return Analyzer(self.catalog, functions, self.variables, self.python, self.seed)

    def statement(self, s, functions: dict) -> None:
        if isinstance(s, T.Assign):
            self.assign(s.name, self.analyzer(functions).defined(s.rel))
        elif isinstance(s, Unread):
            if reads(s.assign.rel) <= set(self.variables):
                self.assign(s.assign.name, self.analyzer(functions).rel(s.assign.rel))
        elif isinstance(s, T.DoWhile):
            self.do_while(s, functions)
        elif isinstance(s, T.Until):
            self.variables |= solve(self.analyzer(functions), s.rules)
        else:
            if s.name not in self.variables:
                raise E.NoSuchRelation(s.name)
            rel = self.variables[s.name]
            df = frame(rel)
            if isinstance(s, T.Store):
                columns = [rel.names[c] if isinstance(c, int) else c for c in s.columns]
                self.catalog.store(s.key, df, s.how, columns)
                self.stored[s.key] = self.catalog.frames[relation_key(s.key)]
            elif s.kind == "sink":
                df.write.format("noop").mode("overwrite").save()
            elif s.kind == "dump":
                self.printed.append(df._jdf.showString(1000, 100, False))
                print(self.printed[-1])
            else:
                files.export(df, s.uri or s.name)

    def assign(self, name: str, rel: Relation) -> None:
        old = self.variables.get(name)
        if old and len(old.types) != len(rel.types):
            raise E.SchemaMismatch(f"{name}: {len(old.types)} columns before, {len(rel.types)} now")
        self.variables[name] = rel

    def do_while(self, s: T.DoWhile, functions: dict) -> None:
        """The body runs at least once. Each round's results go to the shared folder, which keeps plans short and lost executors cheap: at once, so that what follows in the round
        reads them there. What the loop reads but never writes is computed and written once, before it."""
        carried = {a.name for a in s.body}
        used = _needed_after(s, carried)
        last = {a.name: i for i, a in enumerate(s.body)}

        def keep(name: str) -> None:
            self.variables[name] = self.variables[name]._replace(df=stored(self.variables[name].df))

        for name in (set().union(*(reads(a.rel) for a in s.body)) | reads(s.cond)) - carried:
            if name in self.variables and costly(self.variables[name].df):
                keep(name)
        while True:
            for i, a in enumerate(s.body):
                self.assign(a.name, self.analyzer(functions).rel(a.rel))
                if a.name in used and last[a.name] == i:
                    keep(a.name)
            if isinstance(s.cond, T.Var) and s.cond.name in self.variables:
                cond = self.variables[s.cond.name]
            else:
                cond = self.analyzer(functions).rel(s.cond)
            first = cond.df.select("c0").head(1)
            if not first or not first[0][0]:
                return


def _needed_after(s: T.DoWhile, carried: set[str]) -> list[str]:
    """Variables of a loop that its next round reads before writing them, its condition, or its surroundings may read."""
    written: set[str] = set()
    before: set[str] = set()
    for a in s.body:
        before |= reads(a.rel) - written
        written.add(a.name)
    keep = (before & carried) | (reads(s.cond) & carried)
    return sorted(keep or carried)

