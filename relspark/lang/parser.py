"""Recursive-descent parser of the script language. Functions are kept as definitions; calls are resolved by the analyzer."""

from __future__ import annotations

from relspark import errors as E
from relspark.functions.scalar import LIBRARY
from relspark.lang import tree as T
from relspark.lang.lexer import Token, tokenize

TYPES = {"int": "LONG", "float": "DOUBLE", "string": "STRING", "boolean": "BOOLEAN", "blob": "BLOB"}
#: Column types of the TIPSY format, in order (fixed values).
TIPSY = tuple((n, "LONG" if n in ("iOrder", "grp") else "STRING" if n == "type" else "DOUBLE") for n in "iOrder mass x y z vx vy vz rho temp hsmooth metals tform eps phi grp type".split())


class Parser:
    def __init__(self, text: str):
        self.tokens = tokenize(text)
        self.at = 0
        self.functions: dict[str, object] = {}
        self.dashed = False

    # Tokens.

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def error(self, what: str = "") -> E.ScriptSyntaxError:
        return E.ScriptSyntaxError(f"line {self.now.line}: {what or 'unexpected'} {self.now.value!r}")

    def is_(self, *values: str) -> bool:
        return self.now.kind in ("op", "key") and self.now.value in values

    def take(self, *values: str) -> bool:
        if self.is_(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise self.error(f"{value!r} expected, not")

    def kind(self, kind: str):
        if self.now.kind != kind:
            raise self.error(f"{kind} expected, not")
        self.at += 1
        return self.tokens[self.at - 1].value

    def listed(self, item, closing: str | None = None) -> list:
        if closing and self.is_(closing):
            return []
        out = [item()]
        while self.take(","):
            out.append(item())
        return out

    def free_id(self) -> str:
        name = self.kind("id")
        if name.lower() in LIBRARY:
            raise E.ReservedWord(name)
        return name

    # Programs.

    def program(self) -> list:
        out = []
        while self.now.kind != "end":
            s = self.statement()
            if s is not None:
                out.append(s)
        return out

    def statement(self):
        if self.take(";"):
            return None
        if self.take("def"):
            return self.define()
        if self.take("const"):
            name = self.free_id()
            self.need(":")
            self.add(name, T.Function((), (self.expr(),)))
            return self.need(";")
        if self.is_("apply", "uda"):
            return self.stateful()
        if self.take("store"):
            return self.store()
        if self.is_("sink", "dump", "export"):
            kind = self.now.value
            self.at += 1
            self.need("(")
            name = self.kind("id")
            uri = self.kind("string") if kind == "export" and self.take(",") else None
            self.need(")")
            self.need(";")
            return T.Out(kind, name, uri)
        if self.take("do"):
            return self.loop()
        name = self.free_id()
        self.equals()
        rel = self.rvalue()
        self.need(";")
        return T.Assign(name, rel)

    def equals(self) -> None:
        self.need("==")

    def add(self, name: str, f) -> None:
        if name in self.functions:
            raise E.DuplicateFunction(name)
        self.functions[name] = f

    def arguments(self) -> tuple:
        self.need("(")
        args = self.listed(self.free_id, ")")
        self.need(")")
        if len(set(args)) != len(args):
            raise E.DuplicateVariable(str(args))
        return tuple(args)

    def define(self) -> None:
        name, args = self.free_id(), self.arguments()
        self.need(":")
        if self.is_("["):
            bodies = tuple(x for e in self.table_literal() for x in e.exprs)
        else:
            bodies = (self.expr(),)
        self.need(";")
        for body in bodies:
            self.check_names(name, body, args)
        self.add(name, T.Function(args, bodies))

    def check_names(self, name: str, body, known) -> None:
        for x in T.walk(body):
            if isinstance(x, T.Name) and x.name not in known and x.name not in self.functions:
                raise E.UndefinedVariable(f"{x.name} in {name}")

    def stateful(self) -> None:
        aggregate = self.now.value == "uda"
        self.at += 1
        if aggregate and self.take("*"):
            name = self.free_id()
            self.need("{")
            local = self.free_id()
            self.need(",")
            remote = self.free_id()
            self.need("}")
            self.need(";")
            return self.decomposable(name, local, remote)
        name, args = self.free_id(), self.arguments()
        self.need("{")
        inits = self.table_literal()
        self.need(";")
        self.need("[")
        updates = self.listed(self.emit)
        self.need("]")
        self.need(";")
        if self.take("["):
            outputs = tuple(self.listed(self.expr))
            self.need("]")
            self.need(";")
        elif self.is_("}"):
            outputs = None
        else:
            outputs = (self.expr(),)
            self.need(";")
        self.need("}")
        self.need(";")
        if len(inits) != len(updates):
            raise E.BadDefinition(f"{name}: {len(inits)} inits, {len(updates)} updates")
        states = []
        for i, u in zip(inits, updates, strict=True):
            if isinstance(i, T.Star) or isinstance(u, T.Star):
                raise E.BadDefinition(f"{name}: wildcard")
            if len(i.exprs) != 1 or len(u.exprs) != 1:
                raise E.BadDefinition(f"{name}: tuple")
            if not i.names:
                raise E.BadDefinition(f"{name}: unnamed state")
            if i.names[0] in args or i.names[0] in [s[0] for s in states]:
                raise E.DuplicateVariable(i.names[0])
            states.append((i.names[0], i.exprs[0], u.exprs[0]))
        own = [s[0] for s in states]
        for _, init, update in states:
            self.check_names(name, init, ())
            self.check_names(name, update, (*own, *args))
        outputs = outputs or tuple(T.Name(s) for s in own)
        for o in outputs:
            self.check_names(name, o, own)
        self.add(name, T.Stateful(name, args, tuple(states), outputs, aggregate))

    def decomposable(self, name: str, local: str, remote: str) -> None:
        for f in (name, local, remote):
            if not isinstance(self.functions.get(f), T.Stateful) or not self.functions[f].aggregate:
                raise E.NoSuchFunction(f)
        logical, l, r = (self.functions[f] for f in (name, local, remote))  # noqa: E741
        if len(l.args) != len(logical.args) or len(r.args) != len(l.outputs) or len(r.outputs) != len(logical.outputs):
            raise E.BadDefinition(f"{name}: parts don't fit")
        self.functions[name] = T.Stateful(name, logical.args, logical.states, logical.outputs, True, l, r)

    def store(self):
        self.need("(")
        name = self.kind("id")
        self.need(",")
        key = self.key()
        how, columns = None, ()
        if self.take(","):
            if self.is_("["):
                self.need("[")
                how, columns = "hash", tuple(self.listed(self.column))
                self.need("]")
            else:
                how = self.now.value
                if how not in ("hash", "broadcast", "round_robin"):
                    raise self.error()
                self.at += 1
                self.need("(")
                columns = tuple(self.listed(self.column, ")"))
                self.need(")")
        self.need(")")
        self.need(";")
        return T.Store(name, key, how, columns)

    def loop(self):
        if self.now.kind == "id" and self.peek().value == "==" and self.is_rule():
            rules = []
            while not self.is_("until"):
                name = self.free_id()
                self.equals()
                emits = tuple(self.table_literal())
                self.need("<-")
                rules.append(T.Rule(name, emits, self.rvalue()))
                self.need(";")
            self.need("until")
            self.need("convergence")
            options = []
            while not self.is_(";"):
                options.append(self.now.value)
                self.at += 1
            self.need(";")
            return T.Until(tuple(rules), tuple(options))
        body = []
        while not self.is_("while"):
            s = self.statement()
            if s is not None and not isinstance(s, T.Assign):
                raise E.InvalidStatement("a loop's body holds assignments only")
            if s is not None:
                body.append(s)
        self.need("while")
        cond = self.rvalue()
        self.need(";")
        return T.DoWhile(tuple(body), cond)

    def is_rule(self) -> bool:
        """Whether an assignment that begins here is a recursive rule: name = [...] <- ..."""
        i, depth = self.at + 2, 0
        while self.tokens[i].kind != "end" and self.tokens[i].value != ";":
            v = self.tokens[i].value if self.tokens[i].kind == "op" else None
            depth += (v in ("[", "(")) - (v in ("]", ")"))
            if v == "<-" and not depth:
                return True
            i += 1
        return False

    # Relations.

    def rvalue(self):
        return self.select() if self.is_("select") else self.rel()

    def rel(self):
        left = self.primary()
        parts = [left]
        while self.take("+"):
            parts.append(self.primary())
        return left if len(parts) == 1 else T.Rel("unionall", tuple(parts))

    def primary(self):
        t = self.now
        if self.take("("):
            r = self.select() if self.is_("select") else self.rel()
            self.need(")")
            return r
        if self.is_("["):
            if self.peek().kind == "key" and self.peek().value == "from":
                return self.comprehension()
            return T.Literal(tuple(self.table_literal()))
        if t.kind == "id":
            self.at += 1
            return T.Var(t.value)
        if t.kind != "key":
            raise self.error()
        self.at += 1
        self.need("(")
        v = t.value
        if v == "scan":
            out = T.Scan(self.key())
        elif v == "samplescan":
            key = self.key()
            self.need(",")
            negative = self.take("-")
            size = self.kind(self.now.kind if self.now.kind in ("int", "float") else "int") * (-1 if negative else 1)
            percent, kind = self.take("%"), "WR"
            if self.take(","):
                kind = str(self.kind("id"))
            if kind.upper() not in ("WR", "WOR") or size < 0 or percent and size > 100:
                raise E.InvalidStatement(f"sample {size} {kind}")
            out = T.Sample(key, size, percent, kind.upper())
        elif v == "load":
            path = self.kind("string")
            self.need(",")
            out = T.Load(path, *self.format())
        elif v == "empty":
            out = T.EmptyRel(self.schema(")"))
        elif v in ("cross", "union", "intersect", "diff"):
            a = self.rvalue()
            self.need(",")
            out = T.Rel(v, (a, self.rvalue()))
        elif v == "unionall":
            out = T.Rel(v, tuple(self.listed(self.rvalue)))
        elif v in ("distinct", "countall"):
            out = T.Rel(v, (self.rvalue(),))
        elif v == "limit":
            a = self.rvalue()
            self.need(",")
            out = T.LimitRel(a, self.kind("int"))
        elif v == "join":
            a = self.rvalue()
            self.need(",")
            ac = self.columns()
            self.need(",")
            b = self.rvalue()
            self.need(",")
            out = T.JoinRel(a, ac, b, self.columns())
            if len(out.left_cols) != len(out.right_cols):
                raise E.SchemaMismatch("a join needs as many columns on either side")
        else:
            self.at -= 2
            raise self.error()
        self.need(")")
        return out

    def columns(self) -> tuple:
        if self.take("("):
            out = tuple(self.listed(self.column))
            self.need(")")
            return out
        return (self.column(),)

    def column(self) -> str | int:
        if self.take("$"):
            return self.kind("int")
        return self.kind("id")

    def schema(self, closing: str) -> tuple:
        def one():
            name = self.kind("id")
            self.need(":")
            kind = self.now.value
            if kind not in TYPES:
                raise self.error("type expected, not")
            self.at += 1
            return name, TYPES[kind]

        return tuple(self.listed(one, closing))

    def format(self):
        v = self.now.value
        self.at += 1
        self.need("(")
        schema: tuple = ()
        if v == "csv":
            self.need("schema")
            self.need("(")
            schema = self.schema(")")
            self.need(")")
            self.take(",")
        elif v == "tipsy":
            schema = TIPSY
        elif v != "opp":
            raise self.error()

        def option():
            name = self.kind("id")
            self.equals()
            value = self.now.value
            self.at += 1
            return name.lower(), value

        options = tuple(self.listed(option, ")"))
        self.need(")")
        return v, schema, options

    def key(self) -> str:
        parts = []
        while True:
            if self.now.kind not in ("id", "string", "key"):
                raise self.error()
            parts.append(str(self.now.value))
            self.at += 1
            if not self.take(":"):
                break
        return relation_key(":".join(parts))

    def comprehension(self):
        self.need("[")
        self.need("from")
        sources = tuple(self.listed(self.source))
        where = self.expr() if self.take("where") else None
        self.need("emit")
        emits = tuple(self.listed(self.emit))
        order, limit = self.tail()
        self.need("]")
        return T.Bag(sources, where, emits, order, limit)

    def select(self):
        self.need("select")
        distinct = self.take("distinct")
        emits = tuple(self.listed(self.emit))
        self.need("from")
        sources = tuple(self.listed(self.source))
        where = self.expr() if self.take("where") else None
        order, limit = self.tail()
        return T.Bag(sources, where, emits, order, limit, distinct)

    def tail(self):
        order: list = []
        if self.take("order"):
            self.need("by")

            def one():
                c = self.column()
                return c, not self.take("desc") and (self.take("asc") or True)

            order = self.listed(one)
        limit = self.kind("int") if self.take("limit") else None
        if order and limit is None or limit is not None and not order:
            raise E.InvalidStatement("ORDER BY and LIMIT go together")
        return tuple(order), limit

    def source(self):
        if self.now.kind == "id" and not (self.peek().kind == "op" and self.peek().value == "+"):
            name = self.kind("id")
            if self.take("as") or self.now.kind == "id":
                return self.kind("id"), T.Var(name)
            return name, None
        r = self.rel()
        self.take("as")
        return self.kind("id"), r

    def table_literal(self) -> list:
        self.need("[")
        out = self.listed(self.emit)
        self.need("]")
        return out

    def emit(self):
        if self.is_("*"):
            nxt = self.peek()
            if nxt.kind == "end" or nxt.kind == "op" and nxt.value in ("]", ",", ";", ")") or nxt.kind == "key" and nxt.value in ("from", "order"):
                self.at += 1
                return T.Star(None)
        if self.now.kind == "id" and self.peek().value == "." and self.peek(2).value == "*" and self.peek(2).kind == "op":
            alias = self.kind("id")
            self.at += 2
            return T.Star(alias)
        e = self.expr()
        names = None
        if self.take("as"):
            if self.take("["):
                names = tuple(self.listed(self.free_id))
                self.need("]")
            else:
                names = (self.free_id(),)
        return T.Emit((e,), names)

    # Scalar expressions, from the weakest binding to the strongest.

    def expr(self):
        e = self.conj()
        while self.take("or"):
            e = T.Op("or", (e, self.conj()))
        return e

    def conj(self):
        e = self.negation()
        while self.take("and"):
            e = T.Op("and", (e, self.negation()))
        return e

    def negation(self):
        return T.Op("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self):
        e = self.sum()
        while self.is_("==", "!=", "<", ">", "<=", ">=", "like"):
            op = self.now.value
            self.at += 1
            e = T.Op(op, (e, self.sum()))
        return e

    def sum(self):
        e = self.product()
        while self.is_("+", "-"):
            op = self.now.value
            self.at += 1
            e = T.Op(op, (e, self.product()))
        return e

    def product(self):
        e = self.unary()
        while self.is_("*", "/", "//", "%"):
            op = self.now.value
            self.at += 1
            e = T.Op(op, (e, self.unary()))
        return e

    def unary(self):
        if self.take("-"):
            arg = self.unary()
            return T.Lit(-arg.value, arg.type) if isinstance(arg, T.Lit) and arg.type in ("LONG", "DOUBLE") else T.Op("neg", (arg,))
        return self.atom()

    def atom(self):
        t = self.now
        if t.kind in ("int", "float", "string", "blob"):
            self.at += 1
            return T.Lit(t.value, {"int": "LONG", "float": "DOUBLE", "string": "STRING", "blob": "BLOB"}[t.kind])
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("$"):
            return T.Pos(self.kind("int"))
        if self.take("*"):
            name = self.kind("id")
            return T.Unbox(name, self.column() if self.take(".") else None)
        if t.kind == "key":
            self.at += 1
            v = t.value
            if v in ("true", "false"):
                return T.Lit(v == "true", "BOOLEAN")
            if v in TYPES:
                self.need("(")
                e = self.expr()
                self.need(")")
                return T.Cast(TYPES[v], e)
            if v == "case":
                whens = []
                while self.take("when"):
                    c = self.expr()
                    self.need("then")
                    whens.append((c, self.expr()))
                self.need("else")
                default = self.expr()
                self.need("end")
                return T.Case(tuple(whens), default)
            if v in ("count", "countall"):
                self.need("(")
                if self.is_(")") or v == "count" and self.is_("*") and self.peek().value == ")":
                    self.take("*")
                    out = T.Call("countall", ())
                else:
                    out = T.Call("count", (self.expr(),))
                self.need(")")
                return out
            if v == "worker_id":
                self.need("(")
                self.need(")")
                return T.Call("worker_id", ())
            self.at -= 1
            raise self.error()
        name = self.kind("id")
        if self.take("("):
            args = tuple(self.listed(self.expr, ")"))
            self.need(")")
            return T.Call(name, args)
        if self.is_(".") and (self.peek().kind == "id" or self.peek().value == "$"):
            self.at += 1
            return T.Dot(name, self.column())
        return T.Name(name)


def relation_key(text: str) -> str:
    """user:program:relation; a name alone is public:adhoc:name."""
    parts = text.split(":")
    if len(parts) == 1:
        return f"public:adhoc:{text}"
    if len(parts) != 3:
        raise E.NoSuchRelation(f"{text}: a key has one or three parts")
    return text


def parse(text: str) -> tuple[list, dict]:
    """(statements, functions) of a program."""
    p = Parser(text)
    statements = p.program()
    return statements, p.functions
