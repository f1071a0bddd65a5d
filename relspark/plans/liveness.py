"""Which statements matter: assignments are lazy anyway, but a loop runs at once, so one whose results nobody reads is left out."""

from __future__ import annotations

from dataclasses import dataclass

from relspark.lang import tree as T


@dataclass(frozen=True)
class Unread:
    """An assignment that nothing reads; it is checked if what it reads is there."""

    assign: T.Assign


def reads(node) -> set[str]:
    found = set()
    for x in T.walk(node):
        if isinstance(x, T.Var):
            found.add(x.name)
        elif isinstance(x, T.Bag):
            found |= {a for a, r in x.sources if r is None}
        elif isinstance(x, T.Unbox):
            found.add(x.relation)
    return found


def live(statements: list, wanted: set[str]) -> tuple[list, set[str]]:
    """(statements that ``wanted`` variables or outputs need, variables needed before them)."""
    out = []
    for s in reversed(statements):
        if isinstance(s, T.Assign):
            if s.name in wanted:
                out.append(s)
                wanted = (wanted - {s.name}) | reads(s.rel)
            else:
                out.append(Unread(s))
        elif isinstance(s, T.DoWhile):
            made = {a.name for a in s.body}
            if made & wanted:
                need = wanted | reads(s.cond)
                while True:
                    body, before = live(list(s.body), need)
                    if before <= need:
                        break
                    need |= before
                out.append(T.DoWhile(tuple(b for b in body if not isinstance(b, Unread)), s.cond))
                wanted = need
        elif isinstance(s, T.Until):
            if {r.name for r in s.rules} & wanted:
                out.append(s)
                wanted = wanted | set().union(*(reads(r.rel) for r in s.rules))
        else:
            out.append(s)
            wanted = wanted | {s.name}
    return out[::-1], wanted
