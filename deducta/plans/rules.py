"""Rules: text, syntax tree, checks, and a rule's body as one DataFrame.

    Reach(x, y) :- Edge(x, y)
    Reach(x, z) :- Edge(x, y), Reach(y, z)
    Open(x) :- Node(x), not Blocked(x), x > 3

Terms are variables, numbers, "strings", true, false, :symbols and #identities (both are strings to Spark). A body needs
an item; every variable of a negated atom, a guard or the head must occur in a positive atom.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.algebra import positional
from ..values import RelationError, compare, kind_of, literal_kind, same_kinds


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Constant:
    value: object


Term = Variable | Constant


@dataclass(frozen=True)
class Atom:
    relation: str
    terms: tuple[Term, ...]
    negated: bool = False

    @property
    def variables(self) -> set[str]:
        return {t.name for t in self.terms if isinstance(t, Variable)}


@dataclass(frozen=True)
class Guard:
    op: str
    left: Term
    right: Term

    @property
    def variables(self) -> set[str]:
        return {t.name for t in (self.left, self.right) if isinstance(t, Variable)}


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom | Guard, ...]
    source: str = field(default="", compare=False)

    @property
    def positive(self) -> list[Atom]:
        return [x for x in self.body if isinstance(x, Atom) and not x.negated]

    @property
    def negative(self) -> list[Atom]:
        return [x for x in self.body if isinstance(x, Atom) and x.negated]

    @property
    def guards(self) -> list[Guard]:
        return [x for x in self.body if isinstance(x, Guard)]


_TOKEN = re.compile(r'\s+|//[^\n]*|(?P<turn>:-)|(?P<op>!=|<=|>=|==|=|<|>)|(?P<text>"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<mark>[:#][A-Za-z_]\w*)|(?P<name>[A-Za-z_]\w*)|(?P<sign>[(),.;])')


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise RelationError("E_SYNTAX", f"unexpected {text[at]!r}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str:
        kind, value = self.peek()
        if wanted and kind not in wanted and value not in wanted:
            raise RelationError("E_SYNTAX", f"expected {' or '.join(wanted)}, found {value or 'the end'}")
        self.at += 1
        return value

    def term(self) -> Term:
        kind, value = self.peek()
        self.take("text", "number", "mark", "name")
        if kind == "text":
            return Constant(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), value[1:-1]))
        if kind == "number":
            return Constant(float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "mark":
            return Constant(value[1:])
        if value in ("true", "false"):
            return Constant(value == "true")
        if value == "_":
            raise RelationError("E_SYNTAX", "_ isn't a term of a rule")
        return Variable(value)

    def atom(self, negated: bool = False) -> Atom:
        name, terms = self.take("name"), []
        self.take("(")
        while self.peek()[1] != ")":
            if terms:
                self.take(",")
            terms.append(self.term())
        self.take(")")
        return Atom(name, tuple(terms), negated)

    def item(self) -> Atom | Guard:
        if self.peek()[1] == "not":
            self.take()
            return self.atom(True)
        if self.peek()[0] == "name" and self.peek(1)[1] == "(":
            return self.atom()
        left, op = self.term(), self.take("op")
        return Guard("=" if op == "==" else op, left, self.term())

    def rule(self) -> Rule:
        head = self.atom()
        self.take(":-")
        if self.peek()[0] == "end" or self.peek()[1] in (".", ";"):
            raise RelationError("E_RULE", f"{head.relation}: a rule needs a body")
        body = [self.item()]
        while self.peek()[1] == ",":
            self.take()
            body.append(self.item())
        while self.peek()[1] in (".", ";"):
            self.take()
        return Rule(head, tuple(body))


def _show(t: Term) -> str:
    if isinstance(t, Variable):
        return t.name
    v = t.value
    return str(v).lower() if isinstance(v, bool) else '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' if isinstance(v, str) else repr(v)


def show(rule: Rule) -> str:
    """A rule as text that parses to it."""
    atom = lambda a: f"{'not ' * a.negated}{a.relation}({', '.join(map(_show, a.terms))})"
    return f"{atom(rule.head)} :- " + ", ".join(atom(x) if isinstance(x, Atom) else f"{_show(x.left)} {x.op} {_show(x.right)}" for x in rule.body)


def parse(text: str) -> list[Rule]:
    """Rules of a program, in order."""
    p, out = _Parser(text), []
    while p.peek()[0] != "end":
        rule = p.rule()
        out.append(Rule(rule.head, rule.body, show(rule)))
    return out


def check(rule: Rule) -> None:
    """Safety, when a rule is installed."""
    if not rule.body:
        raise RelationError("E_RULE", f"{rule.head.relation}: a rule needs a body")
    known = set().union(*(a.variables for a in rule.positive))
    for items, code, what in ((rule.negative, "E_UNSAFE_NEGATION", "negated atom"), (rule.guards, "E_UNSAFE_GUARD", "guard"), ([rule.head], "E_UNBOUND_HEAD", "head")):
        for x in items:
            if loose := sorted(x.variables - known):
                raise RelationError(code, f"{rule.head.relation}: {loose[0]} of the {what} isn't bound")


def strata(rules: Iterable[Rule]) -> dict[str, int]:
    """Each derived relation's stratum: at least that of what it reads, and more than that of what it negates."""
    rules = list(rules)
    level = {r.head.relation: 0 for r in rules}
    for _ in range(len(level) + 1):
        changed = False
        for r in rules:
            least = max([level.get(x.relation, 0) + x.negated for x in r.body if isinstance(x, Atom)], default=0)
            if level[r.head.relation] < least:
                level[r.head.relation], changed = least, True
        if not changed:
            return level
    raise RelationError("E_UNSTRATIFIED", "a relation is negated in its own recursion")


def groups(rules: Iterable[Rule]) -> list[list[str]]:
    """Derived relations that depend on each other, dependencies first (Tarjan's components)."""
    rules = list(rules)
    heads = list(dict.fromkeys(r.head.relation for r in rules))
    uses = {h: list(dict.fromkeys(x.relation for r in rules if r.head.relation == h for x in r.body if isinstance(x, Atom) and x.relation in heads)) for h in heads}
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []

    def visit(h: str) -> None:
        index[h] = low[h] = len(index)
        stack.append(h)
        for u in uses[h]:
            if u not in index:
                visit(u)
                low[h] = min(low[h], low[u])
            elif u in stack:
                low[h] = min(low[h], index[u])
        if low[h] == index[h]:
            at = stack.index(h)
            out.append(sorted(stack[at:]))
            del stack[at:]

    for h in heads:
        if h not in index:
            visit(h)
    return out


def is_recursive(group: list[str], rules: Iterable[Rule]) -> bool:
    return len(group) > 1 or any(x.relation in group for r in rules if r.head.relation in group for x in r.body if isinstance(x, Atom))


Read = Callable[[str], DataFrame]


def scan(atom: Atom, df: DataFrame, weight: str | None = None) -> DataFrame:
    """An atom's bindings: a column v_name for each variable; constants and repeated variables are filters at the scan."""
    names = [c for c in df.columns if c != weight]
    if len(names) != len(atom.terms):
        raise RelationError("E_ARITY", f"{atom.relation} has {len(names)} columns, not {len(atom.terms)}")
    own = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), *([F.col(weight)] if weight else []))
    at: dict[str, int] = {}
    for i, t in enumerate(atom.terms):
        if isinstance(t, Constant):
            own = own.filter(F.col(f"c{i}") == F.lit(t.value)) if kind_of(own.schema[f"c{i}"].dataType) == literal_kind(t.value) else own.filter(F.lit(False))
        elif t.name in at:
            same_kinds(own.schema[f"c{at[t.name]}"].dataType, own.schema[f"c{i}"].dataType, t.name)
            own = own.filter(F.col(f"c{at[t.name]}") == F.col(f"c{i}"))
        else:
            at[t.name] = i
    return own.select(*(F.col(f"c{i}").alias(f"v_{n}") for n, i in at.items()), *([F.col(weight)] if weight else []))


def order(rule: Rule, first: Atom | None = None, size: Callable[[Atom], int] | None = None) -> list[Atom]:
    """Positive atoms, each connected to those before it where that is possible, the most constrained first; with a size for each atom
    the one with the least estimate, where every bound term is taken to leave a tenth."""
    left = list(rule.positive)
    out: list[Atom] = []
    known: set[str] = set()
    if first is not None:
        left.remove(first)
        out, known = [first], set(first.variables)
    constants = lambda a: sum(isinstance(t, Constant) for t in a.terms)
    while left:
        if size is not None:
            bound_terms = lambda a: len(a.variables & known) + constants(a)  # noqa: B023, E731
            best = min(left, key=lambda a: (bool(out) and not a.variables & known, size(a) / 10 ** bound_terms(a), left.index(a)))
            left.remove(best)
            out.append(best)
            known |= best.variables
            continue
        best = max(left, key=lambda a: (bool(a.variables & known) or not out, len(a.variables & known) + constants(a), -left.index(a)))
        left.remove(best)
        out.append(best)
        known |= best.variables
    return out


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _guarded(df: DataFrame, g: Guard) -> DataFrame:
    def side(t: Term):
        if isinstance(t, Variable):
            return F.col(f"v_{t.name}"), df.schema[f"v_{t.name}"].dataType
        kinds = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType()}
        return F.lit(t.value), kinds.get(literal_kind(t.value), T.StringType())

    (a, x), (b, y) = side(g.left), side(g.right)
    return df.filter(compare(g.op, a, x, b, y))


def _without(df: DataFrame, atom: Atom, other: DataFrame) -> DataFrame:
    found = scan(atom, other)
    if not found.columns:
        return df if found.isEmpty() else df.limit(0)
    for c in found.columns:
        same_kinds(df.schema[c].dataType, found.schema[c].dataType, c[2:])
    return df.join(found, found.columns, "left_anti")


def bindings(rule: Rule, read: Callable[[Atom], DataFrame], first: Atom | None = None) -> DataFrame:
    """All ways to satisfy a body, one column for each variable that the head needs (or all, where it counts). read gives the rows of
    each atom. Guards and negations come as soon as their variables are bound."""
    guards, negatives = list(rule.guards), list(rule.negative)
    df: DataFrame | None = None
    rows = {id(a): read(a) for a in rule.positive}  # atoms may be equal
    estimates = {a: planned_bytes(rows[id(a)]) for a in rule.positive} if len(rule.positive) > 2 else None
    atoms = order(rule, first, estimates.__getitem__ if estimates else None)
    for i, atom in enumerate(atoms):
        own = scan(atom, rows[id(atom)])
        if df is None:
            df = own
        else:
            shared = [c for c in own.columns if c in df.columns]
            for c in shared:
                same_kinds(df.schema[c].dataType, own.schema[c].dataType, c[2:])
            df = df.join(own, shared) if shared else df.crossJoin(own)
        have = set(df.columns)
        bound_ = lambda x: {f"v_{n}" for n in x.variables} <= have or i == len(atoms) - 1  # noqa: B023, E731
        for g in [g for g in guards if bound_(g)]:
            df = _guarded(df, g)
            guards.remove(g)
        for n in [n for n in negatives if bound_(n)]:
            df = _without(df, n, read(n))
            negatives.remove(n)
    if df is None:
        raise RelationError("E_RULE", f"{rule.head.relation}: a body needs a positive atom")
    return df


def head(rule: Rule, df: DataFrame, like: T.StructType | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """A head's columns c0, c1, ... from a body's bindings."""
    out = []
    for i, t in enumerate(rule.head.terms):
        c = F.lit(t.value) if isinstance(t, Constant) else F.col(f"v_{t.name}")
        if like is not None and len(like) == len(rule.head.terms):
            c = c.cast(like[i].dataType)
        out.append(c.alias(f"c{i}"))
    return df.select(*out, *extra)


def derive(rule: Rule, read: Callable[[Atom], DataFrame], like: T.StructType | None = None, first: Atom | None = None) -> DataFrame:
    """What a rule adds to its head; duplicates are not removed yet."""
    return head(rule, bindings(rule, read, first), like)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [positional(f) for f in frames])
