"""Incremental maintenance: the change of a derived relation from the changes of what it is derived from.

Relations that aren't recursive keep a support count for each tuple; a delta is a set of rows with a weight, and only
counts that reach or leave zero are visible. Recursive groups are maintained by deleting too much and deriving again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.algebra import positional
from ..sources.scratch import Table, staged
from ..values import RelationError, same_kinds
from .fixpoint import _fresh, fixpoint
from .rules import Atom, Rule, _guarded, bindings, check, derive, groups, head, is_recursive, scan, strata, union_all

WEIGHT = "w__"


def delta(asserts: DataFrame | None = None, retracts: DataFrame | None = None) -> DataFrame:
    """Rows with weight +1 and -1; columns c0, c1, ..."""
    parts = [positional(d).withColumn(WEIGHT, F.lit(w).cast("long")) for d, w in ((asserts, 1), (retracts, -1)) if d is not None]
    if not parts:
        raise RelationError("E_RELATION", "a delta needs rows")
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def settle(d: DataFrame, old: DataFrame) -> DataFrame:
    """A delta without what changes nothing: asserts of present tuples, retractions of absent ones, and both of one tuple."""
    cols = [c for c in d.columns if c != WEIGHT]
    net = d.groupBy(*cols).agg(F.sum(WEIGHT).alias(WEIGHT)).filter(f"{WEIGHT} <> 0")
    here = positional(old)
    ups, downs = net.filter(f"{WEIGHT} > 0"), net.filter(f"{WEIGHT} < 0")
    return ups.join(here, cols, "left_anti").union(downs.join(here, cols, "left_semi")).select(*cols, F.signum(WEIGHT).cast("long").alias(WEIGHT))


def applied(old: DataFrame, d: DataFrame) -> DataFrame:
    """A relation after a settled delta."""
    cols = [c for c in d.columns if c != WEIGHT]
    return positional(old).join(d.filter(f"{WEIGHT} < 0"), cols, "left_anti").union(d.filter(f"{WEIGHT} > 0").select(*cols))


def _weighted(df: DataFrame) -> DataFrame:
    return df if WEIGHT in df.columns else positional(df).withColumn(WEIGHT, F.lit(1).cast("long"))


def _join(left: DataFrame | None, right: DataFrame) -> DataFrame:
    if left is None:
        return right
    shared = [c for c in right.columns if c in left.columns and c != WEIGHT]
    for c in shared:
        same_kinds(left.schema[c].dataType, right.schema[c].dataType, c[2:])
    other = right.withColumnRenamed(WEIGHT, "other__")
    joined = left.join(other, shared) if shared else left.crossJoin(other)
    return joined.withColumn(WEIGHT, F.col(WEIGHT) * F.col("other__")).drop("other__")


def support(rule: Rule, read: Callable[[str], DataFrame]) -> DataFrame:
    """The number of ways to derive each tuple of a rule's head: c0, ..., weight."""
    found = head(rule, bindings(rule, lambda a: read(a.relation)).withColumn(WEIGHT, F.lit(1).cast("long")), None, (WEIGHT,))
    return _summed(found)


def _summed(df: DataFrame) -> DataFrame:
    cols = [c for c in df.columns if c != WEIGHT]
    return df.groupBy(*cols).agg(F.sum(WEIGHT).alias(WEIGHT)).filter(f"{WEIGHT} <> 0")


def rule_delta(rule: Rule, old: Callable[[str], DataFrame], new: Callable[[str], DataFrame], deltas: Mapping[str, DataFrame]) -> DataFrame | None:
    """The change of a rule's support. Items are taken in order; for each that changed: the new state of those before it, its delta, the
    old state of those after it. A negated atom changes where its bindings begin or cease to match."""
    items = [*rule.positive, *rule.negative]
    parts = []
    for i, at in enumerate(items):
        if at.relation not in deltas:
            continue
        d = deltas[at.relation]
        if at.negated:
            own = None
        else:
            own = scan(at, d, WEIGHT)
        rest = [x for x in items if x is not at]
        state = lambda x, i=i: new(x.relation) if next(k for k, y in enumerate(items) if y is x) < i else old(x.relation)
        df = own
        todo = [x for x in rest if not x.negated]
        while todo:  # atoms that share variables with what is joined already come first
            have = set() if df is None else {c[2:] for c in df.columns}
            nxt = max(todo, key=lambda x: (len(x.variables & have) if have else 0, -todo.index(x)))
            todo.remove(nxt)
            df = _join(df, scan(nxt, _weighted(state(nxt)), WEIGHT))
        if at.negated:
            names = [f"v_{n}" for n in sorted(at.variables)]
            before, after = scan(at, old(at.relation)).select(*names).distinct(), scan(at, new(at.relation)).select(*names).distinct()
            flips = before.join(after, names, "left_anti").withColumn(WEIGHT, F.lit(1).cast("long")).union(after.join(before, names, "left_anti").withColumn(WEIGHT, F.lit(-1).cast("long")))
            df = _join(df, flips)
        for x in rest:
            if x.negated:
                found = scan(x, state(x))
                df = df.join(found, found.columns, "left_anti")
        for g in rule.guards:
            df = _guarded(df, g)
        parts.append(head(rule, df, None, (WEIGHT,)))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return _summed(out)


class Trace:
    """A relation, or support counts, as a base and the deltas since. The base is never rewritten by a change; after COMPACT_AFTER
    deltas they are summed up into one. Counts keep weights; a relation's deltas are settled ones."""

    def __init__(self, base: DataFrame):
        self.base, self.deltas = base, []

    def add(self, d: DataFrame) -> None:
        self.deltas.append(d)
        if len(self.deltas) > COMPACT_AFTER:
            self.deltas = [staged(self.net())]

    def net(self) -> DataFrame | None:
        if not self.deltas:
            return None
        out = self.deltas[0]
        for d in self.deltas[1:]:
            out = out.union(d.select(*out.columns))
        return _summed(out)

    def read(self) -> DataFrame:
        """A relation's rows."""
        d = self.net()
        return self.base if d is None else applied(self.base, d)

    def support(self, of: DataFrame) -> DataFrame:
        """The counts of the tuples in of; the base is only joined with those."""
        cols = [c for c in self.base.columns if c != WEIGHT]
        keys = of.select(*cols).distinct()
        parts = [self.base, *self.deltas]
        out = parts[0].join(keys, cols, "left_semi")
        for p in parts[1:]:
            out = out.union(p.select(*self.base.columns).join(keys, cols, "left_semi"))
        return _summed(out)


#: Deltas that a trace keeps apart.
COMPACT_AFTER = 8


def advance(counts: DataFrame, change: DataFrame) -> DataFrame:
    """New support counts. A negative one is an error: the state and the changes don't belong together."""
    both = _summed(counts.union(change.select(*counts.columns)))
    w = F.col(WEIGHT)
    return both.withColumn(WEIGHT, F.when(w >= 0, w).otherwise(F.raise_error(F.lit("E_SUPPORT: negative support")).cast("long")))


def crossings(before: DataFrame, after: DataFrame) -> DataFrame:
    """The visible change: +1 for tuples whose support began, -1 for those whose support ended."""
    cols = [c for c in before.columns if c != WEIGHT]
    began = after.join(before, cols, "left_anti").select(*cols, F.lit(1).cast("long").alias(WEIGHT))
    return began.union(before.join(after, cols, "left_anti").select(*cols, F.lit(-1).cast("long").alias(WEIGHT)))


def delete_and_rederive(group: list[str], rules: list[Rule], old: Callable[[str], DataFrame], new: Callable[[str], DataFrame], deltas: Mapping[str, DataFrame], before: Mapping[str, DataFrame], facts: Callable[[str], DataFrame | None]) -> dict[str, DataFrame]:
    """The visible deltas of a recursive group. deltas: of what it reads and of its stored facts; before: its relations so far; facts: its
    stored facts, already changed. Every join starts from what changed."""
    spark = next(iter(before.values())).sparkSession
    lost = {n: staged(d.filter(f"{WEIGHT} < 0").drop(WEIGHT)) for n, d in deltas.items()}
    won = {n: staged(d.filter(f"{WEIGHT} > 0").drop(WEIGHT)) for n, d in deltas.items()}
    rule_of = lambda h: [r for r in rules if r.head.relation == h]
    was = lambda x: before[x.relation] if x.relation in group else old(x.relation)
    # over-delete: all that a lost tuple had a part in
    gone = {h: Table(spark, f"gone-{h.lower()}") for h in group}
    fresh = {}
    for h in group:
        parts = [lost[h]] if h in lost else []
        for r in rule_of(h):
            parts += [derive(r, lambda x, a=a: lost[x.relation] if x is a else was(x), before[h].schema, first=a) for a in r.positive if a.relation in lost and a.relation not in group]
            parts += [_flipped(r, a, won[a.relation], was, before[h].schema) for a in r.negative if a.relation in won]
        fresh[h] = gone[h].add(union_all(parts).distinct().join(before[h], before[h].columns, "left_semi") if parts else before[h].limit(0))
    while any(fresh.values()):
        last = {h: gone[h].read(last=True) for h in group}
        more: dict[str, list[DataFrame]] = {h: [] for h in group}
        for r in rules:
            h = r.head.relation
            more[h] += [derive(r, lambda x, a=a: last[x.relation] if x is a else was(x), before[h].schema, first=a) for a in r.positive if a.relation in group and fresh[a.relation]]
        fresh = {h: gone[h].add(_fresh(union_all(m), gone[h].read()).join(before[h], before[h].columns, "left_semi") if m else before[h].limit(0)) for h, m in more.items()}
    kept = {h: before[h].join(gone[h].read(), before[h].columns, "left_anti") if gone[h].rows else before[h] for h in group}
    # derive again what was deleted too much, and what the won tuples add
    back = {h: Table(spark, f"back-{h.lower()}") for h in group}
    now = lambda x: kept[x.relation] if x.relation in group else new(x.relation)
    fresh = {}
    for h in group:
        parts = [won[h]] if h in won else []
        if gone[h].rows:
            if (f := facts(h)) is not None:
                parts.append(f.join(gone[h].read(), f.columns, "left_semi"))
            for r in rule_of(h):
                wanted = Atom(h, r.head.terms)
                parts.append(derive(Rule(r.head, (wanted, *r.body)), lambda x, w=wanted: gone[w.relation].read() if x is w else now(x), before[h].schema, first=wanted))
        for r in rule_of(h):
            parts += [derive(r, lambda x, a=a: won[x.relation] if x is a else now(x), before[h].schema, first=a) for a in r.positive if a.relation in won and a.relation not in group]
            parts += [_flipped(r, a, lost[a.relation], now, before[h].schema, keep=True) for a in r.negative if a.relation in lost]
        fresh[h] = back[h].add(_fresh(union_all(parts), kept[h]) if parts else before[h].limit(0))
    while any(fresh.values()):
        last = {h: back[h].read(last=True) for h in group}
        full = {h: kept[h].union(back[h].read()) for h in group}
        more = {h: [] for h in group}
        for r in rules:
            h = r.head.relation
            more[h] += [derive(r, lambda x, a=a: last[x.relation] if x is a else full[x.relation] if x.relation in group else new(x.relation), before[h].schema, first=a) for a in r.positive if a.relation in group and fresh[a.relation]]
        fresh = {h: back[h].add(_fresh(union_all(m), full[h]) if m else before[h].limit(0)) for h, m in more.items()}
    # what was there before and is back again hasn't changed
    weigh = lambda df, w: df.withColumn(WEIGHT, F.lit(w).cast("long"))
    return {h: staged(weigh(back[h].read().join(before[h], before[h].columns, "left_anti"), 1).union(weigh(gone[h].read().join(back[h].read(), before[h].columns, "left_anti"), -1))) for h in group}


def _flipped(rule: Rule, at: Atom, rows: DataFrame, read: Callable[[Atom], DataFrame], like, keep: bool = False) -> DataFrame:
    """Heads of a rule's bindings that match rows at a negated atom. keep: the negation itself must hold too."""
    extra = Atom(at.relation, at.terms)
    body = tuple(x for x in rule.body if keep or x is not at)
    return derive(Rule(rule.head, (*body, extra)), lambda x: rows if x is extra else read(x), like, first=extra)


@dataclass
class Maintained:
    """Derived relations that are kept up to date. Only targets and what they depend on are warm."""

    rules: list[Rule]
    stored: dict[str, DataFrame]
    targets: list[str]
    counts: dict[str, Trace] = field(default_factory=dict)
    relations: dict[str, Trace] = field(default_factory=dict)

    def __post_init__(self):
        for r in self.rules:
            check(r)
        strata(self.rules)
        wanted, todo = set(), list(self.targets)
        while todo:
            n = todo.pop()
            if n not in wanted:
                wanted.add(n)
                todo += [x.relation for r in self.rules if r.head.relation == n for x in r.body if isinstance(x, Atom)]
        self.order = [g for g in groups(self.rules) if set(g) & wanted]
        # stored relations are read where they are; only what is derived is written
        self.facts_of = {n: Trace(positional(d)) for n, d in self.stored.items()}
        for g in self.order:
            own = [r for r in self.rules if r.head.relation in g]
            if is_recursive(g, own):
                self.relations |= {h: Trace(staged(d)) for h, d in fixpoint(g, own, self.facts, self.read).items()}
            else:
                h = g[0]
                parts = [support(r, self.read) for r in own]
                if (f := self.facts(h)) is not None:
                    parts.append(f.withColumn(WEIGHT, F.lit(1).cast("long")))
                total = parts[0]
                for p in parts[1:]:
                    total = total.union(p)
                base = staged(_summed(total))
                self.counts[h], self.relations[h] = Trace(base), Trace(base.drop(WEIGHT))

    def facts(self, name: str) -> DataFrame | None:
        return self.facts_of[name].read() if name in self.facts_of else None

    def read(self, name: str) -> DataFrame:
        return (self.relations.get(name) or self.facts_of[name]).read()

    def support(self, name: str) -> DataFrame:
        """All support counts of a relation."""
        t = self.counts[name]
        return t.base if not t.deltas else _summed(t.base.union(t.net().select(*t.base.columns)))

    def advance(self, changes: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Takes deltas of stored relations; returns the visible deltas of the warm derived ones."""
        before = {n: t.read() for n, t in (self.facts_of | self.relations).items()}
        raw = {n: staged(settle(d, self.facts_of[n].read())) for n, d in changes.items()}
        raw = {n: d for n, d in raw.items() if not d.isEmpty()}
        for n, d in raw.items():
            self.facts_of[n].add(d)
        deltas = {n: d for n, d in raw.items() if n not in self.relations}
        for g in self.order:
            own = [r for r in self.rules if r.head.relation in g]
            touched = any(x.relation in deltas for r in own for x in r.body if isinstance(x, Atom)) or any(h in raw for h in g)
            if not touched:
                continue
            if is_recursive(g, own):
                outside = {n: d for n, d in deltas.items() if n not in g} | {h: raw[h] for h in g if h in raw}
                found = delete_and_rederive(g, own, before.__getitem__, self.read, outside, {h: before[h] for h in g}, self.facts)
            else:
                h = g[0]
                parts = [p for r in own if (p := rule_delta(r, before.__getitem__, self.read, deltas)) is not None]
                if h in raw:
                    parts.append(raw[h])
                total = parts[0]
                for p in parts[1:]:
                    total = total.union(p.select(*total.columns))
                change = staged(_summed(total))
                old = staged(self.counts[h].support(change))
                found = {h: staged(crossings(old, advance(old, change)))}
                self.counts[h].add(change)
            for h, d in found.items():
                deltas[h] = d
                self.relations[h].add(d)
        return {h: deltas[h] for g in self.order for h in g if h in deltas}


def by_evaluation(rules: list[Rule], before: dict[str, DataFrame], after: dict[str, DataFrame], target: str, computed: dict | None = None) -> DataFrame:
    """The settled changes of a derived relation by evaluating both states in full: for rules with computed atoms, which have no deltas."""
    from .fixpoint import evaluate

    old, new = (evaluate(rules, stored, target, computed=computed)[target] for stored in (before, after))
    return delta(new.subtract(old), old.subtract(new))
