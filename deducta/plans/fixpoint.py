"""Evaluation of rule sets: strata in order, one plan for each relation that isn't recursive, semi-naive rounds for the others.

A round joins what was new in the round before at one recursive atom with everything known at the others. Its result
is written to the shared folder, so plans don't grow with the rounds and a lost executor costs no recomputation of
earlier ones. Pure transitive closures double their paths each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.algebra import positional
from ..operators.pattern import ANY
from ..sources.scratch import Table
from ..values import RelationError
from .rules import Atom, Constant, Rule, Variable, check, derive, groups, is_recursive, strata, union_all

Stored = Mapping[str, DataFrame] | Callable[[str], DataFrame]


class Evaluation:
    """The relations of a rule set over stored facts; what isn't asked for isn't derived. computed: relations that are made as they are
    scanned (functions.computed.Computed), by name; an atom's constants are their bound arguments."""

    def __init__(self, rules: Iterable[Rule], stored: Stored, computed: Mapping | None = None):
        self.computed = computed or {}
        self.rules = list(rules)
        for r in self.rules:
            check(r)
        self.strata = strata(self.rules)
        self.groups = {h: g for g in groups(self.rules) for h in g}
        self.stored, self.done = stored, {}

    def facts(self, name: str) -> DataFrame | None:
        try:
            df = self.stored(name) if callable(self.stored) else self.stored[name]
        except KeyError:
            return None
        return None if df is None else positional(df)

    def rows(self, atom: Atom) -> DataFrame:
        """What an atom's relation holds, for a computed one as far as the atom asks for it."""
        if atom.relation in self.computed:
            return positional(self.computed[atom.relation].scan(*(t.value if isinstance(t, Constant) else ANY for t in atom.terms)))
        return self.read(atom.relation)

    def read(self, name: str) -> DataFrame:
        """A relation: its stored facts and what the rules derive, with columns c0, c1, ..."""
        if name in self.done:
            return self.done[name]
        if name not in self.groups:
            facts = self.facts(name)
            if facts is None:
                raise RelationError("E_RELATION", f"no relation {name}")
            self.done[name] = facts
            return facts
        group = self.groups[name]
        own = [r for r in self.rules if r.head.relation in group]
        if is_recursive(group, own):
            self.done |= fixpoint(group, own, self.facts, self.read, self.rows)
        else:
            facts = self.facts(name)
            like = None if facts is None else facts.schema
            parts = [derive(r, self.rows, like) for r in own]
            self.done[name] = union_all([*([] if facts is None else [facts]), *parts]).distinct()
        return self.done[name]


def evaluate(rules: Iterable[Rule], stored: Stored, *targets: str, computed: Mapping | None = None) -> dict[str, DataFrame]:
    run = Evaluation(rules, stored, computed)
    return {t: run.read(t) for t in targets}


def _fresh(candidates: DataFrame, known: DataFrame | None) -> DataFrame:
    found = candidates.distinct()
    return found if known is None else found.join(known, found.columns, "left_anti")


def fixpoint(group: list[str], rules: list[Rule], facts: Callable[[str], DataFrame | None], read: Callable[[str], DataFrame], rows: Callable[[Atom], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The least relations of a group that hold its facts and satisfy its rules."""
    rows = rows or (lambda a: read(a.relation))
    inner = lambda r: [a for a in r.positive if a.relation in group]
    if (edges := _closure_of(group, rules)) and facts(group[0]) is None:
        return {group[0]: closure(read(edges))}
    seeds: dict[str, list[DataFrame]] = {h: [f] if (f := facts(h)) is not None else [] for h in group}
    for r in rules:
        if not inner(r):
            seeds[r.head.relation].append(derive(r, rows))
    schemas = {h: union_all(s).schema for h, s in seeds.items() if s}
    spark = next(s[0] for s in seeds.values() if s).sparkSession if schemas else None
    waiting = [h for h in group if h not in schemas]
    while waiting:  # a head without seeds takes its types from a rule whose body is known
        rule = next((r for r in rules if r.head.relation in waiting and all(a.relation in schemas for a in inner(r))), None)
        if rule is None:
            raise RelationError("E_RULE", f"{waiting[0]} has nothing to start from")
        schemas[rule.head.relation] = derive(rule, lambda a: spark.createDataFrame([], schemas[a.relation]) if a.relation in group else rows(a)).schema
        waiting.remove(rule.head.relation)
    tables = {h: Table(spark, h.lower()) for h in group}
    new = {}
    for h in group:
        start = union_all(seeds[h]).distinct() if seeds[h] else spark.createDataFrame([], schemas[h])
        tables[h].schema = schemas[h]
        new[h] = tables[h].add(start)
    while any(new.values()):
        delta, full = {h: tables[h].read(last=True) for h in group}, {h: tables[h].read() for h in group}
        candidates: dict[str, list[DataFrame]] = {h: [] for h in group}
        for r in rules:
            for at in inner(r):
                if new[at.relation]:
                    candidates[r.head.relation].append(derive(r, lambda a, at=at: delta[a.relation] if a is at else full[a.relation] if a.relation in group else rows(a), schemas[r.head.relation], first=at))
        new = {h: tables[h].add(_fresh(union_all(c), full[h]) if c else spark.createDataFrame([], schemas[h])) for h, c in candidates.items()}
    return {h: t.read() for h, t in tables.items()}


def _closure_of(group: list[str], rules: list[Rule]) -> str | None:
    """The relation whose transitive closure a group is, if it is one: R(x, y) :- E(x, y) and R(x, z) :- P(x, y), Q(y, z) with P and
    Q from E and R, one of them R."""
    if len(group) != 1 or len(rules) != 2 or any(len(r.head.terms) != 2 or len(r.body) != len(r.positive) for r in rules):
        return None
    plain = lambda a: all(isinstance(t, Variable) for t in a.terms) and len(a.variables) == 2 == len(a.terms)
    seed, step = sorted(rules, key=lambda r: len(r.body))
    if len(seed.body) != 1 or len(step.body) != 2 or not all(plain(a) for r in rules for a in (r.head, *r.body)):
        return None
    e, (p, q) = seed.body[0], step.body
    if e.relation == group[0] or seed.head.terms != e.terms or {p.relation, q.relation} not in ({e.relation, group[0]}, {group[0]}):
        return None
    if (p.terms[0], p.terms[1], q.terms[1]) != (step.head.terms[0], q.terms[0], step.head.terms[1]) or len(p.variables | q.variables) != 3:
        return None
    return e.relation


def closure(edges: DataFrame) -> DataFrame:
    """All pairs that a path of edges connects, in as many rounds as the logarithm of the longest shortest path."""
    table = Table(edges.sparkSession, "closure")
    new = table.add(positional(edges).distinct())
    while new:
        full, delta = table.read(), table.read(last=True)
        step = lambda a, b: a.toDF("c0", "m").join(b.toDF("m", "c1"), "m").select("c0", "c1")
        new = table.add(_fresh(step(delta, full).union(step(full, delta)), full))
    return table.read()


def closure_from(edges: DataFrame, start: DataFrame) -> DataFrame:
    """What a path of edges reaches from each node of start (c0), without the closure of the rest: c0 (start), c1."""
    own = positional(edges).distinct()
    table = Table(edges.sparkSession, "reached")
    new = table.add(positional(start).distinct().join(own, "c0").distinct())
    while new:
        step = table.read(last=True).toDF("c0", "m").join(own.toDF("m", "c1"), "m").select("c0", "c1")
        new = table.add(_fresh(step, table.read()))
    return table.read()


def reaches(edges: DataFrame, source: object, target: object) -> bool:
    """Whether a path of edges, or none, leads from source to target; stops at the round that finds it."""
    if source == target:
        return True
    own = positional(edges).distinct()
    table = Table(edges.sparkSession, "frontier")
    new = table.add(own.filter(F.col("c0") == F.lit(source)).select(F.col("c1").alias("c0")).distinct())
    while new:
        last = table.read(last=True)
        if not last.filter(F.col("c0") == F.lit(target)).isEmpty():
            return True
        new = table.add(_fresh(last.join(own, "c0").select(F.col("c1").alias("c0")), table.read()))
    return False


__all__ = ["Atom", "Evaluation", "closure", "closure_from", "evaluate", "fixpoint", "reaches"]
