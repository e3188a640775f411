"""The catalogue: declared relations and installed rules, and their views as relations."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.rules import Rule, check, parse, show, strata
from ..values import RelationError

POLICIES, DURABILITIES = ("set", "functional", "event_append"), ("durable", "volatile")


@dataclass(frozen=True)
class Relation:
    """schema: column names and Spark types. key: positions that determine a tuple, for functional relations."""

    name: str
    schema: str
    key: tuple[int, ...] = ()
    policy: str = "set"
    durability: str = "durable"
    indexes: tuple[tuple[int, ...], ...] = ()

    def __post_init__(self):
        if self.policy not in POLICIES or self.durability not in DURABILITIES:
            raise RelationError("E_RELATION", f"{self.name}: unknown policy or durability")
        if (self.policy == "functional") != bool(self.key):
            raise RelationError("E_RELATION", f"{self.name}: a functional relation has a key, others have none")
        if any(not 0 <= p < self.arity for p in (*self.key, *(p for i in self.indexes for p in i))):
            raise RelationError("E_ARITY", f"{self.name}: a position is beyond the arity")

    @property
    def struct(self) -> T.StructType:
        return T._parse_datatype_string(self.schema)

    @property
    def columns(self) -> list[str]:
        return self.struct.names

    @property
    def arity(self) -> int:
        return len(self.struct)

    def all_indexes(self) -> list[tuple[int, ...]]:
        """The index of all positions and those that were asked for; to Spark they are hints for partitioning and sorting."""
        return list(dict.fromkeys([tuple(range(self.arity)), *self.indexes]))


@dataclass
class InstalledRule:
    rule: Rule
    active: bool = True


@dataclass
class Catalog:
    relations: dict[str, Relation] = field(default_factory=dict)
    rules: list[InstalledRule] = field(default_factory=list)

    def make_relation(self, name: str, schema: str, **more) -> Relation:
        if name in self.relations:
            raise RelationError("E_RELATION", f"{name} exists")
        self.relations[name] = r = Relation(name, schema, **more)
        return r

    def make_functional_relation(self, name: str, schema: str, key: Iterable[int], **more) -> Relation:
        return self.make_relation(name, schema, key=tuple(key), policy="functional", **more)

    def install(self, text: str) -> list[int]:
        """Installs the rules of a program; all of them or, on an error, none. Returns their numbers."""
        new = parse(text)
        for r in new:
            check(r)
        strata([*self.active(), *new])
        arity = {n: r.arity for n, r in self.relations.items()}
        for r in [*self.active(), *new]:
            for a in (r.head, *(x for x in r.body if hasattr(x, "terms"))):
                if arity.setdefault(a.relation, len(a.terms)) != len(a.terms):
                    raise RelationError("E_ARITY", f"{a.relation} has {arity[a.relation]} columns, not {len(a.terms)}")
        known = set(self.relations) | {r.head.relation for r in [*self.active(), *new]}
        for r in new:
            for a in r.positive + r.negative:
                if a.relation not in known:
                    raise RelationError("E_RELATION", f"no relation {a.relation}")
        self.rules += [InstalledRule(r) for r in new]
        return list(range(len(self.rules) - len(new), len(self.rules)))

    def disable(self, number: int) -> None:
        if not 0 <= number < len(self.rules):
            raise RelationError("E_RULE", f"no rule {number}")
        self.rules[number].active = False

    def active(self) -> list[Rule]:
        return [r.rule for r in self.rules if r.active]

    def describe(self, number: int) -> str:
        return show(self.rules[number].rule)

    def views(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The catalogue as relations."""
        rel = list(self.relations.values())
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        names = {r.name for r in rel}
        derived = [(i.rule.head.relation, len(i.rule.head.terms)) for i in self.rules]
        return {
            "Relation": frame(sorted({(n,) for n in names} | {(h,) for h, _ in derived}), "relation string"),
            "RelationName": frame([(r.name, r.name) for r in rel], "relation string, name string"),
            "Arity": frame(sorted({(r.name, r.arity) for r in rel} | {d for d in derived if d[0] not in names}), "relation string, arity int"),
            "RelationDurability": frame([(r.name, r.durability) for r in rel], "relation string, durability string"),
            "ConflictPolicy": frame([(r.name, r.policy) for r in rel], "relation string, policy string"),
            "ArgumentName": frame([(r.name, i, c) for r in rel for i, c in enumerate(r.columns)], "relation string, position int, name string"),
            "FunctionalKey": frame([(r.name, i, p) for r in rel for i, p in enumerate(r.key)], "relation string, ordinal int, position int"),
            "Index": frame([(r.name, n) for r in rel for n, _ in enumerate(r.all_indexes())], "relation string, index int"),
            "IndexPosition": frame([(r.name, n, i, p) for r in rel for n, x in enumerate(r.all_indexes()) for i, p in enumerate(x)], "relation string, index int, ordinal int, position int"),
            "IndexStorageKind": frame([(r.name, n, "parquet") for r in rel for n, _ in enumerate(r.all_indexes())], "relation string, index int, kind string"),
            "Rule": frame([(n,) for n, _ in enumerate(self.rules)], "rule int"),
            "RuleHead": frame([(n, i.rule.head.relation) for n, i in enumerate(self.rules)], "rule int, relation string"),
            "RuleSource": frame([(n, show(i.rule)) for n, i in enumerate(self.rules)], "rule int, source string"),
            "ActiveRule": frame([(n,) for n, i in enumerate(self.rules) if i.active], "rule int"),
        }
