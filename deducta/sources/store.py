"""A versioned store of relations: a change log of commits in Parquet, snapshots, and optimistic transactions.

    root/catalog/00000003.json            relations and rules as of a version
    root/log/Edge/version=4/ID/part-*.parquet   changes of a commit: the columns and op, + or -
    root/snapshots/Edge/data-ID/          a whole relation
    root/snapshots/Edge/00000004-ID       says that data-ID is the relation as of a version; written when the data is there
    root/commits/00000004.json            a commit's manifest: for each relation the ID of its changes, or of a first load

A commit writes its changes first and its manifest last; the manifest is created without overwriting, so of two
writers of one version one fails and validates again. What no manifest or mark names hasn't happened, whatever a failed
writer left behind; a load's snapshot counts if the manifest of its version names it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pattern import bound
from ..plans.fixpoint import Evaluation
from ..values import RelationError, persistable
from .catalog import Catalog, InstalledRule, Relation
from .program import program_text
from .scratch import staged

#: Versions of a relation's log after which reading starts from a new snapshot.
COMPACT_AFTER = 8


class Conflict(RelationError):
    def __init__(self, relation: str, what: str):
        super().__init__("E_CONFLICT", f"{relation}: {what}")
        self.relation = relation


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.volatile: dict[str, DataFrame] = {}
        self._manifests: dict[int, dict] = {}  # they never change
        self.version = self._last()
        self.catalog = self._load_catalog()

    # files

    def _list(self, *at: str) -> list[str]:
        p = self._path("/".join((self.root, *at)))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _write(self, text: str, *at: str) -> bool:
        """Creates a file; False if it is there."""
        p = self._path("/".join((self.root, *at)))
        try:
            out = self._fs.create(p, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _read(self, *at: str) -> str:
        stream = self._fs.open(self._path("/".join((self.root, *at))))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _last(self) -> int:
        names = [n for n in self._list("commits") if n.endswith(".json")]
        return int(names[-1][:-5]) if names else 0

    def _load_catalog(self) -> Catalog:
        names = [n for n in self._list("catalog") if n.endswith(".json")]
        if not names:
            return Catalog()
        data = json.loads(self._read("catalog", names[-1]))
        out = Catalog({r["name"]: Relation(r["name"], r["schema"], tuple(r["key"]), r["policy"], r["durability"], tuple(map(tuple, r["indexes"]))) for r in data["relations"]})
        for text, active in data["rules"]:
            from ..plans.rules import parse

            out.rules.append(InstalledRule(parse(text)[0], active))
        return out

    def save_catalog(self) -> None:
        names = [n for n in self._list("catalog") if n.endswith(".json")]
        n = int(names[-1][:-5]) + 1 if names else 1
        data = {"relations": [{"name": r.name, "schema": r.schema, "key": r.key, "policy": r.policy, "durability": r.durability, "indexes": r.indexes} for r in self.catalog.relations.values()], "rules": [(self.catalog.describe(i), x.active) for i, x in enumerate(self.catalog.rules)]}
        if not self._write(json.dumps(data), "catalog", f"{n:08d}.json"):
            raise RelationError("E_CONFLICT", "the catalogue was changed meanwhile")

    def make_relation(self, name: str, schema: str, **more) -> Relation:
        out = self.catalog.make_relation(name, schema, **more)
        self.save_catalog()
        return out

    def install(self, text: str) -> list[int]:
        out = self.catalog.install(text)
        self.save_catalog()
        return out

    def disable(self, rule: int) -> None:
        self.catalog.disable(rule)
        self.save_catalog()

    def program(self) -> str:
        return program_text(self.catalog)

    # reading

    def relation(self, name: str) -> Relation:
        if name not in self.catalog.relations:
            raise RelationError("E_RELATION", f"no relation {name}")
        return self.catalog.relations[name]

    def manifest(self, version: int) -> dict:
        """What a commit wrote. A writer that has just created it gets a moment to fill it."""
        if version not in self._manifests:
            for left in reversed(range(100)):
                text = self._read("commits", f"{version:08d}.json")
                if text.endswith("}") or not left:
                    break
                time.sleep(0.05)
            self._manifests[version] = json.loads(text)
        return self._manifests[version]

    def _snapshots(self, name: str) -> list[tuple[int, str]]:
        """Versions and IDs of the published snapshots of a relation. A load's mark ends in .load."""
        out = []
        for mark in self._list("snapshots", name):
            if mark.startswith("data-"):
                continue
            version, _, key = mark.removesuffix(".load").partition("-")
            if not mark.endswith(".load") or int(version) <= self._last() and self.manifest(int(version)).get("loaded", {}).get(name) == key:
                out.append((int(version), key))
        return sorted(out)

    def _snapshot(self, name: str, version: int) -> tuple[int, str | None]:
        """The last snapshot up to a version; 0 and None without one."""
        return max((x for x in self._snapshots(name) if x[0] <= version), default=(0, None))

    def _changed(self, name: str, after: int, upto: int) -> list[tuple[int, str]]:
        """Versions that changed a relation, and the folders of their changes."""
        found = ((v, self.manifest(v)) for v in range(after + 1, upto + 1))
        return [(v, f"{self.root}/log/{name}/version={v}/{m['relations'][name]}" if name in m["relations"] else f"{self.root}/snapshots/{name}/data-{m['loaded'][name]}") for v, m in found if name in m["relations"] or name in m.get("loaded", {})]

    def committed(self, name: str, after: int, upto: int) -> list[int]:
        """Versions that changed a relation; leftovers of commits that failed have no manifest and don't count."""
        return [v for v, _ in self._changed(name, after, upto)]

    def changes(self, name: str, after: int = 0, upto: int | None = None) -> DataFrame:
        """The committed changes of a relation in versions after .. upto: its columns, op and version. Other versions' files aren't listed."""
        r = self.relation(name)
        logged = T.StructType([*r.struct.fields, T.StructField("op", T.StringType())])
        parts = []
        for v, folder in self._changed(name, after, self.version if upto is None else upto):
            rows = self.spark.read.schema(logged).parquet(folder) if "/log/" in folder else self.spark.read.schema(r.struct).parquet(folder).withColumn("op", F.lit("+"))
            parts.append(rows.withColumn("version", F.lit(v).cast("long")))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], T.StructType([*logged.fields, T.StructField("version", T.LongType())]))

    def net_changes(self, name: str, after: int, upto: int) -> DataFrame:
        """Tuples that are in one of two versions only, and op: + or -. Only what was committed between is read."""
        since = self.changes(name, after, upto).groupBy(*self.relation(name).columns).agg(F.min_by("op", "version").alias("first"), F.max_by("op", "version").alias("op"))
        return since.filter("first = op").drop("first")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A stored relation as of a version: the last snapshot before it and, for each tuple, the last change since."""
        r = self.relation(name)
        if r.durability == "volatile":
            return self.volatile.get(name, self.spark.createDataFrame([], r.struct))
        version = self.version if version is None else version
        at, key = self._snapshot(name, version)
        base = self.spark.read.schema(r.struct).parquet(f"{self.root}/snapshots/{name}/data-{key}") if key else self.spark.createDataFrame([], r.struct)
        if not self.committed(name, at, version):
            return base
        last = self.changes(name, at, version).groupBy(*r.columns).agg(F.max_by("op", "version").alias("op"))
        return base.join(last, r.columns, "left_anti").union(last.filter("op = '+'").drop("op"))

    def derived(self, version: int | None = None) -> Evaluation:
        """All relations with what the rules derive."""
        return Evaluation(self.catalog.active(), lambda n: self.read(n, version) if n in self.catalog.relations else None)

    def settled(self, name: str, after: int, upto: int | None = None) -> DataFrame:
        """op and the columns of what a relation gained and lost between two versions; one that rules derive is evaluated at both."""
        upto = self.version if upto is None else upto
        if not any(r.head.relation == name for r in self.catalog.active()):
            return self.net_changes(name, after, upto).select("op", *self.relation(name).columns)
        old, new = self.derived(after).read(name), self.derived(upto).read(name)
        return new.subtract(old).select(F.lit("+").alias("op"), "*").union(old.subtract(new).select(F.lit("-").alias("op"), "*"))

    def since(self, version: int) -> list[dict]:
        """Manifests of the commits after a version."""
        return [self.manifest(v) for v in range(version + 1, self._last() + 1)]

    # writing

    def begin(self) -> Transaction:
        self.version = self._last()
        return Transaction(self)

    def transact(self, work: Callable[[Transaction], object], tries: int = 5) -> object:
        """Runs work in a transaction and commits; on a conflict again from a new snapshot."""
        for left in reversed(range(tries)):
            t = self.begin()
            out = work(t)
            try:
                t.commit()
                return out
            except Conflict:
                if not left:
                    raise
        return None

    def bulk_load(self, name: str, df: DataFrame) -> int:
        """Fills an empty relation: written as its first snapshot, without a log."""
        r, before = self.relation(name), self._last()
        if self._snapshots(name) or self.committed(name, 0, before):
            raise RelationError("E_RELATION", f"{name} isn't empty")
        v, key = before + 1, uuid.uuid4().hex
        self._checked(r, df).write.parquet(f"{self.root}/snapshots/{name}/data-{key}")
        self._write("", "snapshots", name, f"{v:08d}-{key}.load")
        if not self._write(json.dumps({"version": v, "relations": {}, "loaded": {name: key}}), "commits", f"{v:08d}.json"):
            raise Conflict(name, "another commit came first")
        self.version = v
        return v

    def _checked(self, r: Relation, df: DataFrame) -> DataFrame:
        if len(df.columns) != r.arity:
            raise RelationError("E_ARITY", f"{r.name} has {r.arity} columns, not {len(df.columns)}")
        own = df.toDF(*r.columns)
        return persistable(own.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in r.struct.fields))).distinct()

    def compact(self, name: str) -> None:
        """Writes a snapshot of the current version; reads start there. Several writers may do so at once."""
        at, version = self._snapshot(name, self.version)[0], self.version
        if self.committed(name, at, version):
            key = uuid.uuid4().hex
            self.read(name, version).write.parquet(f"{self.root}/snapshots/{name}/data-{key}")
            self._write("", "snapshots", name, f"{version:08d}-{key}")

    def materialize(self, *names: str) -> None:
        """Reconciles stored relations to what the rules derive for them."""
        found = self.derived()

        def work(t: Transaction) -> None:
            for n in names:
                t.reconcile(n, found.read(n))

        self.transact(work)

    def fork(self, root: str) -> Store:
        """A copy of the current version that goes its own way."""
        out = Store(self.spark, root)
        out.catalog = Catalog(dict(self.catalog.relations), [InstalledRule(r.rule, r.active) for r in self.catalog.rules])
        out.save_catalog()
        for n, r in self.catalog.relations.items():
            if r.durability == "durable":
                out.bulk_load(n, self.read(n))
            else:
                out.volatile[n] = self.read(n)
        return out


class Transaction:
    """Reads its snapshot and its own writes; nothing is visible to others before commit."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.version
        self.writes: dict[str, DataFrame] = {}  # columns and op: the last word on each tuple
        self.replaced: dict[str, DataFrame] = {}

    def _add(self, name: str, df: DataFrame, op: str) -> None:
        r = self.store.relation(name)
        new = self.store._checked(r, df).withColumn("op", F.lit(op))
        old = self.writes.get(name)
        self.writes[name] = new if old is None else old.join(new.select(*r.columns), r.columns, "left_anti").unionByName(new)

    def assert_(self, name: str, df: DataFrame) -> None:
        """Adds tuples; those that are there stay. In a functional relation a key with another tuple is an error at commit."""
        self._add(name, df, "+")

    def retract(self, name: str, df: DataFrame) -> None:
        """Takes tuples out; those that aren't there are no error."""
        self._add(name, df, "-")

    def retract_pattern(self, name: str, *terms: object) -> None:
        self.retract(name, staged(bound(self.read(name), *terms)))

    def replace(self, name: str, df: DataFrame) -> None:
        """Functional replacement: tuples take the place of those with their keys."""
        r = self.store.relation(name)
        if not r.key:
            raise RelationError("E_RELATION", f"{name} has no key")
        keys = [r.columns[k] for k in r.key]
        new = staged(self.store._checked(r, df))
        if not new.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise RelationError("E_CARDINALITY", f"{name}: a key is given twice")
        old = staged(self.read(name).join(new.select(*keys), keys, "left_semi").join(new, r.columns, "left_anti"))
        self.retract(name, old)
        self.assert_(name, new)

    def reconcile(self, name: str, desired: DataFrame) -> None:
        """Makes a relation equal to a set, by the changes that needs."""
        r = self.store.relation(name)
        want, have = staged(self.store._checked(r, desired)), staged(self.read(name))
        self.retract(name, have.join(want, r.columns, "left_anti"))
        self.assert_(name, want.join(have, r.columns, "left_anti"))

    def destroy_identity(self, value: object, kind: str = "int") -> None:
        """Retracts every fact that mentions a value."""
        from ..values import kind_of

        for name, r in self.store.catalog.relations.items():
            at = [c for c, f in zip(r.columns, r.struct.fields, strict=True) if kind_of(f.dataType) == kind]
            if at:
                mention = F.lit(False)
                for c in at:
                    mention = mention | (F.col(f"`{c}`") == F.lit(value))
                self.retract(name, staged(self.read(name).filter(mention)))

    def read(self, name: str) -> DataFrame:
        r, base = self.store.relation(name), self.store.read(name, self.base)
        own = self.writes.get(name)
        if own is None:
            return base
        return base.join(own, r.columns, "left_anti").union(own.filter("op = '+'").drop("op"))

    def derived(self) -> Evaluation:
        """Rules over the snapshot and the own writes."""
        return Evaluation(self.store.catalog.active(), lambda n: self.read(n) if n in self.store.catalog.relations else None)

    def set_conflicts(self, name: str, current: int) -> DataFrame:
        """Asserted tuples that the snapshot had and the current version has lost."""
        r = self.store.relation(name)
        lost = self.store.net_changes(name, self.base, current).filter("op = '-'")
        return self.writes[name].filter("op = '+'").drop("op").join(lost, r.columns, "left_semi")

    def functional_conflicts(self, name: str, current: int) -> DataFrame:
        """Written keys whose tuple is another in the current version than in the snapshot."""
        r = self.store.relation(name)
        keys = [r.columns[k] for k in r.key]
        moved = self.store.net_changes(name, self.base, current).select(*keys)
        return self.writes[name].select(*keys).distinct().join(moved, keys, "left_semi")

    def _validate(self, name: str, current: int) -> None:
        r = self.store.relation(name)
        if r.durability == "volatile":
            return
        if current > self.base and self.store.committed(name, self.base, current):
            if r.policy == "set" and not self.set_conflicts(name, current).isEmpty():
                raise Conflict(name, "an asserted tuple was retracted meanwhile")
            if r.policy == "functional" and not self.functional_conflicts(name, current).isEmpty():
                raise Conflict(name, "a key was changed meanwhile")
        if r.key:
            keys = [r.columns[k] for k in r.key]
            written = self.writes[name].filter("op = '+'").select(*keys).distinct()  # others had one tuple before
            if not self.read(name).join(written, keys, "left_semi").groupBy(*keys).count().filter("count > 1").isEmpty():
                raise RelationError("E_CARDINALITY", f"{name}: two tuples with one key")

    def visible(self, name: str) -> DataFrame:
        """The writes that change something: asserts of absent tuples and retractions of present ones."""
        r, own = self.store.relation(name), self.writes[name]
        there = staged(self.store.read(name).join(own.select(*r.columns), r.columns, "left_semi"), "there")  # few writes are broadcast, and no base is shuffled
        return own.filter("op = '+'").join(there, r.columns, "left_anti").unionByName(own.filter("op = '-'").join(there, r.columns, "left_semi"))

    def commit(self) -> int:
        """Validates against the current version, writes the changes, then publishes them. A commit without changes makes no version."""
        store = self.store
        self.writes = {n: staged(w) for n, w in self.writes.items()}
        while True:
            current = store._last()
            for name in self.writes:
                self._validate(name, current)
            store.version = current
            effects = {n: staged(self.visible(n)) for n in self.writes}
            effects = {n: e for n, e in effects.items() if not e.isEmpty()}
            for n in [n for n in effects if store.relation(n).durability == "volatile"]:
                r, e, own = store.relation(n), effects.pop(n), store.read(n)
                store.volatile[n] = staged(own.join(e, r.columns, "left_anti").union(e.filter("op = '+'").drop("op")))
            if not effects:
                return current
            v, files = current + 1, {}
            for n, e in effects.items():
                files[n] = uuid.uuid4().hex
                e.write.parquet(f"{store.root}/log/{n}/version={v}/{files[n]}")
            if store._write(json.dumps({"version": v, "relations": files}), "commits", f"{v:08d}.json"):
                break  # else another writer took the version: validate again
        store.version = v
        for n in effects:
            if len(store.committed(n, store._snapshot(n, v)[0], v)) >= COMPACT_AFTER:
                store.compact(n)
        return v
