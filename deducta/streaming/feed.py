"""Subscriptions: committed changes as a stream, and replicas that apply them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.algebra import positional
from ..operators.pattern import ANY, Var, bound
from ..sources.scratch import staged
from ..sources.store import Store

RESYNCHRONIZE, REVOKED = "resynchronize", "revoked"


def change_stream(store: Store, commits_per_batch: int | None = None) -> DataFrame:
    """The commits of a store as a streaming DataFrame of versions, from their manifests; what a failed writer left has none."""
    read = store.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.json")
    if commits_per_batch:
        read = read.option("maxFilesPerTrigger", commits_per_batch)
    return read.load(f"{store.root}/commits").select(F.regexp_extract("path", r"([0-9]+)\.json$", 1).cast("int").alias("version"))


def follow_relation(store: Store, relation: str, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, commits_per_batch: int | None = None):
    """Runs apply(changes, batch number) for the changes of a relation in each batch of commits: its columns, op and version."""

    def batch(versions: DataFrame, number: int) -> None:
        found = sorted(r["version"] for r in versions.collect())  # a row for each new commit
        for v in found:
            if store.committed(relation, v - 1, v):
                apply(store.changes(relation, v - 1, v), number)

    return follow(change_stream(store, commits_per_batch), batch, checkpoint, once)


def fold(changes: DataFrame, columns: list[str], order: str = "version") -> DataFrame:
    """The last op of each tuple: columns and op."""
    return changes.groupBy(*columns).agg(F.max_by("op", order).alias("op"))


#: Batches that a replica keeps apart before it folds them into one table.
FOLD_AFTER = 16


class Replica:
    """A copy of a relation that batches of changes keep up to date. It remembers the last change of each tuple, so batches may come
    again or out of order. A batch costs its own size: it is folded by itself and kept; every FOLD_AFTER batches all are
    folded into one table."""

    def __init__(self, start: DataFrame, version: int = 0):
        self.columns = start.columns
        self.parts = [start.withColumns({"op": F.lit("+"), "version": F.lit(version).cast("long")})]

    def _folded(self, parts: list[DataFrame]) -> DataFrame:
        last = reduce(DataFrame.unionByName, parts).groupBy(*self.columns).agg(F.max(F.struct("version", "op")).alias("l"))
        return last.select(*self.columns, "l.op", "l.version")

    def apply(self, changes: DataFrame) -> None:
        """changes: the columns, op and version."""
        new = changes.select(*self.columns, "op", F.col("version").cast("long").alias("version"))
        self.parts.append(staged(self._folded([new]), "replica"))
        if len(self.parts) > FOLD_AFTER:
            self.parts = [staged(self._folded(self.parts), "replica")]

    @property
    def last(self) -> DataFrame:
        """The columns and the last op and version of each tuple that was ever there."""
        return self._folded(self.parts)

    def read(self) -> DataFrame:
        return self.last.filter("op = '+'").select(*self.columns)


def follow(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs apply(batch, batch number) for each batch of a stream of changes. The checkpoint is the cursor: a later call goes on there."""
    query = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    running = query.trigger(availableNow=True).start() if once else query.start()
    if once:
        running.awaitTermination()
    return running


@dataclass
class Subscription:
    """A relation's facts, then its changes; of a relation that rules derive, what each poll's commits came to. terms: constants, Var or ANY for each position. allowed is asked before every poll."""

    store: Store
    relation: str
    terms: tuple = ()
    limit: int | None = None
    allowed: Callable[[], bool] = lambda: True
    cursor: int | None = None
    closed: bool = False

    @property
    def _derived(self) -> bool:
        return self.relation not in self.store.catalog.relations

    def _fields(self) -> list[T.StructField]:
        return self.store.derived().read(self.relation).schema.fields if self._derived else self.store.relation(self.relation).struct.fields

    def _match(self, df: DataFrame) -> DataFrame:
        columns = self._fields()
        return bound(df, *(self.terms or [ANY] * len(columns)), *[ANY] * (len(df.columns) - len(columns)))

    def poll(self) -> DataFrame:
        """Rows op and the columns: at first the whole snapshot as asserts, later what was committed since. More changes than limit
        give one row with op resynchronize, and the next poll a snapshot; without authority one row revoked, then nothing."""
        store, fields = self.store, self._fields()
        names = [f.name for f in fields]
        version = store.version = store._last()
        mark = lambda op: store.spark.createDataFrame([(op, *[None] * len(fields))], T.StructType([T.StructField("op", T.StringType()), *(T.StructField(f.name, f.dataType) for f in fields)]))
        if self.closed:
            return mark(REVOKED).limit(0)
        if not self.allowed():
            self.closed = True
            return mark(REVOKED)
        if self.cursor is None:
            out = self._match(store.derived(version).read(self.relation) if self._derived else store.read(self.relation, version)).select(F.lit("+").alias("op"), *names)
        else:
            if self._derived:  # what the commits came to, op moved behind the columns
                changes = self._match(store.settled(self.relation, self.cursor, version).select(*names, "op").withColumn("version", F.lit(version)))
            else:
                changes = self._match(store.changes(self.relation, self.cursor, version))
            if self.limit is not None and changes.limit(self.limit + 1).count() > self.limit:
                self.cursor = None
                return mark(RESYNCHRONIZE)
            out = changes.orderBy("version").select("op", *names)
        self.cursor = version
        return out


def subscribe(store: Store, relation: str, *terms: object, since: int | None = None, limit: int | None = None, allowed: Callable[[], bool] = lambda: True) -> Subscription:
    """since: a version to resume from; without it the first poll is a snapshot."""
    return Subscription(store, relation, terms, limit, allowed, since)


def catalogue_changes(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """view, op, tuple: how the catalogue's views changed."""
    parts = []
    for name, df in after.items():
        old = before[name]
        literal = lambda d: positional(d).select(F.to_json(F.array(*[F.col(c).cast("string") for c in positional(d).columns])).alias("tuple"))
        parts += [literal(df.subtract(old)).select(F.lit(name).alias("view"), F.lit("+").alias("op"), "tuple"), literal(old.subtract(df)).select(F.lit(name).alias("view"), F.lit("-").alias("op"), "tuple")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def stream_of(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """A folder of Parquet files as a stream."""
    read = spark.readStream.schema(schema)
    for k, v in options.items():
        read = read.option(k, v)
    return read.parquet(path)


__all__ = ["ANY", "Replica", "Subscription", "Var", "catalogue_changes", "change_stream", "follow", "follow_relation", "fold", "stream_of", "subscribe"]
