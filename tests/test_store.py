import pytest
from pyspark.sql import functions as F

from deducta.operators.pattern import ANY
from deducta.sources.catalog import Catalog
from deducta.sources.program import file_in, file_out, load_text, program_text
from deducta.sources.store import Conflict, Store
from deducta.streaming import feed
from deducta.streaming.feed import Replica, follow_relation, subscribe
from deducta.values import RelationError

from .conftest import rows


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db")
    s.make_relation("Edge", "a long, b long")
    s.make_relation("Name", "k long, v string", key=(0,), policy="functional")
    s.make_relation("Seen", "k long", policy="event_append")
    s.make_relation("Temp", "k long", durability="volatile")
    return s


def pairs(spark, *tuples):
    return spark.createDataFrame(list(tuples), "a long, b long")


def names(spark, *tuples):
    return spark.createDataFrame(list(tuples), "k long, v string")


def put(store, relation, df):
    store.transact(lambda t: t.assert_(relation, df))


def test_commit_read_and_recover(store, spark):
    put(store, "Edge", pairs(spark, (1, 2), (2, 3)))
    store.transact(lambda t: t.retract("Edge", pairs(spark, (1, 2), (7, 7))))
    put(store, "Edge", pairs(spark, (3, 4)))
    assert rows(store.read("Edge")) == {(2, 3), (3, 4)}
    assert rows(store.read("Edge", 1)) == {(1, 2), (2, 3)}
    store.compact("Edge")
    again = Store(spark, store.root)
    assert again.version == 3 and rows(again.read("Edge")) == {(2, 3), (3, 4)} and rows(again.read("Edge", 2)) == {(2, 3)}
    assert again.catalog.relations == store.catalog.relations
    assert rows(store.changes("Edge", 1)) == {(1, 2, "-", 2), (3, 4, "+", 3)}
    assert [c["version"] for c in store.since(1)] == [2, 3]


def test_writes_that_change_nothing_make_no_version(store, spark):
    put(store, "Edge", pairs(spark, (1, 2)))
    put(store, "Edge", pairs(spark, (1, 2)))
    store.transact(lambda t: t.retract("Edge", pairs(spark, (9, 9))))
    assert store.version == 1


def test_overlay_patterns_and_reconcile(store, spark):
    put(store, "Edge", pairs(spark, (1, 2), (1, 3), (2, 3)))
    store.install("Reach(x, y) :- Edge(x, y)\nReach(x, z) :- Edge(x, y), Reach(y, z)")
    t = store.begin()
    t.retract_pattern("Edge", 1, ANY)
    t.assert_("Edge", pairs(spark, (3, 4)))
    assert rows(t.read("Edge")) == {(2, 3), (3, 4)} and rows(store.read("Edge")) == {(1, 2), (1, 3), (2, 3)}
    assert rows(t.derived().read("Reach")) == {(2, 3), (3, 4), (2, 4)}
    t.reconcile("Edge", pairs(spark, (2, 3), (5, 6)))
    t.commit()
    assert rows(store.read("Edge")) == {(2, 3), (5, 6)}


def test_functional_relations(store, spark):
    put(store, "Name", names(spark, (1, "a"), (2, "b")))
    store.transact(lambda t: t.replace("Name", names(spark, (1, "c"), (3, "d"))))
    assert rows(store.read("Name")) == {(1, "c"), (2, "b"), (3, "d")}
    with pytest.raises(RelationError, match="E_CARDINALITY"):
        put(store, "Name", names(spark, (1, "z")))


def test_conflicts(store, spark):
    put(store, "Edge", pairs(spark, (1, 2), (3, 4)))
    put(store, "Name", names(spark, (1, "a")))
    first, second, third = store.begin(), store.begin(), store.begin()
    first.retract("Edge", pairs(spark, (1, 2)))
    first.replace("Name", names(spark, (1, "b")))
    first.commit()
    second.assert_("Edge", pairs(spark, (1, 2)))
    with pytest.raises(Conflict):
        second.commit()
    third.replace("Name", names(spark, (1, "c")))
    with pytest.raises(Conflict):
        third.commit()
    tries = []

    def work(t):
        tries.append(t.base)
        if len(tries) == 1:  # another writer comes in between
            other = Store(spark, store.root)
            other.transact(lambda o: o.replace("Name", names(spark, (1, "x"))))
        t.replace("Name", names(spark, (1, "y")))

    store.transact(work)
    assert len(tries) == 2 and rows(store.read("Name")) == {(1, "y")}


def test_event_append_never_conflicts(store, spark):
    one = spark.createDataFrame([(1,)], "k long")
    put(store, "Seen", one)
    a, b = store.begin(), store.begin()
    a.retract("Seen", one)
    a.commit()
    b.assert_("Seen", spark.createDataFrame([(1,), (2,)], "k long"))
    b.commit()
    assert rows(store.read("Seen")) == {(1,), (2,)}


def test_volatile_bulk_fork_and_mentions(store, spark):
    put(store, "Temp", spark.createDataFrame([(5,)], "k long"))
    assert rows(store.read("Temp")) == {(5,)} and Store(spark, store.root).read("Temp").count() == 0
    store.bulk_load("Edge", pairs(spark, (1, 2), (2, 3)))
    with pytest.raises(RelationError):
        store.bulk_load("Edge", pairs(spark, (1, 2)))
    fork = store.fork(f"{store.root}-fork")
    fork.transact(lambda t: t.destroy_identity(2))
    assert fork.read("Edge").count() == 0 and store.read("Edge").count() == 2


def test_cells_are_checked(store, spark):
    for bad in ((None, 1), (1 << 60, 1)):
        with pytest.raises(Exception, match="E_TYPE|E_RANGE"):
            put(store, "Edge", pairs(spark, bad))
    with pytest.raises(RelationError, match="E_ARITY"):
        put(store, "Edge", spark.createDataFrame([(1,)], "a long"))


def test_subscription(store, spark):
    put(store, "Edge", pairs(spark, (1, 2), (2, 3)))
    mine = subscribe(store, "Edge", 1, ANY)
    assert rows(mine.poll()) == {("+", 1, 2)}
    store.transact(lambda t: (t.retract("Edge", pairs(spark, (1, 2))), t.assert_("Edge", pairs(spark, (1, 9), (4, 4)))))
    assert rows(mine.poll()) == {("-", 1, 2), ("+", 1, 9)} and mine.poll().count() == 0
    small = subscribe(store, "Edge", since=0, limit=1)
    assert rows(small.poll()) == {("resynchronize", None, None)} and small.poll().count() == 3
    gone = subscribe(store, "Edge", allowed=lambda: False)
    assert rows(gone.poll()) == {("revoked", None, None)} and gone.poll().count() == 0


def test_change_stream_feeds_a_replica(store, spark, tmp_path):
    put(store, "Edge", pairs(spark, (1, 2), (2, 3)))
    replica = Replica(spark.createDataFrame([], "a long, b long"))
    go = lambda: follow_relation(store, "Edge", lambda b, _: replica.apply(b), f"file://{tmp_path}/cursor")
    go()
    store.transact(lambda t: (t.retract("Edge", pairs(spark, (1, 2))), t.assert_("Edge", pairs(spark, (7, 8)))))
    go()
    assert rows(replica.read()) == rows(store.read("Edge")) == {(2, 3), (7, 8)}


def test_catalogue_and_program_text(spark, tmp_path):
    c = Catalog()
    load_text(c, "relation Edge(a long, b long) index 1, 0\nrelation Name(k long, v string) key 0 volatile\nR(x) :- Edge(x, y)\n")
    with pytest.raises(RelationError, match="E_ARITY"):
        c.install("S(x) :- Edge(x)")
    with pytest.raises(RelationError, match="E_RELATION"):
        c.install("S(x) :- Nowhere(x)")
    c.disable(c.install("S(x) :- R(x)")[0])
    v = c.views(spark)
    assert rows(v["Arity"]) == {("Edge", 2), ("Name", 2), ("R", 1), ("S", 1)} and rows(v["ActiveRule"]) == {(0,)}
    assert rows(v["FunctionalKey"]) == {("Name", 0, 0)} and ("Edge", 1, 0, 1) in rows(v["IndexPosition"])
    file_out(spark, c, f"file://{tmp_path}/program")
    again = Catalog()
    file_in(spark, again, f"file://{tmp_path}/program")
    assert program_text(again) == program_text(c)


def test_materialize(store, spark):
    put(store, "Edge", pairs(spark, (1, 2), (2, 3)))
    store.make_relation("Path", "a long, b long")
    store.install("Path(x, y) :- Edge(x, y)\nPath(x, z) :- Edge(x, y), Path(y, z)")
    store.materialize("Path")
    assert rows(store.read("Path")) == {(1, 2), (2, 3), (1, 3)}


def test_what_failed_writers_left_is_seen_by_nobody(store, spark, tmp_path):
    put(store, "Edge", pairs(spark, (1, 2)))
    other = Store(spark, store.root)
    other.make_relation("Loaded", "a long, b long")
    store.catalog = other.catalog
    write, lost = store._write, []

    def late(text, *at):
        if at[0] == "commits" and not lost:  # another writer publishes this version first
            lost.append(at)
            put(other, "Edge", pairs(spark, (5, 6)))
        return write(text, *at)

    store._write = late
    with pytest.raises(Conflict):
        store.bulk_load("Loaded", pairs(spark, (7, 7)))
    store._write = write
    pairs(spark, (8, 8)).withColumn("op", F.lit("+")).write.parquet(f"{store.root}/log/Edge/version=3/leftover")
    pairs(spark, (9, 9)).write.parquet(f"{store.root}/snapshots/Edge/data-half")  # a compaction that died before its mark
    again = Store(spark, store.root)
    assert again.version == 2 and rows(again.read("Loaded")) == set() and rows(again.read("Edge")) == {(1, 2), (5, 6)}
    replica = Replica(spark.createDataFrame([], "a long, b long"))
    follow_relation(again, "Edge", lambda b, _: replica.apply(b), f"file://{tmp_path}/cursor", commits_per_batch=1)
    assert rows(replica.read()) == {(1, 2), (5, 6)} and rows(again.changes("Edge")) == {(1, 2, "+", 1), (5, 6, "+", 2)}
    again.bulk_load("Loaded", pairs(spark, (4, 4)))
    put(again, "Edge", pairs(spark, (3, 3)))
    assert rows(Store(spark, store.root).read("Loaded")) == {(4, 4)} and rows(again.changes("Loaded")) == {(4, 4, "+", 3)} and rows(again.read("Edge")) == {(1, 2), (5, 6), (3, 3)}


def test_two_compactions_of_a_version(store, spark):
    put(store, "Edge", pairs(spark, (1, 2)))
    a, b = Store(spark, store.root), Store(spark, store.root)
    a.compact("Edge")
    b.compact("Edge")
    again = Store(spark, store.root)
    assert rows(again.read("Edge")) == {(1, 2)} and len(again._snapshots("Edge")) == 1
    put(again, "Edge", pairs(spark, (2, 2)))
    assert rows(a.read("Edge", 1)) == {(1, 2)} and rows(again.read("Edge")) == {(1, 2), (2, 2)}


def test_a_replica_folds_its_batches(spark, monkeypatch):
    monkeypatch.setattr(feed, "FOLD_AFTER", 3)
    replica = Replica(pairs(spark, (0, 0)))
    for v in range(1, 8):
        replica.apply(spark.createDataFrame([(v, v, "+", v), (v - 1, v - 1, "-", v)], "a long, b long, op string, version long"))
    assert rows(replica.read()) == {(7, 7)} and len(replica.parts) <= 3


def test_derived_relations_are_settled_and_followed(store, spark):
    put(store, "Edge", pairs(spark, (1, 2)))
    store.install("Reach(x, y) :- Edge(x, y)\nReach(x, z) :- Edge(x, y), Reach(y, z)")
    mine = subscribe(store, "Reach", 1, ANY)
    assert rows(mine.poll()) == {("+", 1, 2)}
    put(store, "Edge", pairs(spark, (2, 3), (7, 8)))
    assert rows(mine.poll()) == {("+", 1, 3)} and mine.poll().count() == 0
    store.transact(lambda t: t.retract("Edge", pairs(spark, (1, 2))))
    assert rows(store.settled("Reach", 2)) == {("-", 1, 2), ("-", 1, 3)} and rows(store.settled("Edge", 0, 2)) == {("+", 1, 2), ("+", 2, 3), ("+", 7, 8)}
