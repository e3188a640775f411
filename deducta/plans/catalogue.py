"""The queries of the relational engine over the test tables, and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import values
from ..functions import computed, scalars
from ..operators import algebra, dispatch
from ..operators.pattern import ANY, Var, bound, exists, query
from ..sources.scratch import shared_dir, staged
from ..streaming.feed import Replica, follow, stream_of
from . import fixpoint, incremental
from .query_plan import Input, Scan
from .rules import parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(sql: str | None):
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str, *columns: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return df.select(*columns) if columns else df

    def rules(self, text: str, target: str, names: list[str], **stored: DataFrame) -> DataFrame:
        return fixpoint.evaluate(parse(text), stored, target)[target].toDF(*names)


# scans and patterns


@_register("select distinct n_nationkey as k, n_name as n from nation where n_regionkey = 1")
def scan_pattern_const(spark, sf_dir):
    return query(Tables(spark, sf_dir)("nation"), Var("k"), Var("n"), 1)


@_register("select exists(select 1 from supplier where s_nationkey = 15) as found")
def exists_fact(spark, sf_dir):
    found = exists(Tables(spark, sf_dir)("supplier", "s_suppkey", "s_nationkey"), ANY, 15)
    return spark.range(1).select(F.lit(found).alias("found"))


@_register("select distinct l_partkey as k from lineitem where l_partkey = l_suppkey")
def repeated_var(spark, sf_dir):
    return query(Tables(spark, sf_dir)("lineitem", "l_partkey", "l_suppkey"), Var("k"), Var("k"))


@_register("select distinct c_nationkey as nation from customer")
def wildcard_projection(spark, sf_dir):
    return query(Tables(spark, sf_dir)("customer", "c_custkey", "c_nationkey"), ANY, Var("nation"))


@_register("select distinct l_partkey as p, l_suppkey as s from lineitem where l_returnflag = 'R' and l_linenumber = 1")
def dynamic_scan(spark, sf_dir):
    terms = {"l_returnflag": "R", "l_linenumber": 1, "l_partkey": Var("p"), "l_suppkey": Var("s")}
    df = Tables(spark, sf_dir)("lineitem", "l_partkey", "l_suppkey", "l_returnflag", "l_linenumber")
    return query(df, *(terms.get(c, ANY) for c in df.columns))


# projection and predicates


@_register("select distinct o_orderstatus, o_orderpriority from orders")
def project_names(spark, sf_dir):
    return algebra.project(Tables(spark, sf_dir)("orders"), "o_orderstatus", "o_orderpriority")


@_register("select distinct n_regionkey as c0, n_nationkey as c1, n_regionkey as c2 from nation")
def project_positions(spark, sf_dir):
    return Scan("nation").project(2, 0, 2).to_df(Tables(spark, sf_dir))


@_register("select 1::bigint as rows_found, 0::bigint as rows_missing")
def project_zero_columns(spark, sf_dir):
    nation = Tables(spark, sf_dir)("nation")
    n = algebra.project(nation).count(), algebra.project(nation.filter("n_nationkey < 0")).count()
    return spark.range(1).select(F.lit(n[0]).cast("long").alias("rows_found"), F.lit(n[1]).cast("long").alias("rows_missing"))


@_register("select distinct o_orderkey as k from orders where o_totalprice < 2000")
def guard_lt(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rules("Cheap(k) :- Orders(k, p), p < 2000", "Cheap", ["k"], Orders=t("orders", "o_orderkey", "o_totalprice"))


@_register("select distinct p_partkey as k, p_brand as b from part where p_size <> 15 and p_brand <> 'Brand#13'")
def guard_ne(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rules('Other(k, b) :- Part(k, b, s), s != 15, b != "Brand#13"', "Other", ["k", "b"], Part=t("part", "p_partkey", "p_brand", "p_size"))


@_register("select distinct n_nationkey as k, 'nation' as kind, 1 as version from nation where n_regionkey = 2")
def head_constants(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rules('Tagged(k, "nation", 1) :- Nation(k, r), r = 2', "Tagged", ["k", "kind", "version"], Nation=t("nation", "n_nationkey", "n_regionkey"))


# joins


@_register("select c_custkey as c0, c_nationkey as c1, n_nationkey as c2, n_name as c3 from customer join nation on c_nationkey = n_nationkey")
def join_eq(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return Input(t("customer", "c_custkey", "c_nationkey")).join(Input(t("nation", "n_nationkey", "n_name")), [1], [0]).to_df({})


@_register("select distinct a.l_orderkey as o, a.l_suppkey as s, a.l_linenumber as n, b.l_linenumber as m from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_suppkey = b.l_suppkey where a.l_linenumber < b.l_linenumber")
def join_multi_key(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rules("Twice(o, s, n, m) :- Line(o, s, n), Line(o, s, m), n < m", "Twice", ["o", "s", "n", "m"], Line=t("lineitem", "l_orderkey", "l_suppkey", "l_linenumber"))


@_register("select a.r_regionkey as c0, a.r_name as c1, b.r_regionkey as c2, b.r_name as c3 from region a, region b")
def cross_product(spark, sf_dir):
    r = Tables(spark, sf_dir)("region")
    return algebra.product(r, r)


@_register("select distinct n_nationkey, n_name, n_regionkey, r_name from nation join region on n_regionkey = r_regionkey")
def natural_join_shared(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return algebra.natural_join(t("nation"), algebra.rename(t("region"), {"r_regionkey": "n_regionkey"}))


@_register("select distinct r_regionkey, r_name, o_orderstatus from region, (select distinct o_orderstatus from orders)")
def natural_join_disjoint(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return algebra.natural_join(t("region"), algebra.project(t("orders"), "o_orderstatus"))


@_register("select o_orderkey, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem)")
def semi_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return algebra.semi_join(t("orders", "o_orderkey", "o_custkey"), t("lineitem", "l_orderkey"), [0], [0])


@_register("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def anti_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return algebra.anti_join(t("orders", "o_orderkey", "o_custkey"), t("lineitem", "l_orderkey"), [0], [0])


@_register("select distinct a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey where a.s_acctbal < b.s_acctbal")
def theta_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rules("Poorer(a, b) :- S(a, n, x), S(b, n, y), x < y", "Poorer", ["a", "b"], S=t("supplier", "s_suppkey", "s_nationkey", "s_acctbal"))


# set operations


@_register("select o_orderkey as k from orders union select l_orderkey from lineitem")
def set_union(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return algebra.union(t("orders").select(F.col("o_orderkey").alias("k")), t("lineitem").select(F.col("l_orderkey").alias("k")))


@_register("select o_orderkey as k from orders except select l_orderkey from lineitem")
def set_difference(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return algebra.difference(t("orders").select(F.col("o_orderkey").alias("k")), t("lineitem").select(F.col("l_orderkey").alias("k")))


@_register("select o_orderkey as k from orders intersect select l_orderkey from lineitem")
def set_intersect(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return algebra.natural_join(t("orders").select(F.col("o_orderkey").alias("k")), t("lineitem").select(F.col("l_orderkey").alias("k")))


@_register("select distinct l_partkey as c0 from lineitem where l_returnflag = 'R' union select p_partkey from part where p_size = 1 except select l_partkey from lineitem where l_returnflag = 'A'")
def plan_set_ops(spark, sf_dir):
    t = Tables(spark, sf_dir)
    flagged = lambda f: Input(bound(t("lineitem", "l_partkey", "l_returnflag"), ANY, f)).project(0)
    return flagged("R").union(Input(t("part", "p_partkey", "p_size").filter("p_size = 1")).project(0)).difference(flagged("A")).to_df({})


# rules


@_register("select distinct r_name as r, s_suppkey as s from region join nation on r_regionkey = n_regionkey join supplier on s_nationkey = n_nationkey")
def rule_three_atoms(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rules("At(r, s) :- Region(k, r), Nation(n, k), Supplier(s, n)", "At", ["r", "s"], Region=t("region"), Nation=t("nation", "n_nationkey", "n_regionkey"), Supplier=t("supplier", "s_suppkey", "s_nationkey"))


@_register("select distinct doc_id as d from documents where doc_id not in (select doc_id from labels)")
def rule_negation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rules("Unlabelled(d) :- Document(d), not Label(d)", "Unlabelled", ["d"], Document=t("documents", "doc_id"), Label=t("labels", "doc_id"))


@_register("select o_custkey as u from orders union select user_id from events")
def rule_union_heads(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rules("Active(u) :- Buyer(u)\nActive(u) :- Seen(u)", "Active", ["u"], Buyer=t("orders", "o_custkey"), Seen=t("events", "user_id"))


@_register(
    """with returned as (select distinct o_custkey as c from orders join lineitem on o_orderkey = l_orderkey where l_returnflag = 'R'),
    loyal as (select distinct o_custkey as c from orders where o_custkey not in (select c from returned))
    select c_custkey as c from customer where c_custkey not in (select c from loyal)"""
)
def rule_strata_two_level(spark, sf_dir):
    t = Tables(spark, sf_dir)
    text = 'Returned(c) :- Orders(o, c), Line(o, "R")\nLoyal(c) :- Orders(o, c), not Returned(c)\nWatch(c) :- Customer(c), not Loyal(c)'
    return t.rules(text, "Watch", ["c"], Orders=t("orders", "o_orderkey", "o_custkey"), Line=t("lineitem", "l_orderkey", "l_returnflag"), Customer=t("customer", "c_custkey"))


@_register(
    """select distinct c_custkey as actor, o_orderkey as item from customer join orders on c_custkey = o_custkey
    join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'HOUSEHOLD' and l_returnflag = 'R' and o_orderpriority <> '5-LOW'"""
)
def visible_items(spark, sf_dir):
    """The flagship: two joins, an anti-join and a projection in one rule."""
    t = Tables(spark, sf_dir)
    text = 'Visible(a, i) :- Segment(a, "HOUSEHOLD"), Owns(i, a, p), Line(i, "R"), not Hidden(p)'
    hidden = spark.range(1).select(F.lit("5-LOW").alias("p"))
    return t.rules(text, "Visible", ["actor", "item"], Segment=t("customer", "c_custkey", "c_mktsegment"), Owns=t("orders", "o_orderkey", "o_custkey", "o_orderpriority"), Line=t("lineitem", "l_orderkey", "l_returnflag"), Hidden=hidden)


_TREE_SQL = "select p_partkey as c, p_partkey // 2 as p from part where p_partkey > 1"
_CLOSURE = "with recursive e(a, b) as ({e}), r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) "


def _tree(t: Tables) -> DataFrame:
    return t("part").filter("p_partkey > 1").select(F.col("p_partkey").alias("c"), F.expr("p_partkey div 2").alias("p"))


@_register(_CLOSURE.format(e=_TREE_SQL) + "select a as child, b as ancestor from r")
def tc_linear_tree(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rules("Up(c, a) :- Parent(c, a)\nUp(c, a) :- Parent(c, p), Up(p, a)", "Up", ["child", "ancestor"], Parent=_tree(t))




#: Cycles of 16 keys over all of part, so that a closure has 16 rows for each part.
_CYCLES_SQL = "select p_partkey as a, p_partkey // 16 * 16 + (p_partkey + 1) % 16 as b from part"


def _cycles(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 16 * 16 + (p_partkey + 1) % 16").alias("b"))


@_register(_CLOSURE.format(e=_CYCLES_SQL) + "select a, b from r")
def tc_cyclic(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rules("R(x, y) :- E(x, y)\nR(x, z) :- E(x, y), R(y, z)", "R", ["a", "b"], E=_cycles(t))


@_register(_CLOSURE.format(e=_CYCLES_SQL) + "select a, b from r")
def tc_nonlinear(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.rules("R(x, y) :- E(x, y)\nR(x, z) :- R(x, y), R(y, z)\nS(x, y) :- R(x, y)", "S", ["a", "b"], E=_cycles(t))


@_register(
    """with recursive d(k, n) as (select 1::bigint, 0 union all select p_partkey, n + 1 from d join part on p_partkey // 2 = k where p_partkey > 1)
    select distinct k from d where n % 2 = 0"""
)
def mutual_recursion(spark, sf_dir):
    t = Tables(spark, sf_dir)
    root = spark.range(1).select(F.lit(1).cast("long").alias("k"))
    return t.rules("Even(x) :- Root(x)\nEven(x) :- Parent(x, y), Odd(y)\nOdd(x) :- Parent(x, y), Even(y)", "Even", ["k"], Parent=_tree(t), Root=root)


@_register(
    """with recursive r(k) as (select 1::bigint union select p_partkey from r join part on p_partkey // 2 = k where p_partkey > 1 and p_size <> 7)
    select k from r"""
)
def recursion_with_lower_negation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    root = spark.range(1).select(F.lit(1).cast("long").alias("k"))
    text = "Blocked(x) :- Size(x, 7)\nReach(x) :- Root(x)\nReach(x) :- Reach(y), Parent(x, y), not Blocked(x)"
    return t.rules(text, "Reach", ["k"], Parent=_tree(t), Root=root, Size=t("part", "p_partkey", "p_size"))



@_register("with recursive r(k) as (select * from (select distinct l_partkey from lineitem) union select r.k // 2 from r where r.k > 1) select k from r")
def extensional_recursive_head(spark, sf_dir):
    t = Tables(spark, sf_dir)
    stored = t("lineitem").select("l_partkey").distinct()
    return t.rules("Marked(p) :- Marked(c), Parent(c, p)", "Marked", ["k"], Parent=_tree(t), Marked=stored)


@_register(
    _CLOSURE.format(e=_TREE_SQL)
    + """, down as (select p_partkey as k from part where p_size = 50)
    select k from down union select a from r where b in (select k from down)"""
)
def dependency_impact(spark, sf_dir):
    t = Tables(spark, sf_dir)
    # only what is unavailable is asked about, so reachability starts there and not from all pairs
    text = "Affected(x) :- Unavailable(x)\nAffected(x) :- Direct(x, y), Affected(y)"
    return t.rules(text, "Affected", ["k"], Direct=_tree(t), Unavailable=t("part").filter("p_size = 50").select("p_partkey"))



@_register("with recursive r(a, b) as (select p_partkey, p_partkey // 2 from part where p_partkey > 1 union select r.a, r.b // 2 from r where r.b > 1) select a as child, b as ancestor from r")
def delegation_closure(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return fixpoint.closure_from(_tree(t), t("part").select("p_partkey")).toDF("child", "ancestor")


@_register("select true as up, false as down")
def delegation_reaches(spark, sf_dir):
    tree = _tree(Tables(spark, sf_dir))
    return spark.range(1).select(F.lit(fixpoint.reaches(tree, 96, 3)).alias("up"), F.lit(fixpoint.reaches(tree, 3, 96)).alias("down"))


@_register(_CLOSURE.format(e=_CYCLES_SQL) + "select a, b from r where a <> b")
def tc_nonlinear_guarded(spark, sf_dir):
    """A non-linear body with a guard, which semi-naive rounds evaluate (no shortcut of the closure)."""
    t = Tables(spark, sf_dir)
    return t.rules("R(x, y) :- E(x, y), x != y\nR(x, z) :- R(x, y), R(y, z), x != z", "R", ["a", "b"], E=_cycles(t))


# updates, by the store


def _store(spark: SparkSession, name: str, schema: str, start: DataFrame, **more):
    """A store in the shared folder with one bulk-loaded relation, version 1."""
    from ..sources.store import Store

    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.make_relation(name, schema, **more)
    store.bulk_load(name, start)
    return store


@_register("select c_custkey as c, coalesce(last, c_mktsegment) as s from customer left join (select o_custkey, max_by(o_orderpriority, o_orderkey) as last from orders where o_orderkey % 3 = 0 group by o_custkey) on c_custkey = o_custkey")
def functional_replace(spark, sf_dir):
    """Rows take the place of those with their keys."""
    t = Tables(spark, sf_dir)
    start = t("customer").select("c_custkey", "c_mktsegment")
    store = _store(spark, "Segment", "c long, s string", start, key=(0,), policy="functional")
    new = t("orders").filter("o_orderkey % 3 = 0").groupBy("o_custkey").agg(F.max_by("o_orderpriority", "o_orderkey").alias("s"))
    store.transact(lambda x: x.replace("Segment", new.join(start, new.o_custkey == start.c_custkey, "left_semi")))
    return store.read("Segment")


@_register("select distinct l_orderkey as o, l_linenumber as n, l_returnflag as f from lineitem where not (l_returnflag = 'A' and l_linenumber = 2)")
def retract_pattern(spark, sf_dir):
    store = _store(spark, "Line", "o long, n int, f string", Tables(spark, sf_dir)("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))
    store.transact(lambda x: x.retract_pattern("Line", ANY, 2, "A"))
    return store.read("Line")


@_register("with cur as (select distinct o_custkey as k from orders where o_orderstatus = 'O'), want as (select distinct o_custkey as k from orders where o_orderstatus = 'F') select '+' as op, k from want where k not in (select k from cur) union all select '-', k from cur where k not in (select k from want)")
def reconcile(spark, sf_dir):
    """The changes that make a relation equal to a set, as they were committed."""
    t = Tables(spark, sf_dir)
    of = lambda s: t("orders").filter(F.col("o_orderstatus") == s).select("o_custkey")
    store = _store(spark, "Buyer", "k long", of("O"))
    store.transact(lambda x: x.reconcile("Buyer", of("F")))
    return store.changes("Buyer", 1).select("op", "k")


def _placed(t: Tables) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))


@_register("select o_orderkey as k, o_custkey as c from orders where not (o_orderkey % 5 = 0) union select o_orderkey, o_custkey + 1 from orders where o_orderkey % 7 = 0")
def txn_overlay_read(spark, sf_dir):
    """What a transaction reads that has written and not committed."""
    base = _placed(Tables(spark, sf_dir))
    x = _store(spark, "Placed", "k long, c long", base).begin()
    x.retract("Placed", base.filter("k % 5 = 0"))
    x.assert_("Placed", base.filter("k % 7 = 0").select("k", F.col("c") + 1))
    return x.read("Placed")


@_register("select o_orderkey as k, o_custkey as c from orders where o_orderkey % 6 = 0")
def set_conflict(spark, sf_dir):
    """Of two writers of one snapshot the first retracted tuples (even keys) that the second asserts (keys divisible by three)."""
    base = _placed(Tables(spark, sf_dir))
    store = _store(spark, "Placed", "k long, c long", base)
    second = store.begin()
    store.transact(lambda x: x.retract("Placed", base.filter("k % 2 = 0")))
    second.assert_("Placed", base.filter("k % 3 = 0"))
    return second.set_conflicts("Placed", store.version)


@_register("select c_custkey as k from customer where c_custkey % 4 = 0 and c_custkey % 10 = 0")
def functional_conflict(spark, sf_dir):
    """Keys that both of two writers changed."""
    base = Tables(spark, sf_dir)("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    store = _store(spark, "At", "k long, v int", base, key=(0,), policy="functional")
    second = store.begin()
    store.transact(lambda x: x.replace("At", base.filter("k % 4 = 0").select("k", F.col("v") + 100)))
    second.replace("At", base.filter("k % 10 = 0").select("k", F.lit(-1)))
    return second.functional_conflicts("At", store.version)


def _event_log(spark: SparkSession, sf_dir: str):
    """events as commits: even ones are loaded, odd ones asserted, and errors retracted."""
    rows = Tables(spark, sf_dir)("events").select(F.col("user_id").alias("u"), F.col("event_id").alias("e"), "event_type")
    store = _store(spark, "Event", "u long, e long", rows.filter("e % 2 = 0").select("u", "e"))
    store.transact(lambda x: x.assert_("Event", rows.filter("e % 2 = 1").select("u", "e")))
    store.transact(lambda x: x.retract("Event", rows.filter("event_type = 'error'").select("u", "e")))
    return store


@_register("select 2::bigint as version, '+' as op, user_id as u, event_id as e from events where event_id % 2 = 1 union all select 3, '-', user_id, event_id from events where event_type = 'error'")
def change_feed_since(spark, sf_dir):
    return _event_log(spark, sf_dir).changes("Event", 1).select("version", "op", "u", "e")


@_register("select user_id as u, event_id as e from events where event_type <> 'error'")
def replay_log(spark, sf_dir):
    """The state that a store comes back with: its load and the changes since."""
    from ..sources.store import Store

    return Store(spark, _event_log(spark, sf_dir).root).read("Event")


# incremental maintenance: the state after a delta must equal that of a full evaluation


def _order_deltas(t: Tables):
    orders = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return orders.filter("k % 10 <> 3"), orders.filter("k % 10 = 3"), orders.filter("k % 10 = 7")


@_register("select distinct n_name as n, o_orderkey as k from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderkey % 10 <> 7 and n_regionkey = 1")
def incr_counting_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    old, more, less = _order_deltas(t)
    rules = parse("J(n, k) :- Nation(x, n, 1), Customer(c, x), Orders(k, c)")
    m = incremental.Maintained(rules, {"Orders": old, "Customer": t("customer", "c_custkey", "c_nationkey"), "Nation": t("nation")}, ["J"])
    m.advance({"Orders": incremental.delta(more, less)})
    return m.read("J").toDF("n", "k")


def _label_deltas(t: Tables):
    """Labels as first known (not toxic), those that come later, and those that are withdrawn."""
    labels = t("labels", "doc_id", "quality", "toxic")
    return labels.filter("toxic = 0"), labels.filter("toxic = 1"), labels.filter("toxic = 0 and quality = 0")


@_register("select doc_id as d from documents where doc_id not in (select doc_id from labels where toxic = 1 or quality = 1)")
def incr_negation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    old, more, less = _label_deltas(t)
    rules = parse("Labelled(d) :- Label(d, q, x)\nUnlabelled(d) :- Document(d), not Labelled(d)")
    m = incremental.Maintained(rules, {"Label": old, "Document": t("documents", "doc_id")}, ["Unlabelled"])
    m.advance({"Label": incremental.delta(more, less)})
    return m.read("Unlabelled").toDF("d")


@_register(_CLOSURE.format(e=_TREE_SQL.replace("p_partkey > 1", "p_partkey > 1 and p_size <> 5")) + "select a as child, b as ancestor from r")
def incr_recursive_delete(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tree = _tree(t)
    rules = parse("Up(c, a) :- Parent(c, a)\nUp(c, a) :- Parent(c, p), Up(p, a)")
    m = incremental.Maintained(rules, {"Parent": tree}, ["Up"])
    m.advance({"Parent": incremental.delta(None, tree.join(t("part").filter("p_size = 5").select(F.col("p_partkey").alias("c")), "c"))})
    return m.read("Up").toDF("child", "ancestor")


@_register("select doc_id as d, 1::bigint as w from labels where toxic = 1 union all select doc_id, -1 from labels where toxic = 0 and quality = 0")
def zero_crossings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    old, more, less = _label_deltas(t)
    m = incremental.Maintained(parse("Labelled(d) :- Label(d, q, x)"), {"Label": old}, ["Labelled"])
    return m.advance({"Label": incremental.delta(more, less)})["Labelled"].toDF("d", "w")


# computed relations


@_register(
    """with q as (select embedding as v from embeddings where vec_id = 0), s as (select label, max(list_dot_product(embedding::double[], v::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(v::double[], v::double[])))) as score from embeddings, q group by label)
    select label as subject, round(score, 5) as score from s order by score desc, label limit 5"""
)
def nearest_embedding(spark, sf_dir):
    e = Tables(spark, sf_dir)("embeddings")
    rel = computed.nearest_embedding(e.select(F.lit("all").alias("i"), "vec_id"), e.select("vec_id", "label"), e.select("vec_id", "embedding"))
    found = rel.scan("all", 0, 5, Var("subject"), Var("score"), ANY)
    return found.select("subject", F.round(F.col("score").cast("double"), 5).alias("score"))


def _units(t: Tables) -> DataFrame:
    d = t("documents")
    return d.select(F.lit("corpus").alias("repository"), F.col("doc_id").alias("unit"), F.lit(1).alias("ordinal"), F.lit("prose").alias("kind"), F.concat(F.col("lang"), F.lit(" "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(".txt")).alias("path"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), F.lit("text").alias("model"), F.concat(F.lit("head\n"), "text").alias("text"))


_AL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _search_sql(q: str, terms: list[str]) -> str:
    has = lambda c, x, n: f"case when contains({c}, '{x}') then {n} else 0 end"
    score = " + ".join([has("p", q, 260), has("t", q, 210), has("b", q, 120)] + [x for w in terms for x in (f"case when f = '{w}' then 240 when contains(f, '{w}') then 180 else 0 end", has("p", w, 110), has("t", w, 95), has("b", w, 55))])
    return f"""with u as (select doc_id as unit, {_AL.format("source || '/' || lang || '.txt'")} as p, {_AL.format("lang || ' ' || doc_id")} as t, {_AL.format("text")} as b, {_AL.format("lang || '.txt'")} as f, source || '/' || lang || '.txt' as path, text from documents),
    s as (select unit, ({score})::int as score, path from u) select unit, score, path from s where score > 0"""


@_register(_search_sql("thea oner", ["oner", "thea"]))
def text_search(spark, sf_dir):
    found = computed.text_search(_units(Tables(spark, sf_dir)), "Thea oner", None)
    return found.select("unit", "score", "path")


_NONE_BLANK = "trim(regexp_replace(body, '\\s+', ' ', 'g')) <> ''"


@_register(
    f"""with l as (select doc_id, unnest(string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10))) as line, generate_subscripts(string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)), 1) - 1 as n from documents where text <> ''),
    c as (select doc_id, n // 3 as k, min(n) + 1 as a, max(n) + 1 as b, string_agg(line, chr(10) order by n) as body from l group by all)
    select doc_id as path, (row_number() over (partition by doc_id order by k))::int as ordinal, a::int as start_line, b::int as end_line, body as text from c where {_NONE_BLANK}"""
)
def text_units_by_lines(spark, sf_dir):
    """Units bounded by lines alone, which SQL can express."""
    d = Tables(spark, sf_dir)("documents").select(F.lit("corpus").alias("repository"), F.col("doc_id").alias("path"), "text")
    return computed.text_units(d, lines=3, size=1 << 30).select("path", "ordinal", "start_line", "end_line", "text")


@_register(None)
def text_units(spark, sf_dir):
    """Units of at most 40 lines and 1,200 bytes; where a unit ends depends on those before it, so there is no oracle."""
    d = Tables(spark, sf_dir)("documents").select(F.lit("corpus").alias("repository"), F.col("doc_id").alias("path"), "text")
    return computed.text_units(d).select("path", "ordinal", "start_line", "end_line", "text")


@_register("select doc_id as path, generate_subscripts(string_split(text, chr(10)), 1)::int as line, unnest(string_split(text, chr(10))) as text from documents where text <> ''")
def file_lines(spark, sf_dir):
    return computed.file_lines(Tables(spark, sf_dir)("documents"), "doc_id", "text")


@_register("select doc_id as path, case when text = '' then 0 else len(string_split(text, chr(10))) end::int as lines from documents")
def line_count(spark, sf_dir):
    return computed.file_line_count(Tables(spark, sf_dir)("documents"), "doc_id", "text")


@_register("select doc_id as path, sha256(text) as sha256 from documents")
def content_hash(spark, sf_dir):
    return computed.file_content_hash(Tables(spark, sf_dir)("documents"), "doc_id", "text")


def _facts(t: Tables) -> dict[str, DataFrame]:
    return {"Nation": t("nation", "n_nationkey", "n_name", "n_regionkey"), "Supplier": t("supplier", "s_suppkey", "s_nationkey"), "Customer": t("customer", "c_custkey", "c_nationkey")}


_FACTS_SQL = {"Nation": ("nation", ["n_nationkey", "n_name", "n_regionkey"]), "Supplier": ("supplier", ["s_suppkey", "s_nationkey"]), "Customer": ("customer", ["c_custkey", "c_nationkey"])}


def _mention_sql(positions: list[int] | None, with_position: bool) -> str:
    parts = []
    for rel, (tab, cols) in _FACTS_SQL.items():
        cells = " || '|' || ".join(f"'\"' || {c} || '\"'" if c.endswith("name") else f"{c}::varchar" for c in cols)
        parts += [f"select '{rel}' as relation, {f'{i} as position, ' if with_position else ''}{cells} as tuple from {tab} where {c} = 1" for i, c in enumerate(cols) if not c.endswith("name") and (positions is None or i in positions)]
    return " union ".join(parts)


@_register(_mention_sql([0], False))
def subject_facts(spark, sf_dir):
    return computed.subject_facts(_facts(Tables(spark, sf_dir)), 1).withColumn("tuple", F.array_join("tuple", "|"))


@_register(_mention_sql(None, True))
def mentioned_facts(spark, sf_dir):
    return computed.mentioned_facts(_facts(Tables(spark, sf_dir)), 1).withColumn("tuple", F.array_join("tuple", "|"))


#: The state of the orders' store (see _orders_store).
_SETTLED_SQL = "select o_orderkey as k, case when o_orderkey % 7 = 0 then o_custkey + 1 else o_custkey end as c from orders where o_orderkey % 5 <> 0"


@_register(
    """with base as (select o_orderkey as k, o_custkey as c from orders) select 'Orders' as relation, 1 as position, k || '|' || c as tuple from base where c = 7
    union select 'Orders', 0, k || '|' || c from base where k = 7"""
)
def extensional_mentioned_facts(spark, sf_dir):
    """Stored facts that hold 7 at any position; what rules derive isn't looked at."""
    store = _store(spark, "Orders", "k long, c long", _placed(Tables(spark, sf_dir)))
    store.install("Buyer(c) :- Orders(k, c)")
    return computed.extensional_mentioned_facts(store, 7).withColumn("tuple", F.array_join("tuple", "|"))


@_register("with f as (select doc_id, lang, octet_length(encode(text)) as n from documents) select doc_id as path, n::bigint as bytes from f where n > 2000 and lang = 'en'")
def rule_computed_atom(spark, sf_dir):
    """A rule over a stored relation and a computed one: such rules are always evaluated in full."""
    t = Tables(spark, sf_dir)
    rules, size = parse('Large(p, n) :- Language(p, "en"), FileSize(p, n), n > 2000'), _file_size(t)
    return fixpoint.evaluate(rules, {"Language": t("documents", "doc_id", "lang")}, "Large", computed={"FileSize": size})["Large"].toDF("path", "bytes")


def _file_size(t: Tables) -> computed.Computed:
    return computed.Computed("FileSize", ("path", "bytes"), (), lambda _: t("documents").select(F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("bytes")))


@_register("select case when doc_id % 10 = 3 then -1 else 1 end::bigint as w, doc_id as path, octet_length(encode(text))::bigint as bytes from documents where octet_length(encode(text)) > 2000 and lang = 'en' and doc_id % 10 in (3, 7)")
def incr_computed_fallback(spark, sf_dir):
    """Changes of a rule with a computed atom, which has no deltas: both states are evaluated in full. Of the languages those of keys ending
    in 7 come and those ending in 3 go."""
    t = Tables(spark, sf_dir)
    rules, size, lang = parse('Large(p, n) :- Language(p, "en"), FileSize(p, n), n > 2000'), {"FileSize": _file_size(t)}, t("documents", "doc_id", "lang")
    changed = incremental.by_evaluation(rules, {"Language": lang.filter("doc_id % 10 <> 7")}, {"Language": lang.filter("doc_id % 10 <> 3")}, "Large", size)
    return changed.select(F.col("w__").alias("w"), F.col("c0").alias("path"), F.col("c1").alias("bytes"))


@_register(f"with old as (select distinct o_custkey as c from orders), new as (select distinct c from ({_SETTLED_SQL})) select '+' as op, c from new where c not in (select c from old) union all select '-', c from old where c not in (select c from new)")
def derived_changes(spark, sf_dir):
    """What a relation that rules derive has gained and lost over the commits of a store."""
    store = _orders_store(spark, sf_dir)
    store.install("Buyer(c) :- Orders(k, c)")
    return store.settled("Buyer", 1).toDF("op", "c")


_DECLARED = [("Customer", 2, "set"), ("Label", 2, "functional"), ("Nation", 3, "set"), ("Seen", 1, "event_append")]


@_register("select * from (values ('At', 2), " + ", ".join(f"('{n}', {a})" for n, a, _ in _DECLARED) + ") v(relation, arity)")
def catalog_relations(spark, sf_dir):
    from ..sources.catalog import Catalog
    from ..sources.program import load_text

    c = Catalog()
    load_text(c, "relation Nation(k int, n string, r int)\nrelation Customer(k long, n int)\nrelation Label(d long, q int) key 0\nrelation Seen(u long) event_append volatile\nAt(c, n) :- Customer(c, k), Nation(k, n, r)")
    return c.views(spark)["Arity"]


# dispatch


def _dispatch_tables(spark: SparkSession):
    frame = spark.createDataFrame
    selectors = frame([("open_any", "open"), ("open_box", "open"), ("open_locked", "open"), ("open_with", "open"), ("look", "look")], "method string, selector string")
    params = frame([("open_any", "item", "thing", 0), ("open_box", "item", "box", 0), ("open_locked", "item", "locked_box", 0), ("open_with", "item", "box", 0), ("open_with", "tool", "*", 1), ("look", "item", "*", 0)], "method string, role string, restriction string, position int")
    delegates = frame([("crate", "locked_box", 0), ("locked_box", "box", 0), ("box", "thing", 0), ("key", "thing", 0)], "child string, parent string, ord int")
    calls = frame([(1, "open"), (2, "open"), (3, "look")], "call int, selector string")
    arguments = frame([(1, "item", "crate", "Identity", None), (2, "item", "box", "Identity", None), (2, "tool", "key", "Identity", None), (3, "item", "5", "Int", None)], "call int, role string, value string, prototype string, delegate string")
    return selectors, params, calls, arguments, dispatch.reach(delegates)


@_register("select * from (values (1, 'open_any'), (1, 'open_box'), (1, 'open_locked'), (2, 'open_any'), (2, 'open_box'), (2, 'open_with'), (3, 'look')) v(call, method)")
def dispatch_applicable(spark, sf_dir):
    selectors, params, calls, arguments, up = _dispatch_tables(spark)
    return dispatch.applicable(selectors, params, calls, arguments, up)


@_register("select * from (values (1, 'open_locked'), (2, 'open_with'), (3, 'look')) v(call, method)")
def dispatch_most_specific(spark, sf_dir):
    selectors, params, calls, arguments, up = _dispatch_tables(spark)
    return dispatch.most_specific(staged(dispatch.applicable(selectors, params, calls, arguments, up)), params, up)


# scalars


@_register(
    """select p_partkey as k, length(p_name)::int as len, array_to_string(string_split(p_name, ''), '-') as chars, p_name || '/' || p_brand as joined,
    starts_with(p_name, 'b') as starts, contains(p_name, 'ee') as has, lower(p_brand) = lower(upper(p_brand)) as fold, lower(p_type) as low from part"""
)
def scalar_strings(spark, sf_dir):
    s = scalars
    return Tables(spark, sf_dir)("part").select(F.col("p_partkey").alias("k"), s.string_len("p_name").alias("len"), s.string_join(s.string_chars("p_name"), "-").alias("chars"), s.string_concat("p_name", F.lit("/"), "p_brand").alias("joined"), s.string_starts_with("p_name", "b").alias("starts"), s.string_contains("p_name", "ee").alias("has"), s.string_equal_fold("p_brand", F.upper("p_brand")).alias("fold"), s.lower("p_type").alias("low"))


@_register("select p_partkey as k, substring(p_name, 2, 3) as part, p_name as same from part")
def scalar_slice(spark, sf_dir):
    s = scalars
    return Tables(spark, sf_dir)("part").select(F.col("p_partkey").alias("k"), s.string_slice("p_name", 1, 4).alias("part"), s.string_from_chars(s.string_chars("p_name")).alias("same"))


@_register("select page_id as k, url_encode(url) as enc, url as back from pages")
def scalar_urlenc(spark, sf_dir):
    s = scalars
    return Tables(spark, sf_dir)("pages").select(F.col("page_id").alias("k"), s.url_encode_component("url").alias("enc"), s.url_decode_component(s.url_encode_component("url")).alias("back"))


@_register("select p_partkey as k, levenshtein(p_name, p_type)::int as d from part")
def scalar_edit_distance(spark, sf_dir):
    return Tables(spark, sf_dir)("part").select(F.col("p_partkey").alias("k"), scalars.edit_distance("p_name", "p_type").alias("d"))



@_register(None)
def scalar_words(spark, sf_dir):
    """Every document, those with quotes and backslashes too; SQL has no such splitting, so there is no oracle."""
    return Tables(spark, sf_dir)("documents").select(F.col("doc_id").alias("k"), F.size(scalars.words("text")).alias("n"))


@_register("select n_nationkey as k, (n_nationkey + 1)::bigint as ordinal from nation")
def scalar_ordinal(spark, sf_dir):
    n = Tables(spark, sf_dir)("nation").withColumn("i", F.col("n_nationkey") + 1)
    names = {1: "first", 2: "2nd", 3: "Third", 4: "4.", 5: "5th", 20: "twentieth", 21: "twenty-first", 22: "22"}
    text = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), "i"), F.concat(F.col("i").cast("string"), F.lit("th")))
    return n.select(F.col("n_nationkey").alias("k"), scalars.parse_ordinal(text).alias("ordinal"))


@_register("select event_id as k, (props->>'$.k')::bigint as v, json_extract(props, '$.none') is null as missing from events")
def scalar_json(spark, sf_dir):
    return Tables(spark, sf_dir)("events").select(F.col("event_id").alias("k"), F.from_json("props", "struct<k:bigint>").getField("k").alias("v"), scalars.json_is_null("props", "$.none").alias("missing"))


@_register("select s_suppkey as k, array_to_string(list_sort([s_suppkey % 7, s_suppkey % 5, s_suppkey % 3]), ',') as sorted, [s_suppkey % 7, s_suppkey % 5, s_suppkey % 3][2] as second, -1::bigint as missing from supplier")
def scalar_lists(spark, sf_dir):
    v = F.array(*[F.col("s_suppkey") % n for n in (7, 5, 3)])
    return Tables(spark, sf_dir)("supplier").select(F.col("s_suppkey").alias("k"), F.array_join(scalars.sort(v).cast("array<string>"), ",").alias("sorted"), scalars.index(v, 1).alias("second"), scalars.index_or(v, 3, F.lit(-1).cast("long")).alias("missing"))


@_register(
    """with t as (select doc_id, text as t from documents where text <> ''), c as (select doc_id, (unicode(unnest(string_split(t, ''))) + generate_subscripts(string_split(t, ''), 1) - 1) % 8 as b from t),
    n as (select doc_id, b, count(*) as n from c group by all), s as (select doc_id, sqrt(sum(n * n)) as l from n group by all)
    select doc_id as k, b::int as bucket, round(n / l, 6) as v from n join s using (doc_id)"""
)
def embed_text(spark, sf_dir):
    d = Tables(spark, sf_dir)("documents").select("doc_id", "text")
    return d.select(F.col("doc_id").alias("k"), F.posexplode(scalars.embed_text("text")).alias("bucket", "v")).filter("v > 0").withColumn("v", F.round("v", 6))


@_register("select p_partkey as k, case when (p_partkey * p_size) % 7 = 0 then (p_partkey * p_size) // 7 end as whole, case when (p_partkey * p_size) % 7 <> 0 then round((p_partkey * p_size) / 7.0, 2)::double end as real from part")
def arith_div_exact(spark, sf_dir):
    part = Tables(spark, sf_dir)("part")
    product = values.arithmetic("*", F.col("p_partkey"), part.schema["p_partkey"].dataType, F.col("p_size"), part.schema["p_size"].dataType)
    found = part.select("p_partkey", values.divide(product, F.lit(7)).alias("d"))
    return found.select(F.col("p_partkey").alias("k"), F.col("d.whole").alias("whole"), F.round(F.col("d.real").cast("double"), 2).alias("real"))


@_register("select l_orderkey as o, l_linenumber as n, l_linenumber = l_quantity as eq, l_linenumber < l_quantity as lt, l_partkey >= l_extendedprice as ge from lineitem")
def numeric_compare(spark, sf_dir):
    li = Tables(spark, sf_dir)("lineitem")
    cmp = lambda op, a, b: values.compare(op, F.col(a), li.schema[a].dataType, F.col(b), li.schema[b].dataType)
    return li.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), cmp("=", "l_linenumber", "l_quantity").alias("eq"), cmp("<", "l_linenumber", "l_quantity").alias("lt"), cmp(">=", "l_partkey", "l_extendedprice").alias("ge"))


# streaming


@_register("select u from (select user_id as u, arg_max(event_type, event_id) as last from events group by user_id) where last <> 'error'")
def stream_apply_changes(spark, sf_dir):
    """events as a stream of changes, applied batch by batch to a replica."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = stream_of(spark, f"{sf_dir}/events.parque[t]", schema, maxFilesPerTrigger=4)  # a pattern, as the table may be one file
    changes = stream.select(F.col("user_id").alias("u"), F.when(F.col("event_type") == "error", "-").otherwise("+").alias("op"), F.col("event_id").alias("version"))
    replica = Replica(spark.createDataFrame([], "u long"))
    follow(changes, lambda batch, _: replica.apply(batch), f"{shared_dir(spark)}/cursor-{uuid.uuid4().hex}")
    return replica.read()


# the store


def _orders_store(spark: SparkSession, sf_dir: str):
    """A store in the shared folder: orders are bulk loaded; version 2 retracts keys divisible by 5, version 3 moves those by 7 to the
    next customer and names the priorities of a few."""
    from ..sources.store import Store

    t = Tables(spark, sf_dir)
    base = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.make_relation("Orders", "k long, c long")
    store.make_relation("Priority", "k long, p string", key=(0,), policy="functional")
    store.bulk_load("Orders", base)
    store.transact(lambda x: x.retract("Orders", base.filter("k % 5 = 0")))

    def work(x) -> None:
        moved = base.filter("k % 7 = 0 and k % 5 <> 0")
        x.retract("Orders", moved)
        x.assert_("Orders", moved.select("k", F.col("c") + 1))
        x.replace("Priority", t("orders").filter("o_orderkey % 100 = 1").select("o_orderkey", "o_orderpriority"))

    store.transact(work)
    return store


_STORE_SQL = "select o_orderkey as k, case when o_orderkey % 7 = 0 then o_custkey + 1 else o_custkey end as c from orders where o_orderkey % 5 <> 0"


@_register(_STORE_SQL)
def store_read(spark, sf_dir):
    return _orders_store(spark, sf_dir).read("Orders")


@_register(_STORE_SQL)
def stream_store_replica(spark, sf_dir):
    """A replica that follows the commits of a store as a stream."""
    from ..streaming.feed import follow_relation

    store = _orders_store(spark, sf_dir)
    replica = Replica(spark.createDataFrame([], "k long, c long"))
    follow_relation(store, "Orders", lambda changes, _: replica.apply(changes), f"{shared_dir(spark)}/cursor-{uuid.uuid4().hex}")
    return replica.read()


@_register("select o_orderkey as k, o_custkey as c from orders where o_orderkey % 5 <> 0")
def store_time_travel(spark, sf_dir):
    return _orders_store(spark, sf_dir).read("Orders", 2)


@_register("select '-' as op, o_orderkey as k, o_custkey as c from orders where o_orderkey % 5 <> 0 and o_orderkey % 7 = 0 union all select '+', o_orderkey, o_custkey + 1 from orders where o_orderkey % 5 <> 0 and o_orderkey % 7 = 0")
def subscription_changes(spark, sf_dir):
    from ..streaming.feed import subscribe

    return subscribe(_orders_store(spark, sf_dir), "Orders", since=2).poll()


@_register(f"select k, c, o_orderpriority as p from ({_STORE_SQL}) join orders on o_orderkey = k where k % 100 = 1")
def store_rules(spark, sf_dir):
    """Rules over stored relations."""
    store = _orders_store(spark, sf_dir)
    store.install("Known(k, c, p) :- Orders(k, c), Priority(k, p)")
    return store.derived().read("Known").toDF("k", "c", "p")



@_register(f"select distinct c from ({_STORE_SQL})")
def store_materialized(spark, sf_dir):
    store = _orders_store(spark, sf_dir)
    store.make_relation("Buyer", "c long")
    store.install("Buyer(c) :- Orders(k, c)")
    store.materialize("Buyer")
    return store.read("Buyer")


@_register("select * from (values (1, 'open_any'), (1, 'open_box'), (1, 'open_locked'), (2, 'open_with')) v(call, method)")
def dispatch_positional(spark, sf_dir):
    selectors, params, calls, arguments, up = _dispatch_tables(spark)
    placed = arguments.filter("call < 3").join(params.select("role", "position").distinct(), "role").select("call", F.col("position").cast("string").alias("role"), "value", "prototype", "delegate")
    return dispatch.applicable(selectors, params.withColumn("position", F.col("position").cast("string")), calls.filter("call < 3"), placed, up, by="position", exact=True)


@_register("select doc_id as path, octet_length(encode(text))::int as bytes, case when text = '' then 0 else len(string_split(text, chr(10))) end::int as lines, sha256(text) as sha256 from documents where source = 'src3'")
def indexed_files(spark, sf_dir):
    from ..sources.text_index import Provider, Sources

    sources = Sources(spark)
    sources.register(Provider("documents", "documents", Tables(spark, sf_dir)("documents").select(F.col("source").alias("repository"), F.col("doc_id").alias("path"), "text")))
    sources.build("main", "src3", "1", "documents")
    (files,) = (c for c in sources.relations() if c.name == "IndexedFile")
    return files.scan("main", *[ANY] * 5).select("path", "bytes", "lines", "sha256")


__all__ = ["ORACLE_SQL", "QUERIES"]
