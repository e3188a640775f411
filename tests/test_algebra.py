import pytest

from deducta.operators import algebra as A
from deducta.operators.pattern import ANY, Var, at_most_one, dot, exactly, exists, query, visit
from deducta.plans.query_plan import Input, Scan
from deducta.values import RelationError

from .conftest import rows


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(1, 2), (2, 3), (2, 4), (3, 3)], "a long, b long")


def test_projection_is_a_set_and_may_repeat(edge):
    assert rows(A.project(edge, "a")) == {(1,), (2,), (3,)}
    assert rows(A.project_at(edge, [1, 0, 1])) == {(2, 1, 2), (3, 2, 3), (4, 2, 4), (3, 3, 3)}
    with pytest.raises(RelationError, match="no column z"):
        A.project(edge, "z")
    with pytest.raises(RelationError):
        A.project_at(edge, [2])


def test_zero_columns(edge, spark):
    unit, none = A.project(edge), A.project(edge.filter("a > 9"))
    assert unit.count() == 1 and none.count() == 0
    assert A.union(unit, none).count() == 1 and A.difference(unit, unit).count() == 0 and A.difference(unit, none).count() == 1
    assert A.intersect(unit, none).count() == 0 and A.natural_join(unit, edge).count() == 4 and A.natural_join(none, edge).count() == 0


def test_joins(edge, spark):
    label = spark.createDataFrame([(3, "x"), (4, "y"), (9, "z")], "k long, l string")
    assert rows(A.join_eq(edge, label, [1], [0])) == {(2, 3, 3, "x"), (3, 3, 3, "x"), (2, 4, 4, "y")}
    assert A.product(edge, label).count() == 12
    assert rows(A.semi_join(edge, label, [1], [0])) == {(2, 3), (2, 4), (3, 3)}
    assert rows(A.anti_join(edge, label, [1], [0])) == {(1, 2)}
    assert A.semi_join(edge, label, [], []).count() == 4 and A.anti_join(edge, label, [], []).count() == 0
    with pytest.raises(RelationError):
        A.join_eq(edge, label, [0, 1], [0])


def test_kinds_do_not_mix(edge, spark):
    real = spark.createDataFrame([(2.0,)], "k double")
    with pytest.raises(RelationError, match="E_TYPE"):
        A.join_eq(edge, real, [1], [0])


def test_natural_join(edge, spark):
    other = spark.createDataFrame([(2, 5), (3, 6)], "b long, c long")
    assert rows(A.natural_join(edge, other).select("a", "b", "c")) == {(1, 2, 5), (2, 3, 6), (3, 3, 6)}
    assert rows(A.natural_join(edge, edge.filter("a = 2"))) == {(2, 3), (2, 4)}
    assert A.natural_join(edge, spark.createDataFrame([(0,)], "z int")).count() == 4


def test_set_operations_match_by_name(edge, spark):
    swapped = spark.createDataFrame([(2, 1), (9, 9)], "b long, a long")
    assert rows(A.union(edge, swapped)) == {(1, 2), (2, 3), (2, 4), (3, 3), (9, 9)}
    assert rows(A.difference(edge, swapped)) == {(2, 3), (2, 4), (3, 3)}
    with pytest.raises(RelationError, match="headings"):
        A.union(edge, swapped.withColumnRenamed("a", "z"))


def test_patterns(edge):
    assert rows(query(edge, Var("x"), Var("x"))) == {(3,)}
    assert rows(query(edge, 2, Var("y"))) == {(3,), (4,)}
    assert rows(query(edge, ANY, Var("y"))) == {(2,), (3,), (4,)}
    assert query(edge, 2, 3).count() == 1 and query(edge, 2, 9).count() == 0
    assert exists(edge, 1, ANY) and not exists(edge, 1, 9) and not exists(edge, "1", ANY)
    assert exactly(edge, 1, Var("y"))["y"] == 2 and at_most_one(edge, 7, Var("y")) is None and dot(edge, 1) == 2
    for read in (exactly, at_most_one):
        with pytest.raises(RelationError, match="E_CARDINALITY"):
            read(edge, 2, Var("y"))
    seen = []
    visit(edge, lambda r: seen.append(r) or False)
    assert len(seen) == 1


def test_plans(edge):
    plan = Scan("Edge", (ANY, 3)).project(0).union(Scan("Edge").project(1)).difference(Input(edge.filter("a = 2")).project(1))
    assert rows(plan.to_df({"Edge": edge})) == {(2,)}
    walk = Scan("Edge").join(Scan("Edge"), [1], [0]).project(0, 3)
    assert rows(walk.to_df({"Edge": edge})) == {(1, 3), (1, 4), (2, 3), (3, 3)}
    assert rows(Scan("Edge").anti_join(Scan("Edge"), [1], [0]).to_df({"Edge": edge})) == {(2, 4)}
    assert rows(Scan("Edge").semi_join(Scan("Edge"), [1], [0]).to_df({"Edge": edge})) == {(1, 2), (2, 3), (3, 3)}
    with pytest.raises(RelationError):
        Scan("Nope").to_df({"Edge": edge})


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = query(spark.read.parquet(f"{sf_dir}/nation.parquet"), Var("k"), ANY, 1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(n_regionkey,1)" in plan and "ReadSchema: struct<n_nationkey:int,n_regionkey:int>" in plan
