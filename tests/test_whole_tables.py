"""Registered queries over whole tables."""

import duckdb
import pytest

from deducta.functions.scalars import split_words
from deducta.plans.catalogue import ORACLE_SQL, QUERIES

from .conftest import rows


def oracle(sf_dir, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return set(con.sql(ORACLE_SQL[name]).fetchall())


def test_words_of_every_document(spark, tmp_path):
    texts = ["", "a b", 'say "two words" now', "back\\ slash", '"a \\" b" c', 'open "quote here', "\\", '""', None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.k, r.n) for r in QUERIES["scalar_words"](spark, str(tmp_path)).collect()}
    assert {k for k, _ in got} == set(range(len(texts)))
    assert {(2, 3), (3, 1), (4, 2), (5, 2), (7, 0)} <= got
    assert got - {(8, n) for _, n in got} == {(i, len(split_words(t))) for i, t in enumerate(texts) if t is not None}


def test_the_whole_materialized_relation(spark, sf_dir):
    got = rows(QUERIES["store_materialized"](spark, sf_dir))
    assert got == oracle(sf_dir, "store_materialized") and {c % 2 for (c,) in got} == {0, 1}


@pytest.mark.parametrize("name", ["tc_cyclic", "tc_nonlinear", "tc_nonlinear_guarded", "extensional_recursive_head", "delegation_closure"])
def test_recursion_over_all_rows(spark, sf_dir, name):
    got = rows(QUERIES[name](spark, sf_dir))
    assert got == oracle(sf_dir, name)
    keys = {r.p_partkey for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").collect()}
    assert {r[0] for r in got} >= ((keys - {0, 1} if name == "delegation_closure" else keys) if name != "extensional_recursive_head" else {r.l_partkey for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey").collect()})
