"""Every query beside its SQL on the smallest tables, and on empty ones."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import canon

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for f in sorted(os.listdir(SF)):
        spark.read.parquet(f"{SF}/{f}").limit(0).write.parquet(f"{folder}/{f}")
    return str(folder)


#: Queries over made-up files or fixed lists, which have no meaning without rows.
NEED_ROWS = {"landing_round_trip", "delivery_round_trip"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NEED_ROWS))
def test_empty_tables(spark, empty, name):
    QUERIES[name](spark, empty).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_need_the_subpackage():
    from tidewright.queries import core

    found, sql = core()
    assert {"p1_found", "p6_found"} <= set(found) and not any(n.startswith(("p2", "p3", "p4", "p5", "p7", "p8", "p9", "p10")) for n in found)
    assert set(sql) <= set(found)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "tidewright")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f)).read()
                assert "tidewright.llm" not in text, f
