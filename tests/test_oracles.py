"""Every registered query against its SQL, over the whole small tables.

Broadcasting is off, as with sides too large for it, and no plan may pair rows
without an equality or force a broadcast.
"""

import pytest

from diff import DATA, compare, duck

from __spark_entry__ import entry
from cubeloom.suite import all_oracles, all_queries

QUERIES, SQL = all_queries(), all_oracles()
UNWANTED = ("CartesianProduct", "NestedLoop", "BroadcastHashJoin", "BatchEvalPython")


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.fixture(scope="module")
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_entry_has_rows(spark):
    assert entry(spark).count() == 5


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, no_broadcast, con):
    def planned(spark, sf_dir):
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [k for k in UNWANTED if k in plan]
        return df

    _, _, problem = compare(no_broadcast, con, planned, SQL.get(name), DATA)
    assert problem is None
