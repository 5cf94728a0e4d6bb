"""Every query of the reference domain against its SQL, and the driver's contract."""

import pytest
from compare import canon, oracle_rows

import __spark_entry__ as entry
from shoalgraph.plans import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    expected = oracle_rows(SF, oracle.oracle_sql()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert canon(got) == canon(expected)


def test_contract(spark):
    assert set(oracle.oracle_sql()) == set(queries.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_flagship_is_ordered(spark):
    rows = queries.province_counts(spark, SF).collect()
    assert rows == sorted(rows, key=lambda r: (-r.counts, r.province_name))


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries.scatter_layer(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan
