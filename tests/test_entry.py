"""The driver contract: entry runs, every query has a stable schema and
(almost) every query has oracle SQL."""

from conftest import SF_SMALL

import __spark_entry__ as E
from cuelake.plans.catalog import QUERIES as CATALOG


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[0] == "doc_id" and len(df.columns) == 9
    assert df.count() > 0


def test_every_query_has_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(CATALOG) <= set(o)
    assert len(q) >= 25


def test_queries_plan_on_small_sf(spark):
    for name, fn in CATALOG.items():
        df = fn(spark, SF_SMALL)
        assert df.columns, name
        assert len(set(df.columns)) == len(df.columns), name
