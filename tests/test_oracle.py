"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import pytest

from medlark.plans import more_queries  # noqa: F401  registers its queries
from medlark.plans import queries as Q

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7)
    return v


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, oracle, name):
    df = Q.QUERIES[name](spark, FOLDER)
    found = oracle.sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    order = sorted(df.columns)
    at = [found.columns.index(c) for c in order]
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", ["temporal_ror", "pair_temporal_score", "atc_hierarchy_counts", "dose_patient", "exposure_documentation"])
def test_plans_have_no_python_and_no_cartesian_product(spark, name):
    plan = Q.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["report", "dc_id", "ror"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
