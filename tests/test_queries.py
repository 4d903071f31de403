"""Every query that SQL expresses, against DuckDB on the same tables; the others run and give rows."""

from __future__ import annotations

import os

import pytest
from compare import difference

from gridloom.plans import catalog, workload

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
assert workload.MODULES


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    assert difference(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()  # every column is computed, which a count would not do
