"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import pytest

from zephyrlake.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, str)):
        return x
    try:
        return float(x)
    except (TypeError, ValueError):
        return str(x)


def roughly(row):
    return repr(tuple(round(x, 4) if isinstance(x, float) else x for x in row))


def same(x, y):
    """Equal but for one unit of the sixth place, to which some queries round values that differ in their last bit."""
    return x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-7, abs_tol=1.1e-6)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    rows = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=roughly)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=roughly)
    assert len(mine) == len(rows)
    assert not [(a, b) for a, b in zip(mine, rows, strict=True) if not all(same(x, y) for x, y in zip(a, b, strict=True))][:3]


def test_plans_have_no_cartesian_product_of_tables(spark):
    for name in ("fire_trailing_24h", "asof_backward", "align_panel"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan
