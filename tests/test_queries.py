"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from terralith.plans.registry import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def sql(tiny):
    con = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sql, tiny, name):
    df = QUERIES[name](spark, tiny)
    found = sql.sql(SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    got, want = rows(df.columns, df.collect()), rows(found.columns, found.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)) for x, y in zip(a, b)), (a, b)


def test_others_give_rows(spark, tiny):
    rest = sorted(set(QUERIES) - set(SQL))
    assert rest == ["l04_event_scenarios", "l04_scenarios"]
    assert all(QUERIES[n](spark, tiny).count() for n in rest)


def test_entry_stands_alone():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert set(QUERIES) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)


def test_hot_expressions_stay_in_the_jvm(spark, tiny):
    for name in ("m1_top_cells", "a05_catchment_totals", "m02_m03_ranking", "j12_area_overlap"):
        plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    plan = QUERIES["p01_p02_cube_filter"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type" in plan or "In(event_type" in plan
