"""Every query with SQL gives the same rows as the SQL on the smallest tables."""

import glob
import math
import os

import pytest

from corpuslens import plans

duckdb = pytest.importorskip("duckdb")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def compare(spark, sf, db, build, sql):
    df = build(spark, sf)
    cols = sorted(df.columns)
    a = sorted(tuple(_norm(v) for v in r) for r in df.select(*cols).collect())
    r = db.execute(sql)
    names = [d[0] for d in r.description]
    b = sorted(tuple(_norm(x[names.index(n)]) for n in cols) for x in r.fetchall())
    assert sorted(names) == cols
    assert a == b


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, sf, db, name):
    compare(spark, sf, db, plans.QUERIES[name], plans.SQL[name])


@pytest.mark.parametrize("name", ["greedy_group_split", "bootstrap_ci", "report_r2_tests", "report_r3_tests", "report_r8_tests"])
def test_query_without_sql(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_names():
    assert set(plans.SQL) <= set(plans.QUERIES)
