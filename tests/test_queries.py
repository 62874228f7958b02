"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quarry.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in catalog.ORACLE_SQL:
        return
    cur = duck.execute(catalog.ORACLE_SQL[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == columns
    want = sorted(tuple(plain(row[have.index(c)]) for c in columns) for row in cur.fetchall())
    assert got == want


def test_packing_stays_within_budget(spark):
    rows = catalog.QUERIES["first_fit_packing"](spark, SF).groupBy("q").sum("tokens").collect()
    assert rows and all(r[1] <= 60 for r in rows)
