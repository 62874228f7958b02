"""Contract queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from quarry.llm import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 8) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    cur = con.execute(registry.ORACLE_SQL[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == columns
    assert got == sorted(tuple(plain(row[have.index(c)]) for c in columns) for row in cur.fetchall())
