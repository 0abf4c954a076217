"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from braidline import hierarchy_queries, queries as own  # noqa: F401  the first registers its queries in the second

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = own.QUERIES[name](spark, SF)
    want = duck.execute(own.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = plain([tuple(r) for r in got.collect()], got.columns), plain(want.fetchall(), names)
    assert len(a) == len(b)
    assert a == b
