"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from itemloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    out = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    assert rows == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in out.fetchall())
