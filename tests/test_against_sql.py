"""Every core query against its SQL twin in DuckDB, over whole tables."""

import glob
import math
import os

import duckdb
import pytest

from slatewise import catalog


def shown(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([shown(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    ours = sorted(tuple(str(shown(v)) for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    result = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    theirs = sorted(tuple(str(shown(r[i])) for i in place) for r in result.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted({*catalog.QUERIES} - {*catalog.ORACLE}))
def test_without_sql_gives_rows(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0
