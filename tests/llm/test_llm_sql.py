"""The pN queries that have a SQL twin, over whole tables."""

import glob
import os

import duckdb
import pytest

from slatewise.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, small, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, small)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, result.fetchall()))


def test_every_problem_has_a_query():
    for n in range(1, 10):
        assert any(q.startswith(f"p{n}_") for q in QUERIES)
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 9)} | {"p7_ids"} <= set(QUERIES)
