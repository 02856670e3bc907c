"""Each registered query against its SQL on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import tessella.queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(norm, v)) if isinstance(v, list) else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in core.ORACLE:
        assert rows
        return
    r = duck.execute(core.ORACLE[name])
    columns = [d[0] for d in r.description]
    want = r.fetchall()
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    assert ordered([tuple(norm(x[i]) for i in order) for x in want]) == ordered([tuple(map(norm, x)) for x in rows])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
