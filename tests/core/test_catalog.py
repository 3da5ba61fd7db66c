import os

import duckdb
import pytest

from credograph.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    want = duck.sql(catalog.SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    ordered = lambda rows: sorted(rows, key=str)
    assert ordered(tuple(r) for r in got.select(*names).collect()) == ordered(tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["variable", "belief"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
