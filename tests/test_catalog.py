"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = sql.execute(catalog.ORACLES[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())
