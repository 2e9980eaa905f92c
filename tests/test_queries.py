"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from tests.conftest import DATA
from traitscan import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 4) if isinstance(v, float) else v
    return sorted([repr([plain(r[c]) for c in sorted(r)]) for r in df])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    got = [r.asDict() for r in queries.QUERIES[name](spark, DATA).collect()]
    want = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert rows(got) == rows([dict(zip(names, r, strict=True)) for r in want.fetchall()])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
