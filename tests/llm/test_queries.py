import duckdb
import pytest

from tests.conftest import DATA
from traitscan.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = sorted(c[0] for c in want.description)
    rows = [dict(zip([c[0] for c in want.description], r, strict=True)) for r in want.fetchall()]
    got = [r.asDict() for r in queries.QUERIES[name](spark, DATA).collect()]
    plain = lambda v: round(v, 4) if isinstance(v, float) else v
    assert sorted(repr([plain(r[c]) for c in names]) for r in got) == sorted(repr([plain(r[c]) for c in names]) for r in rows)
