"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

from pathlib import Path

import duckdb
import pytest

from ledgerloom.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(columns, found):
    plain = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    return sorted((tuple(plain(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in found), key=repr)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    mine = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert mine
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert rows(df.columns, mine) == rows(want.columns, want.fetchall())
