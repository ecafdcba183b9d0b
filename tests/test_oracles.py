"""Every query of the engine against its SQL in DuckDB, on the same tables."""

import datetime
import glob

import duckdb
import pytest
from cairnlore import registry

SQL = registry.oracle_sql()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float,)) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_query_has_sql():
    assert set(SQL) == set(registry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, sf_dir, oracle):
    df = registry.queries()[name](spark, sf_dir)
    rel = oracle.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [rel.columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
