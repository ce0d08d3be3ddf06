"""Every registered query of the engine against its SQL."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from surveyloom.registry import FLAGSHIP, ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}" if v else "0"
    if isinstance(v, bool) or v is None:
        return v
    return f"{v:.9g}" if isinstance(v, int) and abs(v) < 10**9 else str(v)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf) / t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = db.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str) == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert FLAGSHIP in e.queries() and e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
