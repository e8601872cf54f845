"""Every registered query against its SQL on the smallest tables, and the entry."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import oracles, registry


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_against_sql(spark, folder, duck, name):
    df = registry.queries()[name](spark, folder)
    names = sorted(df.columns)
    got = ordered([tuple(norm(x) for x in r) for r in df.select(*names).collect()])
    cur = duck.execute(oracles.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    want = ordered([tuple(norm(r[cols.index(c)]) for c in names) for r in cur.fetchall()])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(oracles.oracle_sql())))
def test_runs(spark, folder, name):
    assert registry.queries()[name](spark, folder).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "book_name", "row_id", "method", "final_score", "rank"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
