"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, pd, rows_of

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    if name not in ORACLES:
        return
    result = db.execute(ORACLES[name])
    want = pd.DataFrame(result.fetchall(), columns=[c[0] for c in result.description], dtype=object)
    assert rows_of(got) == rows_of(want)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
