"""Every registered query with SQL against DuckDB on the smallest tables; those without SQL run and keep their schema."""

import os

import pytest

from latticework.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

duckdb = pytest.importorskip("duckdb")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows_of(rows):
    def key(r):
        return tuple((0, 0) if v is None else (1, float(v)) if isinstance(v, (int, float)) else (2, str(v)) for v in r)

    return sorted((tuple(r) for r in rows), key=key)


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = rows_of(df.select(*columns).collect())
    found = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = rows_of([tuple(r[k] for k in order) for r in found.fetchall()])
    assert len(got) == len(want)
    assert got == want


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
