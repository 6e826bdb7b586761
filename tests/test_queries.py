"""Every registered query of the reference's own operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from splitproof.plans import registry


@pytest.fixture(scope="module")
def duck(smallest):
    con = duckdb.connect()
    for name in os.listdir(smallest):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{smallest}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, smallest, name):
    got = registry.QUERIES[name](spark, smallest).toPandas()
    assert list(got.columns) == list(dict.fromkeys(got.columns))
    if name not in registry.ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    a = got[columns].sort_values(columns, ignore_index=True)
    b = want[columns].sort_values(columns, ignore_index=True)
    for c in columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), (c, a[c][~same].iloc[0], b[c][~same].iloc[0])


def test_entry_without_llm(spark, smallest):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
