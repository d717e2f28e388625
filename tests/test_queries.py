"""Every query of the library against its SQL on the smallest tables; the rest give rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from fieldloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SLOW = {"nb_de", "nb_de_tubes", "nb_trend", "nb_trend_grid"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(rows) -> list[str]:
    return sorted(repr(tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(columns).collect()]
    text = registry.oracle_sql().get(name)
    if text is None:
        assert rows
        return
    found = duck.execute(text)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert plain(rows) == plain(tuple(r[i] for i in at) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
