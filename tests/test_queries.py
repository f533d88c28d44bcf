"""Every core query with SQL gives the rows of its SQL on the smallest tables."""

import os

import pytest

from rulegrid.plans import core

duckdb = pytest.importorskip("duckdb")
CORE = core()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value)[:19] if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(n for n, q in CORE.items() if q.sql))
def test_equals_sql(spark, sf, name):
    df = CORE[name].run(spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf}/{file}'")
    out = con.execute(CORE[name].sql)
    at = [[c[0] for c in out.description].index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)
