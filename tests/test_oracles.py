"""Every registered query against its DuckDB SQL, by value."""

from __future__ import annotations

import math

import duckdb
import pytest
from tessera.plans import catalog
from tessera.sources.tables import DRIVER_TABLES

catalog.load()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v if isinstance(v, (bool, int, str, type(None))) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, data, duck, name):
    got = catalog.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    found = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=str)
    q = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(norm(float(v) if type(v).__name__ == "Decimal" else v) for v in (r[names.index(c)] for c in columns)) for r in q.fetchall()), key=str)
    assert found == wanted
    assert found


@pytest.mark.parametrize("name", sorted(catalog.WITHOUT))
def test_others_have_rows(spark, data, name):
    assert catalog.WITHOUT[name]
    assert catalog.QUERIES[name](spark, data).count() > 0
