"""Every query with an SQL equivalent gives the same rows as DuckDB; every other one runs."""

import math

import duckdb
import pytest

from gleaner import catalog


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


def _rows(rows):
    return sorted(repr(tuple(_plain(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    found = catalog.QUERIES[name](spark, data)
    columns = sorted(found.columns)
    rows = found.select(*columns).collect()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert sorted(want.columns) == columns
        assert _rows(rows) == _rows(want.select(*columns).fetchall())


def test_flagship_has_rows(spark, data):
    assert catalog.flagship(spark, data).count() > 0


def test_oracles_belong_to_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
