"""Every query that has SQL gives the rows that DuckDB gives for it."""

from __future__ import annotations

import math

import duckdb
import pytest

from lodestone import registry

registry.register()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(columns, data):
    """Sorted rows, columns by name; doubles to six digits."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.5g}"
        return "null" if v is None else str(v)

    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(name, spark, sf, duck):
    got = registry.QUERIES[name](spark, sf)
    want = duck.execute(registry.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_without_oracle(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).count() > 0
