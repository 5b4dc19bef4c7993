"""Every query with an oracle matches DuckDB on the smallest fixture."""

import math

import pytest

from tidemark.plans.registry import oracle_sql, queries

from conftest import SF_SMALL

ORACLES = oracle_sql()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_duckdb(spark, duck, key):
    df = queries()[key](spark, SF_SMALL)
    rel = duck.sql(ORACLES[key])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())
