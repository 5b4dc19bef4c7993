"""Queries of tidemark.llm that SQL can express match DuckDB."""

import duckdb
import pytest

from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(Q.ORACLES))
def test_matches_duckdb(spark, key):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = Q.QUERIES[key](spark, SF)
    rel = con.sql(Q.ORACLES[key])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    mine = sorted(map(repr, (tuple(r[c] for c in order) for r in df.collect())))
    names = list(rel.columns)
    theirs = sorted(map(repr, (tuple(r[names.index(c)] for c in order) for r in rel.fetchall())))
    assert mine == theirs


def test_all_operators_are_registered():
    assert {int(k[2:].split("_")[0]) for k in Q.QUERIES if k.startswith("op")} == set(range(1, 14))
    assert "pipeline" in Q.QUERIES
