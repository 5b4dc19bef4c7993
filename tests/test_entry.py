"""The driver contract in __spark_entry__.py."""

import __spark_entry__ as entry_mod


def test_entry_returns_metrics_row(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["n_items", "n_hits", "auroc", "ap", "auprg", "precision_at_20", "recall_at_20"]
    rows = df.collect()
    assert len(rows) == 1 and rows[0].n_hits > 0


def test_every_oracle_has_a_query():
    qs, orc = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 100
    for key in qs:
        assert key == key.lower() and ("_" in key or key == "pipeline")
