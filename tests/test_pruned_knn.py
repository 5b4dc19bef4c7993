"""Pruned exact kNN against the blocked kNN and brute force; what it skips on clustered rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidemark.operators.pairs import knn
from tidemark.operators.pruned_knn import pruned_knn
from tidemark.sources.readers import read_embeddings


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")


def clustered(n=6000, centres=40, dim=8, seed=2):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 10, (centres, dim))[rng.integers(0, centres, n)] + rng.normal(0, 0.3, (n, dim))


def neighbours(df):
    return {(r.q, r.nn_rank): (r.nbr, round(r.dist, 8)) for r in df.collect()}


@pytest.mark.parametrize("metric", ["l2", "sql2", "cosine", "half_cosine"])
def test_equal_to_the_blocked_join(spark, metric):
    emb = read_embeddings(spark, SF_SMALL)
    assert neighbours(pruned_knn(emb, k=4, metric=metric)) == neighbours(knn(emb, k=4, metric=metric))


def test_clustered_rows_skip_most_comparisons(spark):
    x = clustered()
    got = pruned_knn(vectors(spark, x), k=3, block_rows=256).toPandas()
    d = np.sqrt(((x[:300, None] - x[None]) ** 2).sum(2))
    d[np.arange(300), np.arange(300)] = np.inf
    for q in range(300):
        rows = got[got.q == q].sort_values("nn_rank")
        assert rows.nbr.tolist() == np.argsort(d[q], kind="stable")[:3].tolist()
    share = got[got.nn_rank == 1].compared.sum() / len(x) ** 2
    print(f"compared {share:.3f} of all pairs")
    assert len(got) == 3 * len(x) and share < 0.1


def test_other_base_ties_and_a_hot_vector(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([np.tile([1.0, 2.0, 3.0], (1500, 1)), rng.normal(size=(1500, 3)), np.zeros((3, 3))])
    base, asked = vectors(spark, x), vectors(spark, np.vstack([x[:2], rng.normal(size=(20, 3)) * 5, [[0, 0, 0]]]), 10_000)
    for metric in ("l2", "half_cosine"):
        got = neighbours(pruned_knn(asked, base, k=5, metric=metric, block_rows=128))
        assert got == neighbours(knn(asked, base, k=5, metric=metric))
    assert neighbours(pruned_knn(base, k=2, metric="cosine")) == neighbours(knn(base, k=2, metric="cosine"))


def test_few_rows_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], "a"), (2, [0.0, 3.0], "b"), (None, [9.0, 9.0], "c"), (3, None, None)],
                               "id long, embedding array<double>, cell string")
    assert neighbours(pruned_knn(df, k=5)) == {(1, 1): (2, 2.0), (2, 1): (1, 2.0)}
    assert pruned_knn(df.limit(0)).count() == 0 and pruned_knn(df, df.limit(0)).count() == 0
    assert pruned_knn(df.where(F.col("id") == 1)).count() == 0
    with pytest.raises(ValueError, match="triangle"):
        pruned_knn(df, metric="dot")


def test_rows_without_clusters_are_not_sent_to_every_ring(spark, tmp_path):
    """All rings stay open here; the rows that travel are those of the sides, not queries times rings."""
    from tidemark.operators import pruned_knn as P

    x = np.random.default_rng(1).normal(size=(3000, 24))
    sent, cross = [], P.cross_cells

    def counted(a, b, a_sides, b_sides):
        cells = cross(a, b, a_sides, b_sides)
        sent.append(cells.select(F.sum(F.size("ids"))).first()[0] / (a_sides + b_sides))
        return cells

    P.cross_cells = counted
    try:
        got = pruned_knn(vectors(spark, x), k=3, block_rows=64)
    finally:
        P.cross_cells = cross
    assert sent == [3000]
    assert neighbours(got) == neighbours(knn(vectors(spark, x), k=3))
