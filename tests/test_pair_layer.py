"""Pair layer under ties, foreign truth ids and planted copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidemark.functions.scalars import pair_from_index, pair_to_index
from tidemark.operators import contaminate as K
from tidemark.operators import detectors as D
from tidemark.operators.pairs import all_pairs, knn, lsh_candidates, pair_hit_ranks
from tidemark.operators.stats import beta_nll
from tidemark.sources.readers import read_embeddings


def test_knn_of_identical_vectors_keeps_k_per_row(spark):
    df = spark.range(3000).withColumn("embedding", F.array(F.lit(0.6), F.lit(0.8)))
    got = knn(df, k=3).toPandas()
    assert len(got) == 9000
    assert sorted(got[got.q == 1000].nbr) == [0, 1, 2]
    assert sorted(got[got.q == 1].nbr) == [0, 2, 3]


def test_truth_ids_outside_the_table_are_no_hits(spark):
    emb = read_embeddings(spark, SF_SMALL)
    truth = spark.createDataFrame([(0, 1), (5, 3), (2, 10**9), (-1, -2)], "id bigint, id2 bigint")
    got = {(r.i, r.j): r["rank"] for r in pair_hit_ranks(emb, truth).collect()}
    p = all_pairs(emb).toPandas()
    p = p.assign(key=np.rint(p.dist * 1e9)).sort_values(["key", "i", "j"]).reset_index(drop=True)
    want = {(r.i, r.j): n + 1 for n, r in enumerate(p.itertuples()) if (r.i, r.j) in {(0, 1), (3, 5)}}
    assert got == want


def test_signatures_prune_and_find_planted_copies(spark):
    emb = read_embeddings(spark, SF_SMALL)
    c, t = K.near_duplicates(emb, 0.1, 42)
    found = {(r.i, r.j) for r in lsh_candidates(c, max_dist=0.05).collect()}
    close = {(r.i, r.j) for r in all_pairs(c, max_dist=0.05).collect()}
    planted = {tuple(sorted((r.id, r.id2))) for r in t.collect()} & close
    assert found <= close and planted
    assert len(found & planted) >= 0.95 * len(planted)


def test_bands_find_every_pair_within_seven_bits(spark):
    emb = read_embeddings(spark, SF_SMALL)
    c, _ = K.near_duplicates(emb, 0.1, 42)
    c = c.select("id", "embedding")
    got = {(r.i, r.j): round(r.score * 64) for r in D.phash_pairs(c, max_bits=7).collect()}
    h = {r.id: r.hash & (2**64 - 1) for r in D.phash(c).collect()}
    ids = sorted(h)
    want = {(a, b): (h[a] ^ h[b]).bit_count() for n, a in enumerate(ids) for b in ids[n + 1 :]
            if (h[a] ^ h[b]).bit_count() <= 7}
    assert got == want and want


@pytest.mark.parametrize("n", [2, 3, 7, 50])
def test_pair_positions_round_trip(spark, n):
    ks = spark.range(n * (n - 1) // 2)
    i, j = pair_from_index(F.col("id"), F.lit(n))
    rows = ks.select("id", i.alias("i"), j.alias("j")).withColumn("k", pair_to_index("i", "j", F.lit(n))).collect()
    assert [(r.i, r.j) for r in sorted(rows)] == [(a, b) for a in range(n) for b in range(a + 1, n)]
    assert all(r.k == r.id for r in rows)


def test_pair_positions_of_large_tables(spark):
    n = 2_900_000_000
    ends = [0, n - 2, n - 1, n * (n - 1) // 2 - 1, n * (n - 1) // 4]
    df = spark.createDataFrame([(k,) for k in ends], "k bigint")
    i, j = pair_from_index(F.col("k"), F.lit(n))
    back = df.select("k", i.alias("i"), j.alias("j")).withColumn("b", pair_to_index("i", "j", F.lit(n)))
    assert all(r.k == r.b and 0 <= r.i < r.j < n for r in back.collect())


def test_scores_outside_the_support_make_a_row_impossible(spark):
    x = spark.range(1, 100).select((F.col("id") / 100).alias("x"))
    grid = spark.createDataFrame([(2.0, 2.0, 0.9, 0.1), (2.0, 2.0, 0.0, 1.0)],
                                 "a double, b double, loc double, scale double")
    got = {r["loc"]: r.nll for r in beta_nll(x, "x", grid, 0.0).collect()}
    assert got[0.9] == float("inf") and np.isfinite(got[0.0])


def _vectors(spark, n, dim=6, seed=3):
    x = np.round(np.random.default_rng(seed).normal(size=(n, dim)), 1)
    return x, spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)],
                                    "id long, embedding array<double>, label int")


def test_blocks_travel_once_to_each_cell_of_their_side(spark):
    """The shuffle before a pair kernel carries the table a number of times that doesn't grow with the blocks."""
    from tidemark.operators import pairs as P

    _, df = _vectors(spark, 4000)
    for block_rows in (400, 40):
        nb, sides = P._layout(df, block_rows)
        cells = P.pair_cells(P._blocks(df, "id", "embedding", nb), sides)
        assert sum(len(r.ids) for r in cells.select("ids").collect()) == 4000 * (sides + 1)
        assert sides <= np.ceil(np.sqrt(8 * spark.sparkContext.defaultParallelism)) and nb >= 4000 / block_rows


def test_kernels_equal_brute_force_over_many_sides(spark, monkeypatch):
    from tidemark.operators import pairs as P

    monkeypatch.setattr(P, "SIDE_ROWS", 30)
    x, df = _vectors(spark, 400)
    assert P._layout(df, 10)[1] > 13
    d = P._pairwise(x, x, "sql2")
    key, ids = np.rint(d * 1e9), np.arange(400)
    got = knn(df, k=3, metric="sql2", block_rows=10).toPandas().sort_values(["q", "nn_rank"])
    off = np.where(np.eye(400, dtype=bool), np.inf, key)
    assert got.nbr.to_numpy().reshape(400, 3).tolist() == [np.lexsort((ids, r))[:3].tolist() for r in off]
    same = (ids[:, None] - ids[None]) % 3 == 0
    near = P.nearest_by_label(df, metric="sql2", block_rows=10).toPandas().sort_values("id")
    assert np.allclose(near.d_same, np.where(same & ~np.eye(400, dtype=bool), d, np.inf).min(1))
    assert np.allclose(near.d_other, np.where(~same, d, np.inf).min(1))
    i, j = np.triu_indices(400, 1)
    order = np.lexsort((j, i, key[i, j]))
    every = all_pairs(df, metric="sql2", block_rows=10).toPandas()
    assert sorted(zip(every.i, every.j)) == list(zip(i, j)) and np.allclose(every.dist, d[every.i, every.j])
    top = all_pairs(df, metric="sql2", block_rows=10, top=9).toPandas()
    assert [(r.i, r.j) for r in top.itertuples()] == [(i[n], j[n]) for n in order[:9]]
    planted = [(5, 300), (7, 8), (399, 0), (12, 13)]
    hits = pair_hit_ranks(df, spark.createDataFrame(planted, "id long, id2 long"), metric="sql2", block_rows=10)
    place = {(i[n], j[n]): r + 1 for r, n in enumerate(order)}
    assert {(r.i, r.j): r["rank"] for r in hits.collect()} == {tuple(sorted(p)): place[tuple(sorted(p))] for p in planted}
    by = P.knn_by(df.where("id < 100"), df.where("id >= 100"), ["label"], 2, "sql2", 10).toPandas().sort_values(["q", "nn_rank"])
    for q in (0, 31, 99):
        r = np.where(same[q] & (ids >= 100), key[q], np.inf)
        assert by[by.q == q].nbr.tolist() == np.lexsort((ids, r))[:2].tolist()


def test_rows_without_vector_or_label_do_no_harm(spark):
    from tidemark.operators.pairs import nearest_by_label

    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 1.0], 1), (4, None, 1), (None, [1.0, 0.0], 0), (5, [1.0, 0.1], None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    got = {r.id: (r.d_same is None, r.d_other is None) for r in nearest_by_label(df).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (True, False), 5: (True, True)}
    assert len(knn(df, k=1).collect()) == 4


def test_cut_of_all_pairs_equals_the_cut_of_their_ranking(spark):
    from tidemark.operators.audit import auto_cut, near_duplicate_audit, near_duplicate_cut

    x, df = _vectors(spark, 300)
    x[150:170] = x[:20] + 1e-3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    for q in (0.05, 500.0):
        want = {(r.i, r.j) for r in auto_cut(near_duplicate_audit(df), 0.1, q).where("flagged").collect()}
        got = {(r.i, r.j) for r in near_duplicate_cut(df, 0.1, q, block_rows=70).collect()}
        assert got == want and (want or q == 0.05)


def test_pair_detectors_are_measured_without_their_ranking(spark):
    from tidemark.operators.metrics import ranking_metrics
    from tidemark.operators.truth import pair_hits

    emb = read_embeddings(spark, SF_SMALL).where("id < 150")
    c, t = K.near_duplicates(emb, 0.1, 42)
    c = c.unionByName(c.where("id < 3"))   # rows that come twice
    got = D.compare(c, t, {"near_duplicate": D.DETECTORS["near_duplicate"]}).toPandas().set_index("detector")
    for name, rank in D.DETECTORS["near_duplicate"].items():
        want = ranking_metrics(pair_hits(rank(c), t).select("rank", "hit")).toPandas().iloc[0]
        assert np.allclose(want.to_numpy(float), got.loc[name, want.index].to_numpy(float))


def test_head_of_the_ranking_is_kept_by_the_kernel(spark):
    from tidemark.operators.audit import near_duplicate_audit

    emb = read_embeddings(spark, SF_SMALL)
    whole = near_duplicate_audit(emb).where("rank <= 7").toPandas().sort_values("rank")
    head = near_duplicate_audit(emb, top=7).toPandas().sort_values("rank")
    assert whole[["rank", "i", "j"]].to_numpy().tolist() == head[["rank", "i", "j"]].to_numpy().tolist()


def test_off_topic_eval_writes_the_destroyed_table_once(spark, monkeypatch):
    """The pair layer's null filter would otherwise be pushed below the perturbation and evaluate it row by row, nested."""
    from tidemark.operators import detectors as D
    from tidemark.plans import q_core

    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=16)], int(i % 4)) for i in range(80)]
    emb = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    seen, real = [], D.outliers
    monkeypatch.setattr(q_core, "read_embeddings", lambda spark, sf: emb)
    monkeypatch.setattr(D, "outliers", lambda e, *a: seen.append(e) or real(e, *a))
    q_core.l1_off_topic_eval_knn(spark, "")
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "Join" not in plan
    assert seen[0].count() == 80
