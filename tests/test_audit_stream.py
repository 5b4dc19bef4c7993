"""The incremental audit equals the batch operators, skips cells, and survives replays."""

import numpy as np
import pytest

from tidemark.functions.vectors import l2_normalize
from tidemark.operators.audit import label_error_scores
from tidemark.operators.pairs import all_pairs
from tidemark.streaming.audit_stream import label_scores, process_batch


def _table(spark, n, clusters, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 10
    x = centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, dim)) * 0.05
    x[7] = x[3]   # equal vectors
    rows = [(i, [float(v) for v in x[i]], int(rng.integers(4))) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def _pairs(df):
    return {(r.i, r.j): round(r.dist, 7) for r in df.select("i", "j", "dist").collect()}


def test_batches_equal_the_batch_operators_and_skip_cells(spark, tmp_path):
    e, out = _table(spark, 900, 30), str(tmp_path / "a")
    for b in range(3):
        process_batch(spark, e.where(f"vec_id % 3 = {b}"), b, out, max_dist=0.002)
    emb = e.select(e.vec_id.alias("id"), l2_normalize("embedding").alias("embedding"), "label")
    pairs = spark.read.parquet(f"{out}/pairs")
    assert pairs.count() == pairs.select("i", "j").distinct().count()
    assert _pairs(pairs) == _pairs(all_pairs(emb, max_dist=0.002))
    want = {r.id: r.score for r in label_error_scores(emb).collect()}
    got = {r.id: r.score for r in label_scores(spark, out).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-7 for i in want)
    first = emb.where("id % 3 < 2")   # as after the second batch
    want = {r.id: r.score for r in label_error_scores(first).collect()}
    got = {r.id: r.score for r in label_scores(spark, out, 1).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-7 for i in want)
    counts = {r.batch_id: r for r in spark.read.parquet(f"{out}/counts").collect()}
    assert [counts[b].n_rows for b in range(3)] == [300, 600, 900]
    assert 0 < counts[2].n_compared < 0.35 * 300 * 600


def test_replay_nulls_and_empty_batches(spark, tmp_path):
    out = str(tmp_path / "b")
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (None, [1.0, 1.0], 0), (3, None, 1), (4, [0.0, 0.0], 0)]
    more = [(5, [1.0, 0.0], None), (6, [1.0, 0.01], None), (1, [1.0, 0.0], 0)]
    process_batch(spark, spark.createDataFrame([], schema), 0, out)
    process_batch(spark, spark.createDataFrame(rows, schema), 1, out, max_dist=0.01)
    for _ in range(2):   # the second time as after a failure
        process_batch(spark, spark.createDataFrame(more, schema), 2, out, max_dist=0.01)
        got = spark.read.parquet(f"{out}/pairs").select("i", "j").collect()
        assert sorted(tuple(r) for r in got) == [(1, 5), (1, 5), (1, 6), (1, 6), (5, 6)]   # id 1 came twice
        assert spark.read.parquet(f"{out}/state").count() == 6
    process_batch(spark, spark.createDataFrame([], schema), 3, out)
    counts = {r.batch_id: r.n_rows for r in spark.read.parquet(f"{out}/counts").collect()}
    assert counts == {0: 0, 1: 3, 2: 6, 3: 6}
    score = {r.id: r.score for r in label_scores(spark, out).collect()}
    assert set(score) == {1, 2, 4, 5, 6}
    assert score[5] == pytest.approx(0.0, abs=1e-9)   # its other-label neighbour is equal to it


def test_new_rows_travel_once_to_each_side_of_the_stored_ones(spark, tmp_path):
    """What travels is the rows times the sides, also where every cell stays open (before: new rows times open cells)."""
    from pyspark.sql import functions as F

    from tidemark.streaming import audit_stream as A

    e, out = _table(spark, 600, 1), str(tmp_path / "c")
    sent, cross = [], A.cross_cells

    def counted(a, b, a_sides, b_sides):
        cells = cross(a, b, a_sides, b_sides)
        sent.append(cells.select(F.sum(F.size("ids"))).first()[0] - 300 * (a_sides + b_sides))
        return cells

    process_batch(spark, e.where("vec_id % 2 = 0"), 0, out, max_dist=1.0)
    A.cross_cells = counted
    try:
        process_batch(spark, e.where("vec_id % 2 = 1"), 1, out, max_dist=1.0)
    finally:
        A.cross_cells = cross
    assert sent == [0]
    assert spark.read.parquet(f"{out}/pairs").count() == 600 * 599 // 2
