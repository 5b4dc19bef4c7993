"""Counting kernels: blocks are filtered in single precision and near pairs measured again, with the same results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.vectors import hashed_bow
from tidemark.operators.detectors import Hamming, Ssim
from tidemark.operators.pairs import HalfCosine, _HitOrder, all_pairs, pair_order_statistics


def _vectors(n=600):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(n, 64))
    return a, np.r_[a[: n // 2] + rng.normal(size=(n // 2, 64)) * 0.03, a[: n // 4], np.zeros((2, 64))]


@pytest.mark.parametrize("far", [1e-9, 0.003, 0.3, 0.5])
@pytest.mark.parametrize("kind", ["half_cosine", "ssim", "hamming"])
def test_near_pairs_of_blocks(kind, far):
    a, b = _vectors()
    if kind == "hamming":
        a, b = (a > 0).astype(float), (b > 0).astype(float)
    measure = {"half_cosine": HalfCosine(), "ssim": Ssim(float(a.max() - a.min())), "hamming": Hamming()}[kind]
    full = measure.all(a, b)
    pa, pb = measure.prepared(a), measure.prepared(b)
    assert np.nanmax(np.abs(measure.rough(pa, pb) - full)) <= measure.margin(pa)
    at, d = measure.within(pa, pb, far)
    near = np.flatnonzero(full.ravel() <= far + 1e-12)
    assert set(np.flatnonzero(full.ravel() <= far - 1e-12)) <= set(at) <= set(near)
    assert np.abs(full.ravel()[at] - d).max(initial=0) < 1e-12
    # a pair has one distance, whichever way round and among however many pairs it is asked
    ii, jj = np.divmod(np.arange(full.size), full.shape[1])
    every = measure.of(pa, pb, ii, jj)
    assert (every[at] == d).all()
    assert (measure.of(pb, pa, jj, ii) == every).all()
    few = np.random.default_rng(1).choice(full.size, 50)
    assert (measure.of(pa, pb, ii[few], jj[few]) == every[few]).all()


def test_nan_vectors_are_not_near():
    a, b = _vectors(40)
    a[3, 5] = np.nan
    m = HalfCosine()
    at, _ = m.within(m.prepared(a), m.prepared(b), 0.6)
    assert len(at) and not (at // len(b) == 3).any()


def test_order_of_hits():
    rng = np.random.default_rng(2)
    key, i, j = rng.integers(0, 20, 500), rng.integers(0, 30, 500), rng.integers(30, 50, 500)
    o = np.lexsort((j, i, key))
    hits = sorted(zip(key, i, j))
    asked = rng.integers(-1, 22, 3000), rng.integers(-1, 32, 3000), rng.integers(29, 51, 3000)
    assert _HitOrder(key[o], i[o], j[o])(*asked).tolist() == [sum(h < t for h in hits) for t in zip(*asked)]


def test_order_statistics_with_ties_and_zero_vectors(spark):
    x = np.random.default_rng(3).normal(size=(200, 16))
    x[50:60], x[100] = x[0], 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
    d = np.sort(all_pairs(df).toPandas().dist)
    places = [0, 3, 54, 55, 100, 9000, len(d) - 1]
    got = pair_order_statistics(df, places, block_rows=64)
    assert all(abs(got[p] - d[p]) < 1e-12 for p in places)


def test_bag_of_words_adds_up_rows_of_an_id(spark):
    rows = [(1, "a b  c A"), (1, " x\ty\u000bz "), (2, None), (3, ""), (None, "q q"), (4, "É é ß \U0001f600")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.id, sum(r.embedding)) for r in hashed_bow(df, "doc_id", "text", 64).collect()]
    assert sorted(got, key=str) == [(1, 7.0), (1, 7.0), (2, 0.0), (3, 0.0), (4, 4.0), (None, 0.0)]
    one = hashed_bow(df.where("doc_id = 4"), "doc_id", "text", 8).first().embedding
    bucket = F.pmod(F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("bigint"), F.lit(8))
    words = spark.createDataFrame([("é",), ("é",), ("ß",), ("\U0001f600",)], "t string").select(bucket.alias("b"))
    want = [0.0] * 8
    for r in words.collect():
        want[r.b] += 1
    assert one == want
