"""L10 and J10 kernels against plain Python, with ties, nulls, repeated ids and groups."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_key
from tidemark.operators import detectors as D
from tidemark.operators import stats


def test_swaps_are_the_hash_of_any_id():
    ids = [b"7", b"123", None, b"", b"x" * 60, b"y" * 130, "é".encode(), b"1" * 45, b"1" * 46, b"1" * 47]
    got = stats._swapped(ids, 1003, 42)
    for row, i in zip(got, ids):
        for r in (1, 9, 10, 99, 100, 999, 1000, 1003):
            text = f"42:perm:{r}".encode() + (b"" if i is None else b"/" + i)
            assert row[r] == (hashlib.md5(text).digest()[0] < 128)
    assert not got[:, 0].any()


def _permutation(rows, resamples, seed):
    def low(v):
        return (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v + 0.0)

    t = []
    for r in range(resamples + 1):
        pairs = []
        for i, x, y in rows:
            text = f"{seed}:perm:{r}" + ("" if i is None else f"/{i}")
            swap = r > 0 and int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32 < 0.5
            pairs.append((low(y), low(x)) if swap else (low(x), low(y)))
        xs = [x for x, _ in pairs]
        t.append(sum(sum(o < x for o in xs) + (sum(o == x for o in xs) + 1) / 2
                     for x, y in pairs if x[0] and y[0] and x > y))
    more, less = (sum(f(v) for v in t[1:]) + 1 for f in (lambda v: v >= t[0] - 1e-12, lambda v: v <= t[0] + 1e-12))
    return t[0], more / (resamples + 1), less / (resamples + 1)


def test_permutation_of_groups_with_ties_nulls_and_nan(spark):
    rng = np.random.default_rng(4)
    rows = [(g, int(i), float(a), float(b)) for g in (1, 2) for i, (a, b) in enumerate(rng.integers(0, 6, (30, 2)))]
    rows += [(1, 3, 2.0, 1.0), (1, None, 5.0, 1.0), (1, 40, None, 3.0), (2, 41, float("nan"), 2.0), (2, 42, -0.0, 0.0)]
    df = spark.createDataFrame(rows, "g int, id bigint, x double, y double")
    got = {r.g: r for r in stats.paired_permutation(df, "x", "y", resamples=60, by=["g"]).collect()}
    for g in (1, 2):
        want = _permutation([r[1:] for r in rows if r[0] == g], 60, 42)
        assert np.allclose((got[g].statistic, got[g].p_greater, got[g].p_less), want)


def test_prototypes_and_dependence(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 5)).round(1)
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    rows += [(0, x[1].tolist(), 0), (200, None, 1), (None, x[2].tolist(), 2), (201, x[3].tolist(), None)]
    emb = spark.createDataFrame(rows, "id bigint, embedding array<double>, label int")
    protos = D.prototypes(emb, seed=42, rounds=3)
    # Lloyd's rounds in plain Python: an id's rows follow the nearest of them all, a null distance is the nearest
    keys = {r.id: r.h for r in emb.select("id", hash_key(42, "proto", "id").alias("h")).collect()}
    counts = {r.label: r.k for r in D.prototype_counts(emb).collect() if r.label is not None}
    centers = {}
    for c, k in counts.items():
        mine = sorted((r for r in rows if r[2] == c), key=lambda r: (keys[r[0]] or "", -1 if r[0] is None else r[0]))
        centers |= {(c, p): r[1] for p, r in enumerate(mine[:k])}
    for _ in range(3):
        best = {}
        for i, v, c in rows:
            for (cc, p), m in centers.items():
                if i is not None and cc == c:
                    d = None if v is None or m is None else sum((a - b) ** 2 for a, b in zip(v, m))
                    best[i] = min(best.get(i, (9, 0, 0)), (0, 0.0, p) if d is None else (1, d, p))
        for key in centers:
            own = [v for i, v, c in rows if v is not None and i in best and (c, best[i][2]) == key]
            if own:
                centers[key] = np.mean(own, axis=0).tolist()
    got = {(r.label, r.proto): r.center for r in protos.collect()}
    assert got.keys() == centers.keys()
    assert all(np.allclose(got[k], centers[k]) for k in got)
    votes = protos.select("proto_id", F.when(F.col("proto_id") != 1, (F.col("proto_id") % 3).cast("int")).alias("pred"))
    score = {r.id: r.score for r in D.dependence(emb, protos, votes).collect()}
    model = [(r.label, r.pred, r.center) for r in protos.join(votes, "proto_id").collect()]
    want = {}
    for i, v, y in rows:
        total = want.setdefault(i, None)
        for yj, yp, m in model if v is not None else ():
            w = (-1.0 if y is not None and y == yj else 0.5)   # the two other weights are equal by default
            total = (total or 0) + w / (1 + math.dist(v, m))
        want[i] = total
    assert score.keys() == want.keys()
    assert all((score[i] is None) == (want[i] is None) and (want[i] is None or abs(score[i] - want[i]) < 1e-9) for i in want)
    assert [D._label_weight(*a, 0.3, 0.5) for a in ((1, 1, 2), (1, 2, 2), (1, 2, 3), (1, 2, 1), (None, 2, 2), (None, 2, 3), (1, 2, None))] \
        == [-1.0, 0.7, 0.3, 0.15, 0.7, 0.15, 0.15]
