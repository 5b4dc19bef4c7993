"""Library detectors (J3-J12): outlier scores, label checks, raster pair scores.

Each detector is ``DataFrame -> (id, score)`` (or pairs), registered in
:data:`DETECTORS` with the inputs it needs (U1). Per-dimension statistics
use a long ``(id, dim, x)`` table from ``posexplode`` so the work spreads
over rows and dimensions instead of one task per dimension.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_key, uniform
from tidemark.functions.scalars import kernel_weight
from tidemark.functions.vectors import half_cosine_distance
from tidemark.operators.pairs import (
    SIDE_ROWS, Filtered, Whole, _by_cell, _dealt, _products, all_pairs, knn, pair_hit_ranks,
)
from tidemark.operators.quantiles import quantiles
from tidemark.operators.ranking import global_rank, freeze


def long_form(emb: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """``(id, dim, x)``: one row per vector component."""
    return emb.select("id", F.posexplode(vec_col).alias("dim", "x"))


def ecdf(long: DataFrame) -> DataFrame:
    """Per dimension, F(x) = P(X <= x) and Fbar(x) = P(X >= x).

    A window partitioned by ``dim`` would sort all n values of a dimension
    in one task. Instead rows are globally ranked on ``(dim, x, id)``
    (range-partitioned, balanced whatever the value distribution); the
    first position of each dimension and the first/last position of each
    tie group ``(dim, x)`` are small aggregates joined back.
    """
    r = global_rank(long, ["dim", "x", "id"], "_p")
    dims = r.groupBy("dim").agg(F.min("_p").alias("_d0"), F.count(F.lit(1)).alias("_n"))
    ties = r.groupBy("dim", "x").agg(F.min("_p").alias("_t0"), F.max("_p").alias("_t1"))
    st = ties.join(F.broadcast(dims), "dim").select(
        "dim", "x", ((F.col("_t1") - F.col("_d0") + 1) / F.col("_n")).alias("F_le"),
        ((F.col("_n") - (F.col("_t0") - F.col("_d0"))) / F.col("_n")).alias("F_ge"))
    return r.drop("_p").join(st, ["dim", "x"])


def ecod(emb: DataFrame) -> DataFrame:
    """J6 ECOD: max of left-tail, right-tail and skew-chosen tail sums of -ln ECDF."""
    lf = long_form(emb)
    e = ecdf(lf)
    skew = lf.groupBy("dim").agg(F.skewness("x").alias("sk"))
    parts = e.join(F.broadcast(skew), "dim").select(
        "id", (-F.log(F.col("F_le"))).alias("l"), (-F.log(F.col("F_ge"))).alias("r"),
        F.when(F.col("sk") < 0, -F.log(F.col("F_le"))).otherwise(-F.log(F.col("F_ge"))).alias("a"))
    s = parts.groupBy("id").agg(F.sum("l").alias("L"), F.sum("r").alias("R"), F.sum("a").alias("A"))
    return s.select("id", F.greatest("L", "R", "A").alias("score"))


def hbos(emb: DataFrame, bins: int = 10, alpha: float = 0.1) -> DataFrame:
    """J9 HBOS: equal-width histograms per dimension, sum of -log2(density + alpha)."""
    lf = long_form(emb)
    rng = lf.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"),
                                F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = (lf.join(F.broadcast(rng), "dim")
         .withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(
             F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(bins)),
             F.lit(bins - 1))).otherwise(F.lit(0)).cast("int"))
         .withColumn("w", F.when(F.col("hi") > F.col("lo"), width).otherwise(F.lit(1.0))))
    dens = b.groupBy("dim", "bin").agg(
        (F.count(F.lit(1)) / (F.first("n") * F.first("w"))).alias("density"))
    s = b.join(dens, ["dim", "bin"]).groupBy("id").agg(
        F.sum(-F.log2(F.col("density") + F.lit(alpha))).alias("score"))
    return s


def knn_distance(emb: DataFrame, k: int = 5) -> DataFrame:
    """Euclidean distance to the k-th nearest other row (largest of k)."""
    nn = knn(emb, k=k, metric="l2", exclude_self=True)
    return nn.groupBy(F.col("q").alias("id")).agg(F.max("dist").alias("score"))


def outliers(emb: DataFrame, scorer, contamination: float = 0.1) -> DataFrame:
    """Rank by outlier score descending; ``is_outlier`` above the (1 - c) quantile."""
    s = freeze(scorer(emb))
    thr = quantiles(s, "score", [1.0 - contamination], names=["_thr"]).select("_thr")
    s = s.crossJoin(thr).withColumn("is_outlier", (F.col("score") > F.col("_thr")).cast("int")).drop("_thr")
    s = s.withColumn("_key", -F.round("score", 9))
    return global_rank(s, ["_key", "id"], "rank").select("rank", "id", "score", "is_outlier")


def knn_agreement(emb: DataFrame, k: int = 2) -> DataFrame:
    """Share of the k nearest neighbours with the same label; least agreement
    first, then mean neighbour distance ascending, then id."""
    nn = knn(emb, k=k, metric="half_cosine", exclude_self=True)
    lab = emb.select("id", "label")
    j = (nn.join(lab.withColumnRenamed("id", "q").withColumnRenamed("label", "ql"), "q")
         .join(lab.withColumnRenamed("id", "nbr").withColumnRenamed("label", "nl"), "nbr"))
    s = j.groupBy(F.col("q").alias("id")).agg(
        F.avg((F.col("ql") == F.col("nl")).cast("double")).alias("score"),
        F.avg("dist").alias("mean_dist"))
    s = s.withColumn("_k1", F.round("score", 9)).withColumn("_k2", F.round("mean_dist", 9))
    return global_rank(s, ["_k1", "_k2", "id"], "rank").select("rank", "id", "score", "mean_dist")


# --------------------------------------------------------------------------- #
# Noise rank (prototypes, weighted kNN votes, dependence score)
# --------------------------------------------------------------------------- #

def prototype_counts(emb: DataFrame) -> DataFrame:
    """Class sizes, mean size rho, k = max(floor(sqrt(rho / 2)), 1) clipped to the class."""
    sizes = emb.groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
    rho = sizes.agg(F.avg("n_c").alias("rho"))
    return sizes.crossJoin(rho).select(
        "label", F.col("n_c").cast("bigint").alias("n_c"), "rho",
        F.least(F.greatest(F.floor(F.sqrt(F.col("rho") / 2)), F.lit(1)), F.col("n_c"))
        .cast("int").alias("k"))


def prototypes(emb: DataFrame, seed: int = 42, rounds: int = 10) -> DataFrame:
    """Per-class K-means (Lloyd), all classes in one plan.

    Start centres are the k first rows of each class in seeded hash order.
    Each round assigns rows to the nearest centre of their own class in a
    kernel that holds the centres (sum_c k_c ~ sqrt(n) rows) and adds up its
    rows by ``(label, proto)``, so only the sums of a task are shuffled. The
    rows are written once, an id's rows together.
    Output ``(label, proto_id, center array<double>)``.
    """
    from tidemark.operators.contaminate import rank_within

    ks = prototype_counts(emb).select("label", "k")
    keyed = emb.withColumn("_h", hash_key(seed, "proto", "id"))
    start = (rank_within(keyed, ["label"], ["_h", "id"], "_r")
             .join(F.broadcast(ks), "label").where(F.col("_r") <= F.col("k"))
             .select("label", (F.col("_r") - 1).cast("int").alias("proto"),
                     F.col("embedding").cast("array<double>").alias("center")))
    centers = {(r.label, r.proto): r.center for r in start.collect()}   # sum of k_c rows, the model
    names = sorted({label for label, _ in centers})
    rows = F.struct("label", F.col("embedding").cast("array<double>").alias("v"))
    by_id = freeze(emb.where("id is not null").groupBy("id").agg(F.collect_list(rows).alias("r")).select("r"))
    tasks = 2 * emb.sparkSession.sparkContext.defaultParallelism   # each sends its sums of every centre
    by_id = by_id.coalesce(tasks)
    for _ in range(rounds):
        model = emb.sparkSession.sparkContext.broadcast((names, centers))
        sums = by_id.mapInArrow(lambda it, model=model: _assigned_sums(it, *model.value),
                                "code int, proto int, sums array<double>, known array<bigint>")
        got = (sums.select("code", "proto", F.posexplode(F.arrays_zip("sums", "known")).alias("i", "s"))
               .groupBy("code", "proto", "i").agg(F.sum("s.sums").alias("x"), F.sum("s.known").alias("c"))
               .groupBy("code", "proto").agg(F.array_sort(F.collect_list(F.struct("i", "x", "c"))).alias("s")).collect())
        new = {(names[r.code], r.proto): [x.x / x.c if x.c else None for x in r.s] for r in got}
        # a centre that lost all its rows keeps its position
        centers = {key: new.get(key, center) for key, center in centers.items()}
    table = emb.sparkSession.createDataFrame(
        [(*key, center) for key, center in centers.items()],
        start.schema)
    w = F.dense_rank().over(Window.orderBy("label", "proto"))
    # proto ids: small table (sum of k_c rows), a global window is fine here
    return table.withColumn("proto_id", (w - 1).cast("bigint"))


def _read_vectors(col):
    """A list column of a batch: sizes (-1 for null), whether all values are there, first places, values, known values."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(col)
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    held = np.maximum(size, 0)
    whole = size >= 0
    whole[np.repeat(np.arange(len(size)), held)[~known]] = False
    return size, whole, np.cumsum(held) - held, pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), known


def _sq_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of two sets of vectors, summed in the order of the components as :func:`sq_l2_distance`."""
    d = np.zeros((len(x), len(c)))
    for lo in range(0, len(x), 128):
        at = d[lo : lo + 128]
        for i in range(x.shape[1]):
            t = x[lo : lo + 128, i, None] - c[None, :, i]
            t *= t
            at += t
    return d


def _comparable(centers, size: int):
    """Places of the centres that have a distance to whole vectors of ``size``, and those vectors."""
    at = [i for i, c in enumerate(centers) if c is not None and len(c) == size and None not in c]
    return np.array(at, dtype=np.int64), np.array([centers[i] for i in at], dtype=np.float64).reshape(len(at), size)


def _assigned_sums(batches, names, centers):
    """A round's sums and numbers of known components of the rows of each centre, over a task's ids.

    An id's rows go to the nearest centre of their own class; of an id that comes more often the nearest
    counts for all its rows. A null distance comes before all others, ties go to the first centre.
    """
    import pyarrow as pa

    code = {name: i for i, name in enumerate(names)}
    of = [[] for _ in names]
    for (label, proto), center in sorted(centers.items(), key=lambda kv: (code[kv[0][0]], kv[0][1])):
        of[code[label]].append((proto, center))
    protos = [np.array([p for p, _ in cs], dtype=np.int64) for cs in of]
    fit, total = {}, {}

    def add(key, values, known):
        have = total.get(key)
        if have is None or len(have[0]) < len(values):
            grown = (np.zeros(len(values)), np.zeros(len(values), dtype=np.int64))
            for g, h in zip(grown, have or ()):
                g[: len(h)] += h
            have = total[key] = grown
        have[0][: len(values)] += values
        have[1][: len(values)] += known

    for batch in batches:
        lists = batch.column(0)
        per_id = lists.value_lengths().to_numpy(zero_copy_only=False)
        rows = lists.flatten()
        idx = np.repeat(np.arange(len(per_id)), per_id)
        lab = np.array([code.get(x, -1) for x in rows.field("label").to_pylist()], dtype=np.int64)
        size, whole, first, x, known = _read_vectors(rows.field("v"))
        flag, dist, best = np.zeros(len(lab), dtype=np.int8), np.zeros(len(lab)), np.zeros(len(lab), dtype=np.int64)
        groups = {(c, n) for c, n in zip(lab[whole].tolist(), size[whole].tolist()) if c >= 0}
        for c, n in groups:
            if (c, n) not in fit:
                fit[c, n] = _comparable([center for _, center in of[c]], n)
            at, vecs = fit[c, n]
            here = np.flatnonzero(whole & (lab == c) & (size == n))
            if len(at) < len(protos[c]):   # a centre without a distance
                best[here] = protos[c][np.setdiff1d(np.arange(len(protos[c])), at)[0]]
                continue
            d = _sq_distances(x[first[here][:, None] + np.arange(n)], vecs)
            near = np.where(np.isnan(d), np.inf, d).argmin(axis=1)
            flag[here], dist[here], best[here] = 1, d[np.arange(len(here)), near], protos[c][at[near]]
        for c in set(lab[~whole].tolist()) - {-1}:
            best[~whole & (lab == c)] = protos[c][0]
        ok = np.flatnonzero(lab >= 0)
        order = ok[np.lexsort((best[ok], dist[ok], flag[ok], idx[ok]))]
        ids, at = np.unique(idx[order], return_index=True)
        chosen = np.zeros(len(per_id), dtype=np.int64)
        chosen[ids] = best[order[at]]
        took = chosen[idx]
        for n in {n for _, n in groups}:
            here = np.flatnonzero(whole & (lab >= 0) & (size == n))
            here = here[np.lexsort((took[here], lab[here]))]
            key = np.stack([lab[here], took[here]])
            starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
            if n:
                sums = np.add.reduceat(x[first[here][:, None] + np.arange(n)], starts, axis=0)
                for k, many, values in zip(key[:, starts].T.tolist(), np.diff(np.r_[starts, len(here)]), sums):
                    add(tuple(k), values, np.full(n, many))
        for r in np.flatnonzero(~whole & (lab >= 0) & (size > 0)):
            part = slice(first[r], first[r] + size[r])
            add((int(lab[r]), int(took[r])), np.where(known[part], x[part], 0.0), known[part].astype(np.int64))
    keys = sorted(total)
    yield pa.RecordBatch.from_pydict({
        "code": pa.array([c for c, _ in keys], pa.int32()), "proto": pa.array([p for _, p in keys], pa.int32()),
        "sums": pa.array([total[k][0].tolist() for k in keys], pa.list_(pa.float64())),
        "known": pa.array([total[k][1].tolist() for k in keys], pa.list_(pa.int64()))})


def proto_votes(emb: DataFrame, protos: DataFrame, k: int = 5, b: float = 1.0, e: float = 1.0) -> DataFrame:
    """Weighted kNN vote of the k nearest rows (squared L2) for each prototype.

    weight = 1 / (b + d^e); predicted label = largest weight sum; ties go to
    the label met first (nearest neighbour).
    """
    q = protos.select(F.col("proto_id").alias("id"), F.col("center").alias("embedding"))
    nn = knn(q, emb.select("id", "embedding"), k=k, metric="sql2", exclude_self=False)
    lab = emb.select(F.col("id").alias("nbr"), "label")
    v = (nn.join(lab, "nbr").withColumn("w", kernel_weight("dist", b, e))
         .groupBy("q", "label").agg(F.sum("w").alias("sw"), F.min("nn_rank").alias("first")))
    best = v.groupBy("q").agg(F.min_by("label", F.struct(-F.col("sw"), F.col("first"))).alias("pred"))
    return best.select(F.col("q").alias("proto_id"), F.col("pred").cast("int").alias("pred"))


def dependence(emb: DataFrame, protos: DataFrame, votes: DataFrame, b: float = 1.0, e: float = 1.0,
               alpha: float = 0.5, b_factor: float = 1.0) -> DataFrame:
    """Sum over prototypes of the H6 weight / (b + ||x - p||^e).

    The prototype table has about sqrt(n/2C) C rows with a proven bound
    (D4), so every task holds it; the sample side streams past it, a block of
    rows and all prototypes at once.
    """
    model = [tuple(r) for r in protos.join(votes, "proto_id").select("label", "pred", F.col("center").cast("array<double>")).collect()]
    model = emb.sparkSession.sparkContext.broadcast(model)

    def kernel(batches):
        import pyarrow as pa

        given, voted, centers = (list(c) for c in zip(*model.value)) if model.value else ([], [], [])
        fit, weight = {}, {}
        for batch in batches:
            size, whole, first, x, _ = _read_vectors(batch.column("embedding"))
            labels = batch.column("label").to_pylist()
            score, there = np.zeros(len(labels)), np.zeros(len(labels), dtype=bool)
            for n in set(size[whole].tolist()):
                if n not in fit:
                    fit[n] = _comparable(centers, n)
                at, vecs = fit[n]
                here = np.flatnonzero(whole & (size == n))
                for lo in range(0, len(here) if len(at) else 0, 128):
                    rows = here[lo : lo + 128]
                    d = np.sqrt(_sq_distances(x[first[rows][:, None] + np.arange(n)], vecs))
                    for y in {labels[r] for r in rows}:
                        if y not in weight:
                            weight[y] = np.array([_label_weight(y, *yy, alpha, b_factor) for yy in zip(given, voted)])
                    w = np.stack([weight[labels[r]] for r in rows])[:, at]
                    score[rows], there[rows] = (w / (b + d ** e)).sum(axis=1), True
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score, mask=~there)], ["id", "_v"])

    kind = emb.schema["id"].dataType.simpleString()
    scored = emb.select("id", "label", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        kernel, f"id {kind}, _v double")
    return scored.groupBy("id").agg(F.sum("_v").alias("score"))


def _label_weight(y_i, y_j, y_p, alpha: float, b_factor: float) -> float:
    """:func:`dependence_weight` of three labels, with nulls as Spark compares them."""
    if y_i is not None and y_i == y_j:
        return -1.0
    if y_j is not None and y_j == y_p:
        return 1.0 - alpha
    return alpha if y_i is not None and y_p is not None and y_i != y_p else alpha * b_factor


def noise_rank(emb: DataFrame, k: int = 5, b: float = 1.0, e: float = 1.0, alpha: float = 0.5,
               b_factor: float = 1.0, seed: int = 42, rounds: int = 10) -> DataFrame:
    """``(rank, id, score)`` by dependence score descending, ties by id."""
    protos = freeze(prototypes(emb, seed, rounds))
    votes = proto_votes(emb, protos, k, b, e)
    s = dependence(emb, protos, votes, b, e, alpha, b_factor).withColumn("_key", -F.round("score", 9))
    return global_rank(s, ["_key", "id"], "rank").select("rank", "id", "score")


# --------------------------------------------------------------------------- #
# Cross-validated class probabilities and confident learning
# --------------------------------------------------------------------------- #

def fold_column(emb: DataFrame, folds: int = 10, seed: int = 42) -> DataFrame:
    """Stratified folds: position inside the class in hash order, modulo folds."""
    from tidemark.operators.contaminate import rank_within

    keyed = emb.withColumn("_h", hash_key(seed, "fold", "id"))
    r = rank_within(keyed, ["label"], ["_h", "id"], "_r")
    return r.withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(folds)).cast("int")).drop("_h", "_r")


def centroid_proba(emb: DataFrame, folds: int = 10, seed: int = 42, temperature: float = 0.1) -> DataFrame:
    """J12a (SQL-checkable estimator): nearest-centroid softmax, out of fold.

    For fold f, class centroids come from the other folds (per-fold sums
    minus the fold's own sums: one aggregate, no refit loop); a row's
    probability for class c is softmax over c of cos(x, centroid_c) / T.
    Output ``(id, label, fold, cls, p)`` long form.
    """
    fe = fold_column(emb, folds, seed)
    comp = fe.select("id", "label", "fold", F.posexplode("embedding").alias("i", "x"))
    per_fold = comp.groupBy("fold", "label", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("c"))
    total = per_fold.groupBy("label", "i").agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    folds_df = fe.select("fold").distinct()
    grid = folds_df.crossJoin(total)
    oof = (grid.join(per_fold, ["fold", "label", "i"], "left")
           .select("fold", F.col("label").alias("cls"), "i",
                   F.try_divide(F.col("ts") - F.coalesce(F.col("s"), F.lit(0.0)),
                                (F.col("tc") - F.coalesce(F.col("c"), F.lit(0))).cast("double")).alias("m")))
    cent = (oof.where(F.col("m").isNotNull())
            .groupBy("fold", "cls").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_s"))
            .select("fold", "cls", F.transform("_s", lambda s: s["m"]).alias("centroid")))
    # centroids: folds x classes rows of dim doubles - bounded by the class count
    j = fe.join(F.broadcast(cent), "fold")
    logits = j.select("id", "label", "fold", "cls",
                      ((F.lit(1.0) - 2 * half_cosine_distance("embedding", "centroid"))
                       / F.lit(temperature)).alias("z"))
    w = Window.partitionBy("id")
    mx = logits.withColumn("_mx", F.max("z").over(w))
    ex = mx.withColumn("_e", F.exp(F.col("z") - F.col("_mx")))
    return ex.withColumn("p", F.col("_e") / F.sum("_e").over(w)).select("id", "label", "fold", "cls", "p")


def label_quality(proba: DataFrame) -> DataFrame:
    """Probability of the given label, ascending (rank, id, score)."""
    s = proba.where(F.col("cls") == F.col("label")).select("id", F.col("p").alias("score"))
    s = s.withColumn("_key", F.round("score", 9))
    return global_rank(s, ["_key", "id"], "rank").select("rank", "id", "score")


def confident_joint(proba: DataFrame) -> DataFrame:
    """Per-class threshold t_j = mean p_j over rows labelled j; y* = argmax
    of p_j among classes with p_j >= t_j; counts by (given label, y*)."""
    thr = (proba.where(F.col("cls") == F.col("label"))
           .groupBy(F.col("cls")).agg(F.avg("p").alias("t")))
    above = proba.join(F.broadcast(thr), "cls").where(F.col("p") >= F.col("t"))
    ystar = above.groupBy("id", "label").agg(F.max_by("cls", F.struct("p", -F.col("cls"))).alias("y_star"))
    return (ystar.groupBy("label", "y_star").agg(F.count(F.lit(1)).cast("bigint").alias("n")))


# --------------------------------------------------------------------------- #
# Raster pair scores (the embedding read as an 8 x 8 raster)
# --------------------------------------------------------------------------- #

def dct_basis(size: int = 8) -> list[tuple[int, int, float]]:
    """Orthonormal-free DCT-II basis entries (u, x, cos(pi (2x + 1) u / 2N))."""
    return [(u, x, math.cos(math.pi * (2 * x + 1) * u / (2.0 * size)))
            for u in range(size) for x in range(size)]


def phash(emb: DataFrame, size: int = 8, vec_col: str = "embedding") -> DataFrame:
    """J4 hash once per row: 2-D DCT-II of the raster, bit = coefficient > median.

    Relational form: pixels (id, x, y, v) join the fixed basis twice (64 + 64
    rows, broadcast), sum to coefficients (id, u, v), take the median per id
    and pack the 64 bits into a bigint (bit index u * size + v).
    """
    spark = emb.sparkSession
    basis = spark.createDataFrame(dct_basis(size), "u int, x int, c double")
    px = emb.select("id", F.posexplode(vec_col).alias("p", "val")).select(
        "id", (F.col("p") / size).cast("int").alias("x"), F.pmod("p", F.lit(size)).alias("y"), "val")
    bu = basis.select(F.col("u"), F.col("x"), F.col("c").alias("cu"))
    bv = basis.select(F.col("u").alias("v"), F.col("x").alias("y"), F.col("c").alias("cv"))
    # separable 2-D DCT: transform the rows, then the columns (8 x fewer
    # intermediate rows than the direct double sum)
    rows = (px.join(F.broadcast(bv), "y")
            .groupBy("id", "x", "v").agg(F.sum(F.col("val") * F.col("cv")).alias("t")))
    coef = (rows.join(F.broadcast(bu), "x")
            .groupBy("id", "u", "v").agg(F.sum(F.col("t") * F.col("cu")).alias("coef")))
    med = coef.groupBy("id").agg(F.percentile("coef", F.lit(0.5)).alias("med"))
    bits = coef.join(med, "id").where(F.round(F.col("coef"), 12) > F.round(F.col("med"), 12))
    return (bits.groupBy("id").agg(
        F.sum(F.expr(f"shiftleft(CAST(1 AS BIGINT), u * {size} + v)")).alias("hash"))
        .join(emb.select("id"), "id", "right").select("id", F.coalesce("hash", F.lit(0)).cast("bigint").alias("hash")))


def _bits(hashes: DataFrame) -> DataFrame:
    """The 64 bits of each hash as a 0/1 vector."""
    return hashes.select("id", F.expr("transform(sequence(0, 63), i -> CAST((shiftright(hash, i) & 1) AS DOUBLE))")
                         .alias("embedding"))


def phash_pairs(emb: DataFrame, max_bits: int | None = None) -> DataFrame:
    """J4 pairs: normalised Hamming distance of the hashes, ranked ascending.

    ``max_bits`` asks for close pairs only: the 64 bits are cut into
    ``max_bits // 2 + 1`` bands, so of at most ``max_bits`` differing bits some
    band holds one at most (pigeonhole). Distinct hashes meet where a band of
    one equals a band of the other or differs from it in one bit; for 7 bits
    that is 4 bands of 16 bits with 17 keys on one side. Hashes are compared
    once, however many rows share them.
    """
    h = phash(emb)
    if max_bits is None:
        return _ranked_by_counts(h)
    bands = max_bits // 2 + 1
    width = 64 // bands
    last = 64 - width * (bands - 1)   # the last band takes the bits that are left over
    hashes = h.select("hash").distinct()
    keyed = hashes.select("hash", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")).withColumn(
        "bkey", F.expr(f"shiftrightunsigned(hash, band * {width}) & "
                       f"IF(band = {bands - 1}, {_ones(last)}L, {_ones(width)}L)"))
    near = keyed.withColumn("bkey", F.explode(F.expr(
        f"concat(array(bkey), transform(sequence(0, IF(band = {bands - 1}, {last}, {width}) - 1), "
        "b -> bkey ^ shiftleft(CAST(1 AS BIGINT), b)))")))
    met = (keyed.select(F.col("hash").alias("hi"), "band", "bkey")
           .join(near.select(F.col("hash").alias("hj"), "band", "bkey"), ["band", "bkey"])
           .where((F.col("hi") <= F.col("hj"))
                  & (F.bit_count(F.col("hi").bitwiseXOR(F.col("hj"))) <= max_bits)).select("hi", "hj").distinct())
    a = h.select(F.col("id").alias("a"), F.col("hash").alias("hi"))
    b = h.select(F.col("id").alias("b"), F.col("hash").alias("hj"))
    pairs = (met.join(a, "hi").join(b, "hj").where((F.col("hi") != F.col("hj")) | (F.col("a") < F.col("b")))
             .select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"),
                     (F.bit_count(F.col("hi").bitwiseXOR(F.col("hj"))) / F.lit(64.0)).alias("score")))
    return global_rank(pairs, ["score", "i", "j"], "rank").select("rank", "i", "j", "score")


LEVELS = 65          # numbers of differing bits
PAIRS_OUT = 1 << 20  # pairs of an output frame, about


def _ranked_by_counts(hashes: DataFrame, block_rows: int = 1024) -> DataFrame:
    """All pairs of hashes ranked by (score, i, j); no pair is sorted, shuffled or written.

    There are only 65 scores, so a pair's rank is a sum of counts: the pairs of lower scores, those of its score in
    earlier rows, and those before it in its own row. Ids lie in blocks in their order; a cell holds some blocks and
    streams the later ones past them, in order. Pass 1 counts the pairs of each row and score (65 numbers a row, written
    to the checkpoint folder), pass 2 compares the blocks again and numbers their pairs as it goes. An id that comes
    ``m`` times is held once, with its number.
    """
    spark = hashes.sparkSession
    ids = hashes.where("id is not null").groupBy("id").agg(F.max("hash").alias("hash"), F.count(F.lit(1)).alias("m"))
    placed = global_rank(ids, ["id"], "_pos").withColumn("blk", F.floor((F.col("_pos") - 1) / block_rows).cast("int"))
    blocks = freeze(placed.groupBy("blk").agg(F.sort_array(F.collect_list(F.struct("id", "hash", "m"))).alias("_r"))
                    .select("blk", F.col("_r.id").alias("ids"), F.col("_r.hash").alias("hashes"), F.col("_r.m").alias("m")))
    n_blocks = blocks.count()
    n_cells = max(1, min(n_blocks, max(4 * spark.sparkContext.defaultParallelism, math.ceil(n_blocks * block_rows / SIDE_ROWS))))
    met = blocks.withColumn("cell", F.explode(F.sequence(F.lit(0), F.least("blk", F.lit(n_cells - 1))))).withColumn("role", F.lit(1))

    def cells(held):
        held = held.withColumn("cell", F.pmod("blk", F.lit(n_cells))).withColumn("role", F.lit(0))
        return _dealt(held.unionByName(met, allowMissingColumns=True), n_cells)

    def count_kernel(frames):
        for _, rows in _by_cell(frames):
            held = []
            for row in rows:
                if row.role == 0:
                    held.append((row, np.zeros((len(row.ids), LEVELS), dtype=np.int64)))
                    continue
                for a, counts in held:
                    if a.blk <= row.blk:
                        counts += _level_counts(_bits_apart(a, row), row.m)
            for a, counts in held:
                m = np.asarray(a.m, dtype=np.int64)
                counts *= m[:, None]
                counts[:, 0] += m * (m - 1) // 2   # an id's pairs with itself
                yield pd.DataFrame({"blk": [a.blk], "counts": [counts.ravel()], "total": [counts.sum(0)]})

    counted = freeze(cells(blocks).mapInPandas(count_kernel, "blk int, counts array<bigint>, total array<bigint>"))
    total = counted.select("blk", F.posexplode("total").alias("level", "c"))   # 65 rows a block
    earlier = F.sum("c").over(Window.partitionBy("level").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))
    lower = (total.groupBy("level").agg(F.sum("c").alias("c"))   # 65 rows
             .select("level", F.sum("c").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)).alias("lower")))
    before = (total.withColumn("earlier", earlier).join(F.broadcast(lower), "level")
              .withColumn("before", F.coalesce("earlier", F.lit(0)) + F.coalesce("lower", F.lit(0)))
              .groupBy("blk").agg(F.sort_array(F.collect_list(F.struct("level", "before"))).alias("_b"))
              .select("blk", F.col("_b.before").cast("array<bigint>").alias("before")))
    held = blocks.join(counted.select("blk", "counts"), "blk").join(before, "blk")

    def rank_kernel(frames):
        for _, rows in _by_cell(frames):
            held = []
            for row in rows:
                if row.role == 0:
                    counts = np.asarray(row.counts, dtype=np.int64).reshape(-1, LEVELS)
                    nxt = np.asarray(row.before, dtype=np.int64) + np.cumsum(counts, axis=0) - counts
                    m = np.asarray(row.m, dtype=np.int64)
                    own = np.flatnonzero(m > 1)
                    times = m[own] * (m[own] - 1) // 2
                    yield from _numbered_pairs(row.ids[own], row.ids[own], np.zeros(len(own)), nxt[own, 0], times)
                    nxt[own, 0] += times
                    held.append((row._replace(counts=None), m, nxt))   # the next rank of each row and score
                    continue
                mb = np.asarray(row.m, dtype=np.int64)
                for a, m, nxt in held:
                    if a.blk > row.blk:
                        continue
                    d = _bits_apart(a, row)
                    counts = _level_counts(d, row.m)
                    order = np.argsort(d, axis=1, kind="stable")
                    level = np.take_along_axis(d, order, 1).astype(np.int64)
                    w = mb[order]
                    start = np.pad(np.cumsum(counts, axis=1) - counts, ((0, 0), (0, 1)))   # where a score's pairs begin in their row
                    x = np.broadcast_to(np.arange(len(m))[:, None], d.shape)
                    at = np.cumsum(w, axis=1) - w - start[x, level]
                    here = level < LEVELS
                    x, level = x[here], level[here]
                    yield from _numbered_pairs(a.ids[x], row.ids[order[here]], level / 64.0,
                                               nxt[x, level] + m[x] * at[here], m[x] * w[here])
                    nxt += m[:, None] * counts

    return cells(held).mapInPandas(rank_kernel, "rank bigint, i bigint, j bigint, score double")


def _bits_apart(a, b) -> np.ndarray:
    """Differing bits of the hashes of two blocks; ``LEVELS`` in the half of a block's pairs with itself that doesn't count."""
    d = np.bitwise_count(np.asarray(a.hashes, dtype=np.int64).view(np.uint64)[:, None]
                         ^ np.asarray(b.hashes, dtype=np.int64).view(np.uint64)[None, :])
    if a.blk == b.blk:
        d[np.tril_indices(len(d))] = LEVELS
    return d


def _level_counts(d: np.ndarray, m) -> np.ndarray:
    """How many rows of the second block lie at each score of each row of the first, by their numbers ``m``."""
    m = np.asarray(m, dtype=np.int64)
    at = (d + np.arange(len(d))[:, None] * (LEVELS + 1)).ravel()
    c = np.bincount(at, None if (m == 1).all() else np.tile(m, len(d)), len(d) * (LEVELS + 1))   # exact below 2^53
    return c.astype(np.int64).reshape(len(d), LEVELS + 1)[:, :LEVELS]


def _numbered_pairs(i, j, score, before, times):
    """Frames of pairs that come ``times`` each, ranked from ``before + 1``."""
    if (times == 1).all():
        if len(i):
            yield pd.DataFrame({"rank": before + 1, "i": i, "j": j, "score": score})
        return
    ends = np.cumsum(times)
    for lo in range(0, int(ends[-1]), PAIRS_OUT):
        k = np.arange(lo, min(lo + PAIRS_OUT, int(ends[-1])))
        at = np.searchsorted(ends, k, side="right")
        yield pd.DataFrame({"rank": before[at] + 1 + k - (ends[at] - times[at]), "i": i[at], "j": j[at], "score": score[at]})


def _ones(bits: int) -> int:
    return (1 << min(bits, 63)) - 1 if bits < 64 else -1


def _windows(v: np.ndarray, size: int, win: int):
    """Mean, sample variance and centred pixels of every window position of a block's rasters."""
    npx = win * win
    r = v.reshape(len(v), size, size)
    for a in range(size - win + 1):
        for b in range(size - win + 1):
            w = r[:, a:a + win, b:b + win].reshape(len(v), -1)
            m = w.mean(axis=1)
            yield m, w.var(axis=1) * npx / (npx - 1), w - m[:, None]


class Ssim(Filtered):
    """1 - SSIM of rasters whose values span ``rng`` in their table."""

    def __init__(self, rng: float, size: int = 8, win: int = 7):
        self.size, self.win, self.rng, self.of_one = size, win, rng, (win * win - 1)
        self.c1, self.c2 = (0.01 * rng) ** 2, (0.03 * rng) ** 2

    def all(self, va, vb):
        """All pairs of two blocks of vectors, one matrix product for each window position."""
        s, c1, c2 = 0.0, self.c1, self.c2
        for (ma, sa, ca), (mb, sb, cb) in zip(_windows(va, self.size, self.win), _windows(vb, self.size, self.win)):
            num = (2 * ma[:, None] * mb[None, :] + c1) * (2 * (ca @ cb.T) / self.of_one + c2)
            s = s + num / ((ma[:, None] ** 2 + mb[None, :] ** 2 + c1) * (sa[:, None] + sb[None, :] + c2))
        return 1.0 - s / (self.size - self.win + 1) ** 2

    def prepared(self, v):
        exact = [(m, s, np.ascontiguousarray(c.T)) for m, s, c in _windows(v, self.size, self.win)]
        # in units of the span, so that single precision neither over- nor underflows
        unit = self.rng or 1.0
        rough = [tuple(x.astype(np.float32) for x in (m / unit, s / unit**2, c * (math.sqrt(2 / self.of_one) / unit)))
                 for m, s, c in _windows(v, self.size, self.win)]
        return exact, rough

    def margin(self, a):
        return 1e-4   # sums of some fifty products relative to the larger of their factors, twice over

    def rough(self, a, b):
        unit = self.rng or 1.0
        c1, c2 = np.float32(self.c1 / unit**2), np.float32(self.c2 / unit**2)
        n = np.float32((self.size - self.win + 1) ** 2)
        out = np.empty((len(a[1][0][0]), len(b[1][0][0])), dtype=np.float32)
        with np.errstate(all="ignore"):
            for lo in range(0, len(out), 128):
                s = out[lo : lo + 128]
                s[:] = 1
                for (ma, sa, ca), (mb, sb, cb) in zip(a[1], b[1]):
                    ma, sa = ma[lo : lo + 128, None], sa[lo : lo + 128, None]
                    num = ca[lo : lo + 128] @ cb.T
                    num += c2
                    t = ma * (2 * mb)
                    t += c1
                    num *= t
                    np.add(ma * ma, mb * mb + c1, out=t)
                    num /= t
                    np.add(sa, sb + c2, out=t)
                    num /= t
                    num /= n
                    s -= num
        return out

    def of(self, a, b, ii, jj):
        s, c1, c2 = 0.0, self.c1, self.c2
        with np.errstate(all="ignore"):
            for (ma, sa, ca), (mb, sb, cb) in zip(a[0], b[0]):
                num = (2 * ma[ii] * mb[jj] + c1) * (2 * _products(ca, cb, ii, jj) / self.of_one + c2)
                s = s + num / ((ma[ii] ** 2 + mb[jj] ** 2 + c1) * (sa[ii] + sb[jj] + c2))
        return 1.0 - s / (self.size - self.win + 1) ** 2


def _ssim_metric(emb: DataFrame, size: int = 8, win: int = 7, vec_col: str = "embedding") -> Ssim:
    rng = emb.select(F.explode(vec_col).alias("v")).agg((F.max("v") - F.min("v")).alias("L")).first()["L"] or 0.0
    return Ssim(rng, size, win)


class Hamming(Whole):
    """Share of differing bits of 0/1 vectors."""

    def __init__(self):
        super().__init__(lambda a, b: self._apart(self.prepared(a), self.prepared(b)) / self.prepared(a)[1])

    def prepared(self, v):
        bits = np.pad(v.astype(bool), ((0, 0), (0, -v.shape[1] % 64)))
        return np.packbits(bits, axis=1).view(np.uint64), float(v.shape[1])

    def _apart(self, a, b):
        d = np.zeros((len(a[0]), len(b[0])), dtype=np.int16)
        for k in range(a[0].shape[1]):
            d += np.bitwise_count(a[0][:, k, None] ^ b[0][None, :, k])
        return d

    def rough(self, a, b):
        return self._apart(a, b) / a[1]

    def within(self, a, b, far):
        d = self._apart(a, b).ravel()
        at = np.flatnonzero(d <= math.floor(min(max(far, -1.0), 2.0) * a[1]))
        return at, d[at] / a[1]

    def of(self, a, b, ii, jj):
        return np.bitwise_count(a[0][ii] ^ b[0][jj]).sum(axis=1) / a[1]


def ssim_pairs(emb: DataFrame, size: int = 8, win: int = 7, vec_col: str = "embedding") -> DataFrame:
    """1 - SSIM of every raster pair, ranked ascending.

    Uniform ``win x win`` windows at interior positions, sample covariance
    (N / (N - 1)), C1 = (.01 L)^2, C2 = (.03 L)^2 with L the data range of
    the table. Per-pair work runs in the block kernel.
    """
    pairs = all_pairs(emb, "id", vec_col, _ssim_metric(emb, size, win, vec_col)).withColumnRenamed("dist", "score")
    pairs = pairs.withColumn("_key", F.round("score", 9))
    return global_rank(pairs, ["_key", "i", "j"], "rank").select("rank", "i", "j", "score")


# --------------------------------------------------------------------------- #
# Isolation forest
# --------------------------------------------------------------------------- #

def _c_factor(n: float) -> float:
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def isolation_forest(emb: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42,
                     max_depth: int | None = None) -> DataFrame:
    """J7 (Liu et al. 2008): score = 2^(-E[h(x)] / c(sample)).

    Each tree's subsample is the ``sample`` rows first in a per-tree hash
    order (a join of ids with tree numbers, then a rank inside the tree).
    Trees are grown by ``applyInPandas`` grouped by tree (bounded: ``sample``
    rows each) and scored by ``mapInPandas`` over the data with the forest
    broadcast - the forest is ``trees * 2 * sample`` nodes at most.
    """
    spark = emb.sparkSession
    depth = max_depth or int(math.ceil(math.log2(max(sample, 2))))
    n = emb.count()
    keep = min(1.0, 4.0 * sample / max(n, 1))
    # each row lists the trees whose cheap hash draw keeps it (expected
    # 4 * sample rows per tree, ~4 * sample * trees / n trees per row), so the
    # table is never expanded by the tree count; then an exact top-`sample`
    # inside each tree's bounded candidate set
    def u_of(t):
        return (F.pmod(F.xxhash64(F.lit(seed), t, F.col("id")), F.lit(1 << 30)).cast("double")
                / F.lit(float(1 << 30)))

    picked = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(trees - 1).cast("bigint")),
                      lambda t: u_of(t) < F.lit(keep))
    cand = (emb.select("id", F.explode(picked).alias("tree"))
            .withColumn("_u", u_of(F.col("tree"))))
    w = Window.partitionBy("tree").orderBy("_u", "id")
    sub = (cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample)
           .join(emb.select("id", "embedding"), "id").select("tree", "id", "embedding"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 100003 + t)
        x = np.stack(pdf.sort_values("id")["embedding"].to_numpy()).astype(np.float64)
        nodes = []   # [node, feature, threshold, left, right, size]

        def build(idx, d):
            nid = len(nodes)
            nodes.append([nid, -1, 0.0, -1, -1, len(idx)])
            if d >= depth or len(idx) <= 1:
                return nid
            xs = x[idx]
            lo, hi = xs.min(axis=0), xs.max(axis=0)
            cnd = np.nonzero(hi > lo)[0]
            if len(cnd) == 0:
                return nid
            f = int(rng.choice(cnd))
            thr = float(rng.uniform(lo[f], hi[f]))
            nodes[nid][1], nodes[nid][2] = f, thr
            nodes[nid][3] = build(idx[xs[:, f] < thr], d + 1)
            nodes[nid][4] = build(idx[xs[:, f] >= thr], d + 1)
            return nid

        build(np.arange(len(x)), 0)
        cols = list(zip(*nodes))
        return pd.DataFrame({"tree": t, "node": cols[0], "feat": cols[1], "thr": cols[2],
                             "left": cols[3], "right": cols[4], "size": cols[5]})

    forest = sub.groupBy("tree").applyInPandas(
        grow, "tree long, node long, feat long, thr double, left long, right long, size long")
    # the fitted model: at most trees * (2 * sample - 1) nodes, a proven bound
    forest_pdf = forest.toPandas()
    bc = spark.sparkContext.broadcast(forest_pdf)
    cn = _c_factor(min(sample, n))

    def score(batches):
        f = bc.value
        tables = []
        for _, g in f.groupby("tree"):
            g = g.sort_values("node")
            leaf_adj = np.array([_c_factor(sz) for sz in g["size"]])
            tables.append((g["feat"].to_numpy(), g["thr"].to_numpy(), g["left"].to_numpy(),
                           g["right"].to_numpy(), leaf_adj))
        for pdf in batches:
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            rows = np.arange(len(x))
            h = np.zeros(len(x))
            for feat, thr, left, right, leaf_adj in tables:
                node = np.zeros(len(x), dtype=np.int64)
                d = np.zeros(len(x))
                for _ in range(depth + 1):
                    inner = feat[node] >= 0
                    if not inner.any():
                        break
                    fv = x[rows, np.where(inner, feat[node], 0)]
                    nxt = np.where(fv < thr[node], left[node], right[node])
                    node = np.where(inner, nxt, node)
                    d = d + inner
                h += d + leaf_adj[node]
            h /= max(len(tables), 1)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "score": np.power(2.0, -h / cn)})

    return emb.select("id", "embedding").mapInPandas(score, "id bigint, score double")


def _outlier(scorer):
    return lambda emb: outliers(emb, scorer)


def confident_learning(emb: DataFrame, proba=centroid_proba) -> DataFrame:
    """Label quality from out-of-fold class probabilities; ``proba`` is any
    ``DataFrame -> (id, label, cls, p)`` estimator."""
    return label_quality(proba(emb))


# Issue type -> detector name -> ``DataFrame -> ranking`` (rank and id, or i and j)
DETECTORS = {
    "near_duplicate": {"ssim": ssim_pairs, "phash": phash_pairs},
    "label_error": {"noise_rank": noise_rank, "knn_agreement": knn_agreement,
                    "confident_learning": confident_learning},
    "off_topic": {"ecod": _outlier(ecod), "hbos": _outlier(hbos), "knn": _outlier(knn_distance),
                  "iforest": _outlier(isolation_forest)},
}


# pair detectors whose ranking is by one measure of two rows: ``emb -> (vectors, measure)``
PAIR_MEASURES = {
    ssim_pairs: lambda emb: (emb.where("embedding is not null"), _ssim_metric(emb)),
    phash_pairs: lambda emb: (freeze(_bits(phash(emb))), Hamming()),
}


def compare(emb: DataFrame, truth: DataFrame, detectors: dict | None = None) -> DataFrame:
    """Ranking metrics of every registered detector against ``truth``
    (``issue_type, id, id2``), keyed by ``(issue, detector)``.

    Of the pair detectors in :data:`PAIR_MEASURES` only the ranks of the truth
    pairs among all pairs are computed; their n^2 rankings are not written.
    """
    from tidemark.operators.metrics import metrics_from_hit_ranks, ranking_metrics
    from tidemark.operators.truth import id_hits, pair_hits

    out = None
    for issue, named in (detectors or DETECTORS).items():
        t = truth.where(F.col("issue_type") == issue)
        for name, rank in named.items():
            if rank in PAIR_MEASURES:
                vectors, measure = PAIR_MEASURES[rank](emb)
                n = vectors.count()
                m = metrics_from_hit_ranks(pair_hit_ranks(vectors, t, metric=measure, repeats=True), n * (n - 1) // 2)
            else:
                ranked = rank(emb)
                hits = pair_hits(ranked, t) if "j" in ranked.columns else id_hits(ranked, t)
                m = ranking_metrics(hits.select("rank", "hit"))
            m = m.select(F.lit(issue).alias("issue"), F.lit(name).alias("detector"), "*")
            out = m if out is None else out.unionByName(m)
    return out
