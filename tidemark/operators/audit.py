"""The audit core (J1a-J1c) and the automatic cut.

Issue tables share one long schema (§1 of the survey):
``issues(issue_type, rank, id, id2, score)`` - ``id2`` only for pairs.

* J1a near-duplicates: every pair ``i < j`` by the audit distance
  d = (1 - cos) / 2, ascending, ties by (i, j).
* J1b off-topic: isolation in the single-linkage hierarchy of the kNN graph,
  read from its minimum spanning forest at a ladder of distance levels
  (:mod:`tidemark.operators.linkage`).
* J1c label errors: d_other^2 / (d_same^2 + d_other^2) with the nearest
  same- and other-class distances, ascending (a missing same-class
  neighbour counts as distance 1, 0/0 as 0.5).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import logit
from tidemark.operators.linkage import components, spanning_forest
from tidemark.operators.pairs import all_pairs, knn, nearest_by_label, pair_hit_ranks, pair_order_statistics
from tidemark.operators.quantiles import quantiles
from tidemark.operators.ranking import freeze, global_rank

ISSUE_COLS = ["issue_type", "rank", "id", "id2", "score"]


def near_duplicate_audit(emb: DataFrame, max_dist: float | None = None,
                         block_rows: int = 1024, top: int | None = None) -> DataFrame:
    """Ranked pairs ``(rank, i, j, score)``; ``max_dist`` keeps close pairs only, ``top`` the head of the ranking."""
    pairs = all_pairs(emb, "id", "embedding", "half_cosine", max_dist=max_dist,
                      block_rows=block_rows, top=top)
    pairs = pairs.withColumn("_key", F.round("dist", 9))
    ranked = global_rank(pairs, ["_key", "i", "j"], "rank")
    return ranked.select("rank", "i", "j", F.col("dist").alias("score"))


def near_duplicate_cut(emb: DataFrame, alpha: float = 0.1, q: float = 0.05, block_rows: int = 1024) -> DataFrame:
    """J1a + J2: the pairs ``(i, j, score)`` that :func:`auto_cut` flags in the ranking of all pairs.

    The cut needs two quantiles of all scores and their number; they are taken
    exactly from the block kernel, and only pairs near the cut are built.
    """
    n = emb.where("id is not null and embedding is not null").count()
    n = n * (n - 1) // 2
    none = emb.sparkSession.createDataFrame([], "i bigint, j bigint, score double")
    if not n:
        return none
    spots = {p: p * (n - 1) for p in (alpha, 0.5)}
    places = sorted({int(f(x)) for x in spots.values() for f in (math.floor, math.ceil)})
    z = {k: _logistic_ppf(min(max(d, 1e-9), 1 - 1e-9)) for k, d in
         pair_order_statistics(emb, places, block_rows=block_rows).items()}
    x1, x2 = (z[math.floor(x)] + (z[math.ceil(x)] - z[math.floor(x)]) * (x - math.floor(x)) for x in spots.values())
    y1, y2 = _logistic_ppf(alpha), _logistic_ppf(0.5)
    scale, loc = (x1 - x2) / (y1 - y2), (y1 * x2 - y2 * x1) / (y1 - y2)
    if not scale > 0:
        return none
    far = None if q >= n else 1 / (1 + math.exp(-min(max(loc + scale * _logistic_ppf(q / n), -700), 700))) + 1e-8
    pairs = all_pairs(emb, max_dist=far, block_rows=block_rows)
    cdf = F.lit(1.0) / (F.lit(1.0) + F.exp(-(logit(F.col("dist")) - F.lit(loc)) / F.lit(scale)))
    return pairs.where(F.lit(float(n)) * cdf <= F.lit(q)).select("i", "j", F.col("dist").alias("score"))


def near_duplicate_eval(emb: DataFrame, truth: DataFrame, block_rows: int = 1024) -> DataFrame:
    """L1 (duplicates) metrics of the J1a ranking against truth pairs.

    Scale path: only the ranks of the truth pairs are computed (histogram of
    pair keys per block pair, no n^2 ranking is written or sorted).
    """
    from tidemark.operators.metrics import metrics_from_hit_ranks

    hr = pair_hit_ranks(emb, truth, block_rows=block_rows)
    n_items = hr.select("n_items").first()
    n_items = n_items[0] if n_items is not None else emb.count() * (emb.count() - 1) // 2
    return metrics_from_hit_ranks(hr, n_items)


def label_error_scores(emb: DataFrame, block_rows: int = 1024) -> DataFrame:
    """J1c scores ``(id, score)`` before ranking."""
    nn = nearest_by_label(emb, "id", "embedding", "label", "half_cosine", block_rows)
    ds = F.coalesce(F.nanvl(F.col("d_same"), F.lit(None)), F.lit(1.0))
    do = F.nanvl(F.col("d_other"), F.lit(None))
    den = ds * ds + do * do
    score = F.when(do.isNull(), F.lit(1.0)).when(den == 0, F.lit(0.5)).otherwise(
        F.try_divide(do * do, den))
    return nn.select("id", score.alias("score"))


def label_error_audit(emb: DataFrame, block_rows: int = 1024) -> DataFrame:
    """``(rank, id, score)`` ascending by score, ties by id."""
    s = label_error_scores(emb, block_rows).withColumn("_key", F.round("score", 9))
    return global_rank(s, ["_key", "id"], "rank").select("rank", "id", "score")


def off_topic_scores(emb: DataFrame, k: int = 10, levels: int = 16) -> DataFrame:
    """J1b scores ``(id, score)``: mean over distance levels of ln(n / component size).

    The kNN graph (k neighbours, symmetrised; lengths rounded to 9 places) is
    cut at ``levels`` quantiles of its edge lengths. Single linkage needs only
    its minimum spanning forest: what is connected below a cut in the graph is
    connected in the forest. All levels are contracted together, keyed by
    ``level``.
    """
    nbrs = knn(emb, k=k, metric="half_cosine", exclude_self=True)
    edges = freeze(nbrs.select(F.least("q", "nbr").alias("a"), F.greatest("q", "nbr").alias("b"), "dist")
                   .groupBy("a", "b").agg(F.round(F.min("dist"), 9).alias("dist")))
    qs = [(i + 1) / float(levels + 1) for i in range(levels)]
    names = [f"c{i}" for i in range(levels)]
    cuts = quantiles(edges, "dist", qs, names=names).select(F.array(*names).alias("cuts"))
    lv = cuts.select(F.posexplode("cuts").alias("level", "cut"))
    merges = spanning_forest(edges)
    kept = freeze(merges.crossJoin(F.broadcast(lv)).where(F.col("dist") <= F.col("cut")).select("level", "a", "b", "dist"))
    nodes = emb.select("id").crossJoin(F.broadcast(lv.select("level")))
    comp = components(nodes, kept, ["level"])
    n = emb.agg(F.count(F.lit(1)).cast("double").alias("_n"))
    sizes = comp.groupBy("level", "comp").agg(F.count(F.lit(1)).alias("size"))
    scored = (comp.join(sizes, ["level", "comp"]).crossJoin(n)
              .groupBy("id").agg((F.sum(F.log(F.col("_n") / F.col("size"))) / F.lit(float(levels)))
                                 .alias("score")))
    return scored


def off_topic_audit(emb: DataFrame, k: int = 10, levels: int = 16) -> DataFrame:
    """``(rank, id, score)`` descending (most isolated first)."""
    s = off_topic_scores(emb, k, levels).withColumn("_key", -F.round("score", 9))
    return global_rank(s, ["_key", "id"], "rank").select("rank", "id", "score")


def audit(emb: DataFrame, types=("near_duplicate", "off_topic", "label_error"),
          max_dist: float | None = None) -> DataFrame:
    """The long issue table for the requested issue types."""
    parts = []
    if "near_duplicate" in types:
        d = near_duplicate_audit(emb, max_dist)
        parts.append(d.select(F.lit("near_duplicate").alias("issue_type"), "rank",
                              F.col("i").alias("id"), F.col("j").alias("id2"), "score"))
    if "off_topic" in types:
        o = off_topic_audit(emb)
        parts.append(o.select(F.lit("off_topic").alias("issue_type"), "rank", "id",
                              F.lit(None).cast("bigint").alias("id2"), "score"))
    if "label_error" in types:
        lab = label_error_audit(emb)
        parts.append(lab.select(F.lit("label_error").alias("issue_type"), "rank", "id",
                                F.lit(None).cast("bigint").alias("id2"), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Standard logistic quantile function, ppf(p) = ln(p / (1 - p)).
def _logistic_ppf(p: float) -> float:
    return math.log(p / (1.0 - p))


def auto_cut(ranked: DataFrame, alpha: float = 0.1, q: float = 0.05,
             high_is_bad: bool = False, by: list[str] | None = None) -> DataFrame:
    """Flag the head of a ranking whose scores are improbably extreme.

    Scores s in [0, 1] where low = suspicious (``high_is_bad`` flips them
    after rescaling to [0, 1]). z = logit(s); (scale, loc) from the empirical
    quantiles of z at (alpha, 0.5) matched to the logistic ppf (D15); flag
    when n * F((z - loc) / scale) <= q. scale <= 0 flags nothing.
    Output: the input plus ``flagged boolean``.
    """
    by = list(by or [])
    s = F.col("score")
    if high_is_bad:
        mm = ranked.groupBy(*by).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
        ranked = (ranked.join(mm, by) if by else ranked.crossJoin(mm))
        s = F.lit(1.0) - F.coalesce(F.try_divide(F.col("score") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    z = ranked.withColumn("_z", logit(s))
    y1, y2 = _logistic_ppf(alpha), _logistic_ppf(0.5)
    z = freeze(z)
    fit = quantiles(z, "_z", [alpha, 0.5], by, ["_x1", "_x2"])
    total = z.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    fit = fit.drop("n").join(total, by) if by else fit.drop("n").crossJoin(total)   # one row each
    fit = fit.select(*by, "_n", ((F.col("_x1") - F.col("_x2")) / F.lit(y1 - y2)).alias("_scale"),
                     ((F.lit(y1) * F.col("_x2") - F.lit(y2) * F.col("_x1")) / F.lit(y1 - y2)).alias("_loc"))
    j = z.join(fit, by) if by else z.crossJoin(fit)
    cdf = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.try_divide(F.col("_z") - F.col("_loc"), F.col("_scale"))))
    flagged = F.when(F.col("_scale") > 0, F.col("_n") * cdf <= F.lit(q)).otherwise(F.lit(False))
    return j.withColumn("flagged", F.coalesce(flagged, F.lit(False))).drop(
        "_z", "_n", "_scale", "_loc", "_lo", "_hi")
