"""Significance tests and summaries.

Tests are aggregations over ranked samples; p-values use the normal
approximation with tie correction and the A&S 7.1.26 ``erf`` (no SciPy).
Everything is grouped by optional ``by`` columns so many tests run in one
job.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import normal_cdf, pvalue_stars
from tidemark.operators.exact_ranks import LARGEST_PRODUCT, rank_sum_test, signed_rank_test
from tidemark.operators.quantiles import quantiles
from tidemark.operators.sequences import average_rank


def _sf(z) -> F.Column:
    """Upper tail of the standard normal."""
    return F.lit(1.0) - normal_cdf(z)


def mann_whitney(df: DataFrame, value: str, group: str, x_label, by: list[str] | None = None,
                 id_col: str = "id", exact_upto: int = 0) -> DataFrame:
    """One-sided (X greater) Mann-Whitney U without continuity correction.

    U = R_x - n_x (n_x + 1) / 2 with average ranks over both samples;
    sigma^2 = n_x n_y / 12 ((n + 1) - sum(t^3 - t) / (n (n - 1))).
    Emits ``u, z, p, r_b = 2U / (n_x n_y)`` (the reference's effect size)
    and ``r_rb = r_b - 1`` (the rank-biserial correlation), plus stars.
    Groups without ties whose smaller sample has at most ``exact_upto`` rows
    (8 in the reference's default) get the exact p, up to a product of the
    sizes of ``exact_ranks.LARGEST_PRODUCT``.
    """
    by = list(by or [])
    r = average_rank(df, value, "_ar", by, id_col)
    is_x = F.col(group) == F.lit(x_label)
    sums = r.groupBy(*by).agg(
        F.sum(F.when(is_x, F.col("_ar"))).alias("r_x"),
        F.sum(F.when(is_x, 1).otherwise(0)).cast("double").alias("n_x"),
        F.sum(F.when(is_x, 0).otherwise(1)).cast("double").alias("n_y"))
    ties = (r.groupBy(*by, value).agg(F.count(F.lit(1)).cast("double").alias("_t"))
            .groupBy(*by).agg(F.sum(F.col("_t") ** 3 - F.col("_t")).alias("tie")))
    j = sums.join(ties, by) if by else sums.crossJoin(ties)
    n = F.col("n_x") + F.col("n_y")
    u = F.col("r_x") - F.col("n_x") * (F.col("n_x") + 1) / 2
    var = F.col("n_x") * F.col("n_y") / 12 * ((n + 1) - F.try_divide(F.col("tie"), n * (n - 1)))
    z = F.try_divide(u - F.col("n_x") * F.col("n_y") / 2, F.sqrt(var))
    p = _sf(z)
    if exact_upto:
        small = ((F.least("n_x", "n_y") <= exact_upto) & (F.least("n_x", "n_y") > 0) & (F.col("tie") == 0)
                 & (F.col("n_x") * F.col("n_y") <= LARGEST_PRODUCT))
        # rows that don't qualify go as a table of one against one
        p = F.when(small, rank_sum_test(*(F.when(small, c).otherwise(F.lit(1.0)) for c in (
            F.col("n_x"), F.col("n_y"), u)))).otherwise(p)
    return j.select(*by, F.col("n_x").cast("bigint").alias("n_x"), F.col("n_y").cast("bigint").alias("n_y"),
                    u.alias("u"), z.alias("z"), p.alias("p"),
                    F.try_divide(2 * u, F.col("n_x") * F.col("n_y")).alias("r_b"),
                    (F.try_divide(2 * u, F.col("n_x") * F.col("n_y")) - 1).alias("r_rb"),
                    pvalue_stars(p).alias("stars"))


def wilcoxon(df: DataFrame, x: str, y: str, by: list[str] | None = None, id_col: str = "id",
             exact_upto: int = 0) -> DataFrame:
    """Wilcoxon signed-rank test on paired columns, zeros dropped.

    Ranks of |d| averaged over ties; W+ / W-; normal approximation with
    tie correction (no continuity correction). Two-sided uses min(W+, W-),
    ``greater`` uses W+. Groups of at most ``exact_upto`` pairs (50 in the
    reference's default) without ties or zeros get the exact p.
    """
    by = list(by or [])
    d = df.select(*by, id_col, (F.col(x) - F.col(y)).alias("_d"))
    zeros = d.groupBy(*by).agg(F.sum(F.when(F.col("_d") == 0, 1).otherwise(0)).alias("zeros"))
    d = d.where(F.col("_d") != 0)
    d = d.withColumn("_ad", F.abs("_d"))
    r = average_rank(d, "_ad", "_r", by, id_col)
    s = r.groupBy(*by).agg(
        F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"),
        F.count(F.lit(1)).cast("double").alias("n"))
    ties = (r.groupBy(*by, "_ad").agg(F.count(F.lit(1)).cast("double").alias("_t"))
            .groupBy(*by).agg(F.sum(F.col("_t") ** 3 - F.col("_t")).alias("tie")))
    j = s.join(ties, by) if by else s.crossJoin(ties)
    n = F.col("n")
    mean = n * (n + 1) / 4
    se = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48)
    z_two = F.try_divide(F.least("w_plus", "w_minus") - mean, se)
    z_gt = F.try_divide(F.col("w_plus") - mean, se)
    two, greater = 2 * _sf(F.abs(z_two)), _sf(z_gt)
    if exact_upto:
        j = j.join(zeros, by) if by else j.crossJoin(zeros)   # one row each
        small = (F.col("n") <= exact_upto) & (F.col("n") > 0) & (F.col("tie") == 0) & (F.col("zeros") == 0)
        # rows that don't qualify go as a single pair
        j = j.withColumn("_p", signed_rank_test(F.when(small, F.col("n")).otherwise(F.lit(1.0)),
                                                F.when(small, F.col("w_plus")).otherwise(F.lit(1.0))))
        two = F.when(small, F.col("_p.two")).otherwise(two)
        greater = F.when(small, F.col("_p.greater")).otherwise(greater)
    return j.select(*by, F.col("n").cast("bigint").alias("n"), "w_plus", "w_minus",
                    two.alias("p_two_sided"), greater.alias("p_greater"))


# MD5's shifts and constants (RFC 1321).
MD5_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
MD5_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], dtype=np.uint32)
MD5_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32)


def _first_words(words, shape) -> np.ndarray:
    """First word of the MD5 of many messages: ``words`` are blocks of 16 words, each an array that broadcasts to ``shape``."""
    state = [np.full(shape, s) for s in MD5_START]
    f, t = np.empty(shape, dtype=np.uint32), np.empty(shape, dtype=np.uint32)
    for last, block in zip([*[False] * (len(words) - 1), True], words):
        a, b, c, d = (s.copy() for s in state)
        for i in range(61 if last else 64):   # the first word isn't touched by the last three steps
            kind, k = divmod(i, 16)
            if kind == 0:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif kind == 1:
                k = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif kind == 2:
                k = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                k = 7 * i % 16
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            f += block[k] + MD5_SINES[i]
            s = MD5_SHIFTS[kind][i % 4]
            np.right_shift(f, np.uint32(32 - s), out=t)
            f <<= np.uint32(s)
            f |= t
            f += b
            a, f, d, c, b = d, a, c, b, f
        if last:   # after 61 steps b holds the new first word
            return state[0] + b
        for s, x in zip(state, (a, b, c, d)):
            s += x


def _swapped(ids, resamples: int, seed: int) -> np.ndarray:
    """``uniform(seed, 'perm', 'r/id') < 0.5`` for every id (bytes, or None) and resample 1.., a column each after
    column 0, which is false."""
    out = np.zeros((len(ids), resamples + 1), dtype=bool)
    sizes = np.array([-1 if i is None else len(i) for i in ids])
    for size in set(sizes.tolist()):
        rows = np.flatnonzero(sizes == size)
        tail = b"" if size < 0 else b"/"
        for digits in range(1, len(str(resamples)) + 1):
            rs = range(10 ** (digits - 1), min(10**digits, resamples + 1))
            head = [f"{seed}:perm:{r}".encode() + tail for r in rs]
            if not head:
                continue
            at = len(head[0])
            length = at + max(size, 0)
            blocks = (length + 8) // 64 + 1
            first = np.zeros((len(head), 64 * blocks), dtype=np.uint8)
            first[:, :at] = np.frombuffer(b"".join(head), dtype=np.uint8).reshape(len(head), at)
            rest = np.zeros((len(rows), 64 * blocks), dtype=np.uint8)
            if size > 0:
                rest[:, at:length] = np.frombuffer(b"".join(ids[i] for i in rows), dtype=np.uint8).reshape(len(rows), size)
            rest[:, length] = 0x80
            rest[:, -8:] = np.frombuffer((8 * length).to_bytes(8, "little"), dtype=np.uint8)
            first, rest = first.view("<u4"), rest.view("<u4")
            for i in range(0, len(rows), 256):
                q = rest[i : i + 256]
                wide = max(64, 16384 // len(q))
                for j in range(0, len(head), wide):
                    p = first[j : j + wide]
                    words = [[p[None, :, w] if not q[:, w].any() else q[:, None, w] if not p[:, w].any()
                              else q[:, None, w] | p[None, :, w] for w in range(16 * k, 16 * k + 16)] for k in range(blocks)]
                    word = _first_words(words, (len(q), len(p)))
                    out[rows[i : i + 256, None], np.arange(rs[j], rs[j] + len(p))] = (word & 0x80) == 0
    return out


def paired_permutation(df: DataFrame, x: str, y: str, resamples: int = 9999, seed: int = 42,
                       id_col: str = "id", by: list[str] | None = None) -> DataFrame:
    """Paired permutation test of T = sum over pairs of 1[x > y] * rank(x).

    Resample r swaps x and y in pair i when a hash bit of (seed, r, i) is set. A pair's bits of all resamples are drawn
    at once and packed; each pair becomes two rows (value, bits of the resamples that have it as x, whether it is the
    larger one). The rows lie in order of their values over range partitions; a task streams its rows and keeps, for
    each resample, how many values it met and the sum of their ranks so far, so no pair is expanded by the resamples.
    The partitions' sums, one row for each, are put together in order.
    p_greater = (#(T_r >= T_obs) + 1) / (R + 1), p_less likewise,
    p_two_sided = min(1, 2 min(p_greater, p_less)).
    """
    from pyspark.sql import Window

    from tidemark.operators.ranking import freeze

    by = list(by or [])
    spark = df.sparkSession
    n = resamples + 1   # resample 0: observed
    value = lambda c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c).cast("double"))  # noqa: E731  (-0.0 is 0.0)
    pairs = df.select(*by, F.col(id_col).cast("string").cast("binary").alias("_i"), value(x).alias("_x"), value(y).alias("_y"),
                      (F.col(x) > F.col(y)).alias("_more"), (F.col(y) > F.col(x)).alias("_less"))
    pairs = pairs.repartition(4 * spark.sparkContext.defaultParallelism)
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pairs.schema.fields if f.name in by)

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                swapped = _swapped(part.column("_i").to_pylist(), resamples, seed)
                for c, top, held in (("_x", "_more", ~swapped), ("_y", "_less", swapped)):
                    held = pa.array([h.tobytes() for h in np.packbits(held, axis=1)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*[part.column(k) for k in by], part.column(c), part.column(top), held],
                                                     [*by, "_v", "_top", "_bits"])

    # written once, as the order samples its input; a null is the smallest value, all nulls tie
    rows = freeze(pairs.mapInArrow(draw, f"{keys}_v double, _top boolean, _bits binary"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    laid = (rows.repartitionByRange(parts, *by, "_v").sortWithinPartitions(*by, "_v")
            .withColumn("_p", F.spark_partition_id()))

    def count(batches):
        """A group's values met by each resample, those of them that are the larger of their pair, and their ranks."""
        import pyarrow as pa

        group = value = None
        for batch in batches:
            kinds, pid = [batch.column(k).type for k in by], batch.column("_p")
            of = list(zip(*[batch.column(k).to_pylist() for k in by])) if by else [()] * batch.num_rows
            # an unordered NaN ties with NaN, as in the sort
            values = ["nan" if v is not None and v != v else v for v in batch.column("_v").to_pylist()]
            tops = batch.column("_top").to_pylist()
            for lo in range(0, batch.num_rows, 256):
                bits = np.frombuffer(b"".join(batch.column("_bits").slice(lo, 256).to_pylist()), dtype=np.uint8)
                for k, b in enumerate(np.unpackbits(bits.reshape(-1, -(-n // 8)), axis=1, count=n), lo):
                    if group is None or of[k] != group[0]:
                        if group is not None:
                            yield done(group, pa)
                        group, value = (of[k], kinds, pid[k].as_py(), np.zeros((5, n))), values[k]
                    met, larger, ranks, tied, tied_larger = group[3]
                    if values[k] != value:
                        fold(group[3])
                        value = values[k]
                    tied += b
                    if tops[k]:
                        tied_larger += b
        if group is not None:
            yield done(group, pa)

    def fold(sums):
        """The rows of one value are through: they share the mean of their ranks."""
        met, larger, ranks, tied, tied_larger = sums
        ranks += tied_larger * (met + (tied + 1) / 2)
        met += tied
        larger += tied_larger
        sums[3:] = 0

    def done(group, pa):
        of, kinds, pid, sums = group
        fold(sums)
        return pa.RecordBatch.from_arrays(
            [*[pa.array([k], kind) for k, kind in zip(of, kinds)], pa.array([pid], pa.int32()),
             *[pa.array([c.tolist()], pa.list_(pa.float64())) for c in sums[:3]]], [*by, "_p", "met", "larger", "ranks"])

    parts = freeze(laid.mapInArrow(count, f"{keys}_p int, met array<double>, larger array<double>, ranks array<double>"))
    each = parts.select(*by, "_p", F.posexplode(F.arrays_zip("met", "larger", "ranks")).alias("_r", "_s"))
    w = Window.partitionBy(*by, "_r").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)   # a row per partition
    ranks = F.col("_s.ranks") + F.col("_s.larger") * F.coalesce(F.sum("_s.met").over(w), F.lit(0.0))
    stat = each.withColumn("_t", ranks).groupBy(*by, "_r").agg(F.sum("_t").alias("_t"))
    # one row per resample: materialise so the observed and the null branch
    # do not both replay the resampling
    stat = freeze(stat)
    obs = stat.where(F.col("_r") == 0).select(*by, F.col("_t").alias("statistic"))
    null = stat.where(F.col("_r") > 0)
    jj = null.join(obs, by) if by else null.crossJoin(obs)
    eps = 1e-12
    agg = jj.groupBy(*by, "statistic").agg(
        ((F.sum(F.when(F.col("_t") >= F.col("statistic") - eps, 1).otherwise(0)) + 1)
         / F.lit(float(resamples + 1))).alias("p_greater"),
        ((F.sum(F.when(F.col("_t") <= F.col("statistic") + eps, 1).otherwise(0)) + 1)
         / F.lit(float(resamples + 1))).alias("p_less"))
    return agg.withColumn("p_two_sided", F.least(F.lit(1.0), 2 * F.least("p_greater", "p_less")))


def quantile_summary(df: DataFrame, value: str, by: list[str] | None = None,
                     qs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Exact (interpolated) quantiles of ``value``, by sketch brackets and ranks over range partitions."""
    by = list(by or [])
    names = [f"q{int(round(q * 100)):02d}" for q in qs]
    return quantiles(df, value, qs, by, names).select(*by, *names, "n")


# Prior quantile functions used by the location/scale fit.
def _ppf(dist: str, p: float) -> float:
    if dist == "logistic":
        return math.log(p / (1.0 - p))
    if dist == "uniform":
        return p
    raise ValueError(dist)


def quantile_fit(df: DataFrame, value: str, q1: float, q2: float, dist: str = "logistic",
                 by: list[str] | None = None) -> DataFrame:
    """scale = (x1 - x2) / (y1 - y2), loc = (y1 x2 - y2 x1) / (y1 - y2)
    with x the empirical quantiles of ``value`` and y the prior ppf."""
    by = list(by or [])
    y1, y2 = _ppf(dist, q1), _ppf(dist, q2)
    qs = quantiles(df, value, [q1, q2], by, ["x1", "x2"])
    return qs.select(*by, "x1", "x2", ((F.col("x1") - F.col("x2")) / F.lit(y1 - y2)).alias("scale"),
                     ((F.lit(y1) * F.col("x2") - F.lit(y2) * F.col("x1")) / F.lit(y1 - y2)).alias("loc"))


# --------------------------------------------------------------------------- #
# Truncated beta likelihoods on a parameter grid
# --------------------------------------------------------------------------- #

def _betacf(a: float, b: float, x: float, max_iter: int = 300, eps: float = 3e-16) -> float:
    """Continued fraction of the regularised incomplete beta (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, max_iter + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betaln(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I(a, b; x) (no SciPy in the image)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - betaln(a, b))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def beta_grid_constants(grid: DataFrame, xq_low: float, xq_high: float | None = None) -> DataFrame:
    """Per grid row ``(a, b, loc, scale)``: ``log_norm`` = ln Z + ln B(a, b) + ln scale with
    Z = 1 - I(a, b; t_low) (left truncation) or I(a, b; t_high) - I(a, b; t_low) (double).
    Runs once per parameter row in ``mapInPandas`` (the grid is a bounded table)."""
    import pandas as pd

    def fn(batches):
        for pdf in batches:
            out = []
            for a, b, loc, scale in zip(pdf["a"], pdf["b"], pdf["loc"], pdf["scale"]):
                tl = (xq_low - loc) / scale
                if xq_high is None:
                    z = betainc(b, a, 1.0 - tl)   # the upper tail itself: 1 - I(a, b; t) vanishes there
                else:
                    z = betainc(a, b, (xq_high - loc) / scale) - betainc(a, b, tl)
                out.append(math.log(z) + betaln(a, b) + math.log(scale) if z > 0 else float("nan"))
            yield pdf.assign(log_norm=pd.Series(out, dtype="float64"))

    return grid.select("a", "b", "loc", "scale").mapInPandas(
        fn, "a double, b double, loc double, scale double, log_norm double")


def beta_nll(scores: DataFrame, value: str, grid: DataFrame, xq_low: float,
             xq_high: float | None = None) -> DataFrame:
    """Mean negative log-likelihood of ``value`` for every grid row.

    The per-score work is two logarithms (a column expression); the grid is
    broadcast (bounded parameter table) and the scores stream.
    """
    consts = beta_grid_constants(grid, xq_low, xq_high)
    t = (F.col(value) - F.col("loc")) / F.col("scale")
    logf = ((F.col("a") - 1) * F.log(t) + (F.col("b") - 1) * F.log(F.lit(1.0) - t) - F.col("log_norm"))
    # a score outside a row's support has density zero there: the row's likelihood is zero
    outside = (t <= 0) | (t >= 1)
    j = scores.select(value).where(F.col(value).isNotNull()).crossJoin(F.broadcast(consts))
    return j.groupBy("a", "b", "loc", "scale").agg(
        F.when(F.max(outside), F.lit(float("inf"))).otherwise(-F.avg(logf)).alias("nll"))


def beta_fit(scores: DataFrame, value: str, xq_low: float, xq_high: float | None = None,
             mode: str = "direct", prior: str = "logistic", a_grid=None, b_grid=None,
             refinements: int = 2) -> DataFrame:
    """Best grid parameters, refined coarse-to-fine (one job per refinement).

    ``mode='direct'`` searches a, b (loc 0, scale 1, the 2-parameter form);
    ``mode='ab_rest'`` first fixes (loc, scale) from the quantile fit (D15,
    ``prior`` = its reference distribution) and searches a, b; ``mode='ab_scale'``
    then also searches the scale around the fitted one.
    """
    spark = scores.sparkSession
    a_vals = list(a_grid or np.geomspace(0.2, 20.0, 12))
    b_vals = list(b_grid or np.geomspace(0.2, 20.0, 12))
    loc, scale = 0.0, 1.0
    if mode in ("ab_rest", "ab_scale"):
        fit = quantile_fit(scores, value, 0.1, 0.5, prior).collect()[0]   # one row
        if fit.scale and fit.scale > 0:
            loc, scale = float(fit.loc), float(fit.scale)
        mx = scores.agg(F.max(value).alias("m")).collect()[0].m
        scale = max(scale, (float(mx) - loc) * 1.0001)
    scales = [scale] if mode != "ab_scale" else [scale * f for f in (1.0, 1.25, 1.5, 2.0)]
    best = None
    for _ in range(refinements + 1):
        rows = [(float(a), float(b), loc, float(s)) for a in a_vals for b in b_vals for s in scales]
        grid = spark.createDataFrame(rows, "a double, b double, loc double, scale double")
        res = beta_nll(scores, value, grid, xq_low, xq_high).where(~F.isnan("nll") & (F.col("nll") < float("inf")))
        best = res.agg(F.min_by(F.struct("a", "b", "loc", "scale", "nll"), F.col("nll")).alias("best")).collect()[0].best
        a0, b0 = best.a, best.b
        a_vals = list(np.geomspace(a0 / 1.5, a0 * 1.5, 7))
        b_vals = list(np.geomspace(b0 / 1.5, b0 * 1.5, 7))
    return spark.createDataFrame([(best.a, best.b, best.loc, best.scale, best.nll)],
                                 "a double, b double, loc double, scale double, nll double")
