"""Registered queries: statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.scalars import logistic, logit, pvalue_stars
from tidemark.operators.pairs import knn
from tidemark.operators.ranking import freeze
from tidemark.operators.sequences import average_rank
from tidemark.operators.stats import paired_permutation, quantile_fit, quantile_summary, wilcoxon
from tidemark.plans import sqlparts as S
from tidemark.plans.registry import register
from tidemark.sources.fixtures import PAIRED_SQL, paired_scores
from tidemark.sources.readers import read_embeddings, table

RESAMPLES = 9999
COHORT = 30


def _norm_sf_sql(z: str) -> str:
    """1 - Phi(z) with the same A&S 7.1.26 erf as the engine."""
    x = f"(({z}) / sqrt(2))"
    t = f"(1 / (1 + 0.3275911 * abs({x})))"
    poly = (f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 "
            f"+ {t} * 1.061405429)))))")
    return f"(1 - 0.5 * (1 + sign({x}) * (1 - {poly} * exp(-{x} * {x}))))"


@register("e6_average_rank", """
SELECT event_id, event_type,
       rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS avg_rank
FROM events""")
def e6_average_rank(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    return average_rank(ev, "value", "avg_rank", ["event_type"], "event_id").select("event_id", "event_type", "avg_rank")


@register("l9_wilcoxon", f"""WITH {PAIRED_SQL},
d AS (SELECT id, x - y AS d, abs(x - y) AS ad FROM ps WHERE x - y <> 0),
r AS (SELECT *, rank() OVER (ORDER BY ad) + (count(*) OVER (PARTITION BY ad) - 1) / 2.0 AS r FROM d),
s AS (SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus,
             count(*)::DOUBLE AS n FROM r),
t AS (SELECT sum(c * c * c - c) AS tie FROM (SELECT count(*)::DOUBLE AS c FROM d GROUP BY ad)),
z AS (SELECT s.*, (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS z2,
             (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS zg FROM s, t)
SELECT n::BIGINT AS n, w_plus, w_minus, 2 * {_norm_sf_sql('abs(z2)')} AS p_two_sided, {_norm_sf_sql('zg')} AS p_greater FROM z""")
def l9_wilcoxon(spark, sf):
    """L9 on paired per-user means (first vs second half of the month)."""
    return wilcoxon(paired_scores(spark, sf), "x", "y")


@register("l9_wilcoxon_cohorts", f"""WITH RECURSIVE {PAIRED_SQL},
e AS (SELECT id // {COHORT} AS cohort, x - y AS d, abs(x - y) AS ad FROM ps),
zr AS (SELECT cohort, sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS zeros FROM e GROUP BY cohort),
d AS (SELECT * FROM e WHERE d <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY cohort ORDER BY ad) + (count(*) OVER (PARTITION BY cohort, ad) - 1) / 2.0 AS r FROM d),
s AS (SELECT cohort, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus,
             count(*)::DOUBLE AS n FROM r GROUP BY cohort),
t AS (SELECT cohort, sum(c * c * c - c) AS tie FROM (SELECT cohort, count(*)::DOUBLE AS c FROM d GROUP BY cohort, ad) GROUP BY cohort),
z AS (SELECT s.*, tie, (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS z2,
             (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS zg FROM s JOIN t USING (cohort)),
ways(n, c) AS (SELECT 0, [1.0::DOUBLE]
  UNION ALL SELECT n + 1, list_transform(range(len(c) + n + 1), lambda i:
    coalesce(list_extract(c, i + 1), 0.0) + CASE WHEN i > n THEN list_extract(c, i - n) ELSE 0.0 END) FROM ways WHERE n < {COHORT}),
p AS (SELECT z.*, zeros = 0 AND tie = 0 AS small,
             list_sum(list_slice(c, 1, least(w_plus, w_minus)::BIGINT + 1)) / pow(2, z.n) AS low,
             list_sum(list_slice(c, w_plus::BIGINT + 1, len(c))) / pow(2, z.n) AS high
      FROM z JOIN zr USING (cohort) JOIN ways ON ways.n = z.n)
SELECT cohort, n::BIGINT AS n, w_plus, w_minus,
       CASE WHEN small THEN least(1.0, 2 * low) ELSE 2 * {_norm_sf_sql('abs(z2)')} END AS p_two_sided,
       CASE WHEN small THEN high ELSE {_norm_sf_sql('zg')} END AS p_greater FROM p""")
def l9_wilcoxon_cohorts(spark, sf):
    """L9 within cohorts of neighbouring user ids: exact where a cohort has no ties or zeros, else the approximation."""
    pairs = paired_scores(spark, sf).withColumn("cohort", F.expr(f"id div {COHORT}"))
    return wilcoxon(pairs, "x", "y", by=["cohort"], exact_upto=50)


@register("l10_paired_permutation", f"""WITH {PAIRED_SQL},
rs AS (SELECT range AS r FROM range(0, {RESAMPLES + 1})),
j AS (SELECT r, id, CASE WHEN r > 0 AND {S.u_sql(42, 'perm', "r::VARCHAR || '/' || id::VARCHAR")} < 0.5 THEN y ELSE x END AS xx,
             CASE WHEN r > 0 AND {S.u_sql(42, 'perm', "r::VARCHAR || '/' || id::VARCHAR")} < 0.5 THEN x ELSE y END AS yy
      FROM ps, rs),
rk AS (SELECT *, rank() OVER (PARTITION BY r ORDER BY xx) + (count(*) OVER (PARTITION BY r, xx) - 1) / 2.0 AS rk FROM j),
st AS (SELECT r, sum(CASE WHEN xx > yy THEN rk ELSE 0 END) AS t FROM rk GROUP BY r),
ob AS (SELECT t AS statistic FROM st WHERE r = 0),
ag AS (SELECT statistic, (sum(CASE WHEN t >= statistic - 1e-12 THEN 1 ELSE 0 END) + 1) / {float(RESAMPLES + 1)} AS p_greater,
              (sum(CASE WHEN t <= statistic + 1e-12 THEN 1 ELSE 0 END) + 1) / {float(RESAMPLES + 1)} AS p_less
       FROM st, ob WHERE r > 0 GROUP BY statistic)
SELECT statistic, p_greater, p_less, least(1.0, 2 * least(p_greater, p_less)) AS p_two_sided FROM ag""")
def l10_paired_permutation(spark, sf):
    return paired_permutation(paired_scores(spark, sf), "x", "y", resamples=RESAMPLES, seed=42)


@register("d10_quantile_summary", """
SELECT event_type, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
       quantile_cont(value, 0.75) AS q75, count(value) AS n FROM events GROUP BY event_type""")
def d10_quantile_summary(spark, sf):
    return quantile_summary(table(spark, sf, "events"), "value", ["event_type"])


@register("d15_quantile_fit", f"""WITH {S.emb_cte()}, {S.knn_cte('nn', 'emb', 1, 'half_cosine')},
qs AS (SELECT quantile_cont(dist, 0.1) AS x1, quantile_cont(dist, 0.5) AS x2 FROM nn)
SELECT x1, x2, (x1 - x2) / ({math.log(0.1 / 0.9)!r} - 0.0) AS scale,
       ({math.log(0.1 / 0.9)!r} * x2 - 0.0 * x1) / ({math.log(0.1 / 0.9)!r} - 0.0) AS loc FROM qs""")
def d15_quantile_fit(spark, sf):
    """D15 on nearest-neighbour distances (in [0, 1]) with the logistic prior."""
    nn = knn(read_embeddings(spark, sf), k=1, metric="half_cosine")
    return quantile_fit(nn, "dist", 0.1, 0.5, "logistic")


@register("h10_h11_scalars", f"""WITH {PAIRED_SQL},
d AS (SELECT id, least(greatest(x / 1000.0, 1e-9), 1 - 1e-9) AS p FROM ps)
SELECT id, ln(p / (1 - p)) AS z, 1 / (1 + exp(-ln(p / (1 - p)))) AS back,
       CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars FROM d""")
def h10_h11_scalars(spark, sf):
    """H10 stars and H11 logit / logistic on per-user means scaled into (0, 1)."""
    ps = paired_scores(spark, sf)
    p = F.least(F.greatest(F.col("x") / 1000.0, F.lit(1e-9)), F.lit(1 - 1e-9))
    d = ps.select("id", p.alias("p"))
    return d.select("id", logit("p").alias("z"), logistic(logit("p")).alias("back"), pvalue_stars("p").alias("stars"))


def _nn_scores(spark, sf):
    """Nearest-neighbour audit distances in [0, 1], strictly inside for the logs; written once, as fits read them often."""
    nn = knn(read_embeddings(spark, sf), k=1, metric="half_cosine")
    return freeze(nn.select(F.least(F.greatest("dist", F.lit(1e-9)), F.lit(1 - 1e-9)).alias("x")))


def _grid(spark):
    rows = [(float(a), float(b), 0.0, 1.0) for a in (0.5, 1.0, 2.0, 4.0, 8.0) for b in (0.5, 1.0, 2.0, 4.0, 8.0)]
    return spark.createDataFrame(rows, "a double, b double, loc double, scale double")


@register("d16_beta_nll_low")
def d16_beta_nll_low(spark, sf):
    """Left-truncated beta NLL (truncation at the 10 % quantile) on a 5 x 5 grid."""
    from tidemark.operators.stats import beta_nll

    x = _nn_scores(spark, sf)
    xq = x.agg(F.percentile("x", F.lit(0.1)).alias("q")).collect()[0].q
    return beta_nll(x.where(F.col("x") >= xq), "x", _grid(spark), xq)


@register("d17_beta_nll_double")
def d17_beta_nll_double(spark, sf):
    """Doubly truncated beta NLL between the 10 % and 90 % quantiles."""
    from tidemark.operators.stats import beta_nll

    x = _nn_scores(spark, sf)
    q = x.agg(F.percentile("x", F.lit(0.1)).alias("lo"), F.percentile("x", F.lit(0.9)).alias("hi")).collect()[0]
    inside = x.where((F.col("x") >= q.lo) & (F.col("x") <= q.hi))
    return beta_nll(inside, "x", _grid(spark), q.lo, q.hi)


@register("d18_beta_fit")
def d18_beta_fit(spark, sf):
    """Coarse-to-fine beta fit of the left-truncated tail (direct mode)."""
    from tidemark.operators.stats import beta_fit

    x = _nn_scores(spark, sf)
    xq = x.agg(F.percentile("x", F.lit(0.1)).alias("q")).collect()[0].q
    return beta_fit(x.where(F.col("x") >= xq), "x", xq, mode="direct")
