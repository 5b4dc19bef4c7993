"""Registered queries: audit detectors (J*), kNN (C7), label contaminations (K5/K6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import contaminate as K
from tidemark.operators import detectors as D
from tidemark.operators.audit import auto_cut, label_error_audit, off_topic_audit
from tidemark.operators.metrics import metrics_sql, ranking_metrics
from tidemark.operators.pruned_knn import pruned_knn
from tidemark.operators.pairs import knn, lsh_candidates
from tidemark.operators.truth import id_hits
from tidemark.plans import sqlparts as S
from tidemark.plans.registry import register
from tidemark.sources.readers import read_embeddings

SEED = 42
FRAC = 0.1
LOGIT_ALPHA = repr(__import__("math").log(0.1 / 0.9))


def _emb(spark, sf):
    return read_embeddings(spark, sf)


@register("j1c_label_ratio", f"""
WITH {S.emb_cte()}, {S.label_ratio_ctes()}
SELECT row_number() OVER (ORDER BY round(score, 9), id)::BIGINT AS rank, id, score FROM lr""")
def j1c_label_ratio(spark, sf):
    return label_error_audit(_emb(spark, sf))


@register("k5_label_errors", f"""
WITH {S.emb_cte()}, {S.label_error_ctes()}
SELECT t.issue_type, t.id, e.label AS old_label, c.label AS new_label
FROM k5t t JOIN emb e USING (id) JOIN k5c c USING (id)""")
def k5_label_errors(spark, sf):
    emb = _emb(spark, sf)
    c, t = K.label_errors(emb, FRAC, SEED)
    return (t.join(emb.select("id", F.col("label").alias("old_label")), "id")
            .join(c.select("id", F.col("label").alias("new_label")), "id")
            .select("issue_type", "id", "old_label", "new_label"))


@register("k6_label_errors_per_class", f"""
WITH {S.emb_cte()}, {S.label_error_ctes(out='k6c', truth='k6t', per_class=True)}
SELECT t.issue_type, t.id, e.label AS old_label, c.label AS new_label
FROM k6t t JOIN emb e USING (id) JOIN k6c c USING (id)""")
def k6_label_errors_per_class(spark, sf):
    emb = _emb(spark, sf)
    c, t = K.label_errors(emb, FRAC, SEED, per_class=True)
    return (t.join(emb.select("id", F.col("label").alias("old_label")), "id")
            .join(c.select("id", F.col("label").alias("new_label")), "id")
            .select("issue_type", "id", "old_label", "new_label"))


@register("l1_label_error_eval", metrics_sql("h", ctes=f"""
{S.emb_cte()}, {S.label_error_ctes()}, {S.label_ratio_ctes('k5c', 'lr')},
r AS (SELECT row_number() OVER (ORDER BY round(score, 9), id) AS rank, id FROM lr),
{S.id_hits_cte('h', 'r', 'k5t')}"""))
def l1_label_error_eval(spark, sf):
    """L1 (labels): K5 -> J1c -> C5 -> D11-D14."""
    c, t = K.label_errors(_emb(spark, sf), FRAC, SEED)
    ranked = label_error_audit(c)
    return ranking_metrics(id_hits(ranked, t).select("rank", "hit"))


_AUTO_CUT_SQL = f"""
WITH {S.emb_cte()}, {S.label_ratio_ctes()},
z AS (SELECT id, score, ln(least(greatest(score, 1e-9), 1 - 1e-9) / (1 - least(greatest(score, 1e-9), 1 - 1e-9))) AS z FROM lr),
fit AS (SELECT count(*) AS n, quantile_cont(z, 0.1) AS x1, quantile_cont(z, 0.5) AS x2 FROM z),
p AS (SELECT (x1 - x2) / ({LOGIT_ALPHA} - 0.0) AS scale, ({LOGIT_ALPHA} * x2 - 0.0 * x1) / ({LOGIT_ALPHA} - 0.0) AS loc, n FROM fit)
SELECT row_number() OVER (ORDER BY round(score, 9), id)::BIGINT AS rank, id, score,
       coalesce(CASE WHEN p.scale > 0 THEN p.n / (1 + exp(-((z.z - p.loc) / p.scale))) <= 0.05 ELSE false END, false) AS flagged
FROM z, p"""


@register("j2_auto_cut", _AUTO_CUT_SQL)
def j2_auto_cut(spark, sf):
    """J2 on the label-error scores (alpha .1, q .05)."""
    ranked = label_error_audit(_emb(spark, sf))
    return auto_cut(ranked, alpha=0.1, q=0.05).select("rank", "id", "score", "flagged")


@register("c7_knn", f"""
WITH {S.emb_cte()}, {S.knn_cte('nn', 'emb', 5, 'l2')}
SELECT q, nbr, dist, nn_rank FROM nn""")
def c7_knn(spark, sf):
    return knn(_emb(spark, sf), k=5, metric="l2").select("q", "nbr", "dist", "nn_rank")


@register("c7_knn_pruned", f"""
WITH {S.emb_cte()}, {S.knn_cte('nn', 'emb', 5, 'l2')}
SELECT q, nbr, dist, nn_rank FROM nn""")
def c7_knn_pruned(spark, sf):
    """C7 by cells and rings: only blocks that the triangle inequality leaves open are compared."""
    return pruned_knn(_emb(spark, sf), k=5, metric="l2").select("q", "nbr", "dist", "nn_rank")


@register("j8_knn_outlier", f"""
WITH {S.emb_cte()}, {S.knn_cte('nn', 'emb', 5, 'l2')}
SELECT q AS id, max(dist) AS score FROM nn GROUP BY q""")
def j8_knn_outlier(spark, sf):
    return D.knn_distance(_emb(spark, sf), 5)


@register("j5_outlier_ranking", f"""
WITH {S.emb_cte()}, {S.knn_cte('nn', 'emb', 5, 'l2')},
s AS (SELECT q AS id, max(dist) AS score FROM nn GROUP BY q),
t AS (SELECT quantile_cont(score, 0.9) AS thr FROM s)
SELECT row_number() OVER (ORDER BY -round(score, 9), id)::BIGINT AS rank, id, score,
       CASE WHEN score > thr THEN 1 ELSE 0 END AS is_outlier FROM s, t""")
def j5_outlier_ranking(spark, sf):
    return D.outliers(_emb(spark, sf), lambda e: D.knn_distance(e, 5), 0.1)


_ECDF_SQL = f"""{S.emb_cte()}, {S.long_cte('lf')},
ec AS (SELECT id, dim, x,
  (count(*) OVER (PARTITION BY dim ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE
     / count(*) OVER (PARTITION BY dim) AS f_le,
  (count(*) OVER (PARTITION BY dim ORDER BY x RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE
     / count(*) OVER (PARTITION BY dim) AS f_ge
  FROM lf)"""


@register("e8_ecdf", f"""
WITH {_ECDF_SQL}
SELECT dim::INTEGER AS dim, count(*) AS n, sum(f_le) AS sum_f_le, sum(f_ge) AS sum_f_ge,
       min(f_le) AS min_f_le, max(f_ge) AS max_f_ge FROM ec GROUP BY dim""")
def e8_ecdf(spark, sf):
    """E8 per-dimension ECDF, summarised per dimension."""
    e = D.ecdf(D.long_form(_emb(spark, sf)))
    return e.groupBy(F.col("dim").cast("int").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("F_le").alias("sum_f_le"), F.sum("F_ge").alias("sum_f_ge"),
        F.min("F_le").alias("min_f_le"), F.max("F_ge").alias("max_f_ge"))


@register("j6_ecod", f"""
WITH {_ECDF_SQL},
mu AS (SELECT dim, avg(x) AS m FROM lf GROUP BY dim),
sk AS (SELECT lf.dim, avg((x - m) * (x - m) * (x - m)) AS m3 FROM lf JOIN mu USING (dim) GROUP BY lf.dim),
parts AS (SELECT id, -ln(f_le) AS l, -ln(f_ge) AS r, CASE WHEN m3 < 0 THEN -ln(f_le) ELSE -ln(f_ge) END AS a
          FROM ec JOIN sk USING (dim))
SELECT id, greatest(sum(l), sum(r), sum(a)) AS score FROM parts GROUP BY id""")
def j6_ecod(spark, sf):
    return D.ecod(_emb(spark, sf))


@register("j9_hbos", f"""
WITH {S.emb_cte()}, {S.long_cte('lf')},
rg AS (SELECT dim, min(x) AS lo, max(x) AS hi, count(*) AS n FROM lf GROUP BY dim),
b AS (SELECT lf.id, lf.dim,
        CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 10), 9) ELSE 0 END::INTEGER AS bin,
        CASE WHEN hi > lo THEN (hi - lo) / 10.0 ELSE 1.0 END AS w, n
      FROM lf JOIN rg USING (dim)),
dn AS (SELECT dim, bin, count(*) / (any_value(n) * any_value(w)) AS density FROM b GROUP BY dim, bin)
SELECT id, sum(-log2(density + 0.1)) AS score FROM b JOIN dn USING (dim, bin) GROUP BY id""")
def j9_hbos(spark, sf):
    return D.hbos(_emb(spark, sf))


@register("j11_knn_agreement", f"""
WITH {S.emb_cte()}, {S.knn_cte('nn', 'emb', 2, 'half_cosine')},
s AS (SELECT nn.q AS id, avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) AS score, avg(nn.dist) AS mean_dist
      FROM nn JOIN emb a ON a.id = nn.q JOIN emb b ON b.id = nn.nbr GROUP BY nn.q)
SELECT row_number() OVER (ORDER BY round(score, 9), round(mean_dist, 9), id)::BIGINT AS rank, id, score, mean_dist FROM s""")
def j11_knn_agreement(spark, sf):
    return D.knn_agreement(_emb(spark, sf), 2)


@register("d4_prototype_counts", f"""
WITH {S.emb_cte()},
sz AS (SELECT label, count(*) AS n_c FROM emb GROUP BY label),
rho AS (SELECT avg(n_c) AS rho FROM sz)
SELECT label, n_c::BIGINT AS n_c, rho, least(greatest(floor(sqrt(rho / 2)), 1), n_c)::INTEGER AS k FROM sz, rho""")
def d4_prototype_counts(spark, sf):
    return D.prototype_counts(_emb(spark, sf))


_PHASH_OF = """px AS (SELECT id, (generate_subscripts(embedding, 1) - 1) AS p, unnest(embedding) AS val FROM emb),
bs AS (SELECT u, x, cos(pi() * (2 * x + 1) * u / 16.0) AS c FROM range(8) t1(u), range(8) t2(x)),
cf AS (SELECT px.id, bu.u, bv.u AS v, sum(val * bu.c * bv.c) AS coef
       FROM px JOIN bs bu ON bu.x = px.p // 8 JOIN bs bv ON bv.x = px.p % 8 GROUP BY px.id, bu.u, bv.u),
md AS (SELECT id, quantile_cont(coef, 0.5) AS med FROM cf GROUP BY id),
hs AS (SELECT e.id, coalesce(sum(CASE WHEN round(cf.coef, 12) > round(md.med, 12)
                                 THEN (1::HUGEINT << (cf.u * 8 + cf.v)::INTEGER) END), 0) AS h
       FROM emb e LEFT JOIN cf USING (id) LEFT JOIN md USING (id) GROUP BY e.id)"""
_PHASH_SQL = f"{S.emb_cte()},\n{_PHASH_OF}"


@register("j4_phash_pairs", f"""
WITH {_PHASH_SQL},
pr AS (SELECT a.id AS i, b.id AS j, bit_count(xor(a.h, b.h)) / 64.0 AS score FROM hs a JOIN hs b ON a.id < b.id)
SELECT row_number() OVER (ORDER BY score, i, j)::BIGINT AS rank, i, j, score FROM pr""")
def j4_phash_pairs(spark, sf):
    return D.phash_pairs(_emb(spark, sf))


@register("h1_hamming_bands", f"""
WITH {S.emb_cte()}, {S.k1_ctes('emb', 'k1c', 'k1t', FRAC, SEED)}, {_PHASH_OF.replace('FROM emb', 'FROM k1c')},
pr AS (SELECT a.id AS i, b.id AS j, bit_count(xor(a.h, b.h)) AS bits FROM hs a JOIN hs b ON a.id < b.id)
SELECT row_number() OVER (ORDER BY bits, i, j)::BIGINT AS rank, i, j, bits / 64.0 AS score FROM pr WHERE bits <= 7""")
def h1_hamming_bands(spark, sf):
    """J4 scale path on planted near-copies: the band join finds every pair within 7 differing bits."""
    from tidemark.operators.ranking import freeze

    c, _ = K.near_duplicates(_emb(spark, sf), FRAC, SEED)
    return D.phash_pairs(freeze(c), max_bits=7)


_PROBA_SQL = f"""{S.emb_cte()},
fe AS (SELECT e.*, ((row_number() OVER (PARTITION BY label ORDER BY {S.hkey_sql(SEED, 'fold', 'id')}, id) - 1) % 10)::INTEGER AS fold
       FROM emb e),
comp AS (SELECT id, label, fold, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM fe),
pf AS (SELECT fold, label, i, sum(x) AS s, count(*) AS c FROM comp GROUP BY fold, label, i),
tot AS (SELECT label, i, sum(s) AS ts, sum(c) AS tc FROM pf GROUP BY label, i),
fl AS (SELECT DISTINCT fold FROM fe),
oof AS (SELECT fl.fold, tot.label AS cls, tot.i, (tot.ts - coalesce(pf.s, 0.0)) / NULLIF(tot.tc - coalesce(pf.c, 0), 0) AS m
        FROM fl CROSS JOIN tot LEFT JOIN pf ON pf.fold = fl.fold AND pf.label = tot.label AND pf.i = tot.i),
cent AS (SELECT fold, cls, list(m ORDER BY i) AS centroid FROM oof WHERE m IS NOT NULL GROUP BY fold, cls),
lg AS (SELECT fe.id, fe.label, fe.fold, cent.cls, (1 - 2 * {S.dist_sql('fe.embedding', 'cent.centroid')}) / 0.1 AS z
       FROM fe JOIN cent USING (fold)),
mx AS (SELECT *, max(z) OVER (PARTITION BY id) AS mz FROM lg),
ex AS (SELECT *, exp(z - mz) AS e FROM mx),
pr AS (SELECT id, label, fold, cls, e / sum(e) OVER (PARTITION BY id) AS p FROM ex)"""


@register("j12_label_quality", f"""WITH {_PROBA_SQL},
q AS (SELECT id, p AS score FROM pr WHERE cls = label)
SELECT row_number() OVER (ORDER BY round(score, 9), id)::BIGINT AS rank, id, score FROM q""")
def j12_label_quality(spark, sf):
    """J12a/b: 10-fold out-of-sample class probabilities (nearest-centroid
    softmax), label quality ascending."""
    return D.label_quality(D.centroid_proba(_emb(spark, sf), 10, SEED))


@register("j12c_confident_joint", f"""WITH {_PROBA_SQL},
th AS (SELECT cls, avg(p) AS t FROM pr WHERE cls = label GROUP BY cls),
ab AS (SELECT pr.*, row_number() OVER (PARTITION BY id ORDER BY p DESC, cls) AS o
       FROM pr JOIN th USING (cls) WHERE p >= t)
SELECT label, cls AS y_star, count(*) AS n FROM ab WHERE o = 1 GROUP BY label, cls""")
def j12c_confident_joint(spark, sf):
    """Confident joint counts by (given label, confident label)."""
    return D.confident_joint(D.centroid_proba(_emb(spark, sf), 10, SEED))


_CENTROID_PROTO_SQL = f"""{S.emb_cte()},
comp AS (SELECT id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM emb),
cm AS (SELECT label, i, avg(x) AS m FROM comp GROUP BY label, i),
pt AS (SELECT label AS id, label AS proto_id, label, list(m ORDER BY i) AS embedding FROM cm GROUP BY label),
{S.knn_cte('nn', 'pt', 5, 'sql2', base='emb', exclude_self=False)},
vv AS (SELECT nn.q AS proto_id, e.label, sum(1 / (1 + nn.dist)) AS sw, min(nn.nn_rank) AS first
       FROM nn JOIN emb e ON e.id = nn.nbr GROUP BY nn.q, e.label),
vt AS (SELECT proto_id, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY proto_id ORDER BY sw DESC, first) AS o
       FROM vv) WHERE o = 1)"""


def _centroid_protos(emb):
    """One prototype per class: the class mean (a bounded table of C rows)."""
    comp = emb.select("label", F.posexplode("embedding").alias("i", "x"))
    avg = comp.groupBy("label", "i").agg(F.avg("x").alias("m"))
    return (avg.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_s"))
            .select(F.col("label").cast("bigint").alias("proto_id"), "label",
                    F.transform("_s", lambda s: s["m"]).alias("center")))


@register("j10b_proto_votes", f"WITH {_CENTROID_PROTO_SQL} SELECT proto_id::BIGINT AS proto_id, pred::INTEGER AS pred FROM vt")
def j10b_proto_votes(spark, sf):
    """J10b given prototypes (class means): weighted 5-NN vote, squared L2, b = e = 1."""
    emb = _emb(spark, sf)
    return D.proto_votes(emb, _centroid_protos(emb), 5, 1.0, 1.0)


@register("j10c_dependence", f"""WITH {_CENTROID_PROTO_SQL},
pp AS (SELECT pt.label AS yj, vt.pred AS yp, pt.embedding AS center FROM pt JOIN vt USING (proto_id)),
w AS (SELECT e.id, CASE WHEN e.label = yj THEN -1.0 WHEN yj = yp THEN 0.5 WHEN e.label <> yp THEN 0.5 ELSE 0.5 END
                   / (1 + {S.dist_sql('e.embedding', 'pp.center', 'l2')}) AS v FROM emb e, pp)
SELECT id, sum(v) AS score FROM w GROUP BY id""")
def j10c_dependence(spark, sf):
    """J10c given prototypes (class means): dependence score, alpha = .5, b_factor = 1."""
    emb = _emb(spark, sf)
    protos = _centroid_protos(emb)
    return D.dependence(emb, protos, D.proto_votes(emb, protos, 5, 1.0, 1.0))


_SSIM_SQL = f"""{S.emb_cte()},
px AS (SELECT id, (generate_subscripts(embedding, 1) - 1) AS p, unnest(embedding) AS v FROM emb),
rg AS (SELECT max(v) - min(v) AS L FROM px),
pw AS (SELECT id, wr, wc, (p // 8 - wr) * 7 + (p % 8 - wc) AS k, v
       FROM px, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) w(wr, wc)
       WHERE p // 8 BETWEEN wr AND wr + 6 AND p % 8 BETWEEN wc AND wc + 6),
st AS (SELECT id, wr, wc, avg(v) AS m, var_samp(v) AS s2 FROM pw GROUP BY id, wr, wc),
pc AS (SELECT pw.*, st.m FROM pw JOIN st USING (id, wr, wc)),
cv AS (SELECT a.id AS i, b.id AS j, a.wr, a.wc, sum((a.v - a.m) * (b.v - b.m)) / 48 AS cov
       FROM pc a JOIN pc b ON a.wr = b.wr AND a.wc = b.wc AND a.k = b.k AND a.id < b.id
       GROUP BY a.id, b.id, a.wr, a.wc),
ss AS (SELECT cv.i, cv.j, avg(((2 * sa.m * sb.m + (0.01 * L) * (0.01 * L)) * (2 * cv.cov + (0.03 * L) * (0.03 * L)))
                              / ((sa.m * sa.m + sb.m * sb.m + (0.01 * L) * (0.01 * L)) * (sa.s2 + sb.s2 + (0.03 * L) * (0.03 * L)))) AS s
       FROM cv JOIN st sa ON sa.id = cv.i AND sa.wr = cv.wr AND sa.wc = cv.wc
               JOIN st sb ON sb.id = cv.j AND sb.wr = cv.wr AND sb.wc = cv.wc, rg
       GROUP BY cv.i, cv.j)"""


@register("j3_ssim_pairs", f"""WITH {_SSIM_SQL}
SELECT row_number() OVER (ORDER BY round(1 - s, 9), i, j)::BIGINT AS rank, i, j, 1 - s AS score FROM ss""")
def j3_ssim_pairs(spark, sf):
    return D.ssim_pairs(_emb(spark, sf))


@register("j7_isolation_forest")
def j7_isolation_forest(spark, sf):
    return D.isolation_forest(_emb(spark, sf), trees=100, sample=256, seed=SEED)


@register("j10_noise_rank")
def j10_noise_rank(spark, sf):
    return D.noise_rank(_emb(spark, sf), seed=SEED)


_LINKAGE_SQL = f"""{S.emb_cte()}, {S.knn_cte('nn', 'emb', 10, 'half_cosine')},
ed AS (SELECT least(q, nbr) AS a, greatest(q, nbr) AS b, min(round(dist, 9)) AS dist FROM nn GROUP BY ALL)"""
_LEVELS = ", ".join(repr((i + 1) / 17.0) for i in range(16))


@register("j1b_off_topic", f"""
WITH RECURSIVE {_LINKAGE_SQL},
lv AS (SELECT generate_subscripts(q, 1) AS level, unnest(q) AS cut FROM (SELECT quantile_cont(dist, [{_LEVELS}]) AS q FROM ed)),
un AS (SELECT level, a, b FROM ed JOIN lv ON dist <= cut UNION ALL SELECT level, b, a FROM ed JOIN lv ON dist <= cut),
rc AS (SELECT level, id, id AS o FROM emb, lv
       UNION SELECT rc.level, rc.id, un.b FROM rc JOIN un ON un.level = rc.level AND un.a = rc.o),
sz AS (SELECT level, id, count(*) AS size FROM rc GROUP BY ALL),
sc AS (SELECT id, sum(ln((SELECT count(*) FROM emb) / size)) / 16.0 AS score FROM sz GROUP BY id)
SELECT row_number() OVER (ORDER BY -round(score, 9), id)::BIGINT AS rank, id, score FROM sc""")
def j1b_off_topic(spark, sf):
    return off_topic_audit(_emb(spark, sf))


@register("c2_lsh_candidates")
def c2_lsh_candidates(spark, sf):
    """C2 on planted near-copies: close pairs by sign signatures."""
    from tidemark.operators.ranking import freeze

    c, _ = K.near_duplicates(_emb(spark, sf), FRAC, SEED)
    return lsh_candidates(freeze(c), max_dist=0.05)


def _projected(emb, seed: int):
    """Another space of the same width: a seeded Gaussian map of the vectors, bent by tanh."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                m = np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1]))
                yield pdf.assign(embedding=pd.Series(list(np.tanh(x @ m)), index=pdf.index))

    return emb.select("id", "embedding", "label").mapInPandas(run, "id bigint, embedding array<double>, label int")


@register("j13_baseline_sweep")
def j13_baseline_sweep(spark, sf):
    """Nine detectors for three issue types in two feature spaces against a
    mixed contamination (K7), metrics keyed by (issue, detector, space)."""
    from tidemark.operators.ranking import freeze

    c, t = K.mixed(_emb(spark, sf), FRAC, SEED)
    spaces = {"audit": c, "projected": freeze(_projected(c, SEED))}
    out = None
    for space, e in spaces.items():
        m = D.compare(e, t).withColumn("space", F.lit(space))
        out = m if out is None else out.unionByName(m)
    return out


def l2n(c):
    from tidemark.functions.vectors import l2_normalize

    return l2_normalize(c)
