"""Registered queries: sources, pairs, contaminations and planted-truth evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.vectors import sq_norm
from tidemark.operators import contaminate as K
from tidemark.operators.audit import label_error_audit, near_duplicate_audit
from tidemark.operators.metrics import metrics_sql, ranking_metrics
from tidemark.operators.truth import id_hits, pair_hits
from tidemark.plans import sqlparts as S
from tidemark.plans.registry import register
from tidemark.sources.readers import read_embeddings

SEED = 42
FRAC = 0.1


def _vec_summary(df):
    """Scalar fingerprint of a vector column for oracle comparison."""
    return [F.size("embedding").cast("bigint").alias("dims"),
            F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("emb_sum"),
            F.sqrt(sq_norm("embedding")).alias("emb_norm")]


_VEC_SUMMARY_SQL = ("len(embedding)::BIGINT AS dims, list_sum(embedding) AS emb_sum, "
                    "sqrt(list_sum(list_transform(embedding, lambda y: y * y))) AS emb_norm")


@register("a1_embedding_scan", f"""
WITH {S.emb_cte('emb', normalize=False)}
SELECT id, label, {_VEC_SUMMARY_SQL} FROM emb""")
def a1_embedding_scan(spark, sf):
    e = read_embeddings(spark, sf, normalize=False)
    return e.select("id", "label", *_vec_summary(e))


@register("a2_l2_normalize", f"""
WITH {S.emb_cte('emb', normalize=True)}
SELECT id, label, {_VEC_SUMMARY_SQL} FROM emb""")
def a2_l2_normalize(spark, sf):
    e = read_embeddings(spark, sf, normalize=True)
    return e.select("id", "label", *_vec_summary(e))


@register("j1a_near_duplicates", f"""
WITH {S.emb_cte()}, {S.pairs_cte('p', 'emb')}, {S.ranked_pairs_cte('r', 'p')}
SELECT rank::BIGINT AS rank, i, j, score FROM r""")
def j1a_near_duplicates(spark, sf):
    return near_duplicate_audit(read_embeddings(spark, sf))


@register("k1_near_duplicate_truth", f"""
WITH {S.emb_cte()}, {S.k1_ctes()}
SELECT t.issue_type, t.id, t.id2, c.label, {_VEC_SUMMARY_SQL.replace('embedding', 'c.embedding')}
FROM k1t t JOIN k1c c ON c.id = t.id2""")
def k1_near_duplicate_truth(spark, sf):
    emb = read_embeddings(spark, sf)
    c, t = K.near_duplicates(emb, FRAC, SEED)
    return (t.join(c.withColumnRenamed("id", "id2"), "id2")
            .select("issue_type", "id", "id2", "label", *_vec_summary(c)))


@register("l1_near_duplicate_eval", metrics_sql("h", ctes=f"""
{S.emb_cte()}, {S.k1_ctes()}, {S.pairs_cte('p', 'k1c')}, {S.ranked_pairs_cte('r', 'p')},
{S.pair_hits_cte('h', 'r', 'k1t')}"""))
def l1_near_duplicate_eval(spark, sf):
    """L1 (duplicates): K1 -> J1a -> C3 -> D11-D14, one row of metrics."""
    from tidemark.operators.audit import near_duplicate_eval
    from tidemark.operators.ranking import freeze

    emb = read_embeddings(spark, sf)
    c, t = K.near_duplicates(emb, FRAC, SEED)
    return near_duplicate_eval(freeze(c), freeze(t))


# --------------------------------------------------------------------------- #
# K2-K4, K7, G1-G4, D20, L2
# --------------------------------------------------------------------------- #

_DOCS_SQL = "docs AS (SELECT doc_id AS id, text FROM documents)"


def _k2_sql(seed: int = SEED, frac: float = FRAC) -> str:
    u = lambda salt, e="s.id": S.u_sql(seed, salt, e)
    return f"""{_DOCS_SQL}, {S.sample_cte('k2s', 'docs', seed, 'k2', frac)},
pp AS (SELECT row_number() OVER (ORDER BY {S.hkey_sql(seed, 'k2:partner', 'id')}, id) AS ppos, text AS ptext FROM docs),
nn AS (SELECT count(*) AS n FROM docs),
k2j AS (SELECT s.id, s.new_id, s.text, pp.ptext,
               floor(length(s.text) * {u('k2:wpos')})::BIGINT AS wm_at,
               {u('k2:wm')} AS u_wm, {u('k2:bar')} AS u_bar, {u('k2:mosaic')} AS u_mo
        FROM k2s s CROSS JOIN nn LEFT JOIN pp ON pp.ppos = floor({u('k2:pick')} * nn.n) + 1),
k2a AS (SELECT *, CASE WHEN u_wm < 0.5 THEN substring(text, 1, wm_at) || ' CONFIDENTIAL ' || substring(text, wm_at + 1, length(text) + 1)
                       ELSE text END AS t1 FROM k2j),
k2b AS (SELECT *, CASE WHEN u_bar < 0.5 THEN t1 || ' ||||||||' ELSE t1 END AS t2 FROM k2a),
k2c AS (SELECT *, CASE WHEN u_mo < 0.5 THEN t2 || ' ' || coalesce(substring(ptext, 1, floor(length(ptext) * 0.5)::BIGINT), '')
                       ELSE t2 END AS t3 FROM k2b)"""


@register("k2_artefacts", f"""WITH {_k2_sql()}
SELECT 'near_duplicate' AS issue_type, id, new_id AS id2, length(t3)::BIGINT AS n_chars, md5(t3) AS text_md5 FROM k2c""")
def k2_artefacts(spark, sf):
    """K2 on documents: watermark / colour bar / mosaic copies with their truth."""
    from tidemark.sources.readers import table

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    c, t = K.artefacts(docs, FRAC, SEED)
    return (t.join(c.select(F.col("id").alias("id2"), "text"), "id2")
            .select("issue_type", "id", "id2", F.length("text").cast("bigint").alias("n_chars"),
                    F.md5("text").alias("text_md5")))


@register("k3_destroy", f"""WITH {S.emb_cte()}, {S.destroy_ctes()}
SELECT c.id, c.label, {_VEC_SUMMARY_SQL}, CASE WHEN t.id IS NULL THEN 0 ELSE 1 END AS is_truth
FROM k3c c LEFT JOIN k3t t USING (id)""")
def k3_destroy(spark, sf):
    """Destroyed copies replace sampled rows under a new class."""
    c, t = K.destroy(read_embeddings(spark, sf), FRAC, SEED)
    return (c.join(t.select("id", F.lit(1).alias("is_truth")), "id", "left")
            .select("id", "label", *_vec_summary(c), F.coalesce("is_truth", F.lit(0)).alias("is_truth")))


_HELD_OUT_SQL = f"""{S.emb_cte('e0')},
base AS (SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS id, embedding, label FROM e0 WHERE label < {{lo}}),
bn AS (SELECT count(*) AS n, max(label) + 1 AS ncls FROM base)"""


def _foreign_sql(sources: list[int], seed: int = SEED, frac: float = FRAC) -> str:
    lo = min(sources)
    parts = []
    k = len(sources)
    for idx, lab in enumerate(sources):
        prev = " + ".join(f"(SELECT max(label) + 1 FROM e0 WHERE label = {p})" for p in sources[:idx]) or "0"
        parts.append(f"""f{idx} AS (SELECT r.*, bn.n, bn.ncls, {prev} AS prev_cls,
    {"floor(ceil(bn.n * " + repr(float(frac)) + ") / " + str(k) + ")" if k > 1 else "ceil(bn.n * " + repr(float(frac)) + ")"} AS share
  FROM (SELECT e0.*, row_number() OVER (ORDER BY {S.hkey_sql(seed, f'k4:{idx}', 'id')}, id) AS hrank
        FROM e0 WHERE label = {lab}) r, bn),
g{idx} AS (SELECT (n + hrank + {idx} * share - 1)::BIGINT AS id, embedding, (label + ncls + prev_cls)::INTEGER AS label
           FROM f{idx} WHERE hrank <= share)""")
    union = " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(k))
    return (_HELD_OUT_SQL.replace("{lo}", str(lo)) + ", " + ", ".join(parts)
            + f", added AS ({union}), k4c AS (SELECT * FROM base UNION ALL SELECT * FROM added)")


def _held_out(spark, sf, sources):
    e0 = read_embeddings(spark, sf)
    base = K.dense_reindex(e0.where(F.col("label") < min(sources)))
    srcs = [e0.where(F.col("label") == lab) for lab in sources]   # B4 category filter
    return K.foreign(base, srcs, FRAC, SEED)


@register("k4_foreign_rows", f"""WITH {_foreign_sql([9])}
SELECT c.id, c.label, {_VEC_SUMMARY_SQL}, CASE WHEN c.id IN (SELECT id FROM added) THEN 1 ELSE 0 END AS is_truth FROM k4c c""")
def k4_foreign_rows(spark, sf):
    """Class 9 held out as the foreign table, 10 % of the rest appended."""
    c, t = _held_out(spark, sf, [9])
    return (c.join(t.select("id", F.lit(1).alias("is_truth")), "id", "left")
            .select("id", "label", *_vec_summary(c), F.coalesce("is_truth", F.lit(0)).alias("is_truth")))


@register("g4_multi_source_union", f"""WITH {_foreign_sql([8, 9])}
SELECT c.id, c.label, {_VEC_SUMMARY_SQL}, CASE WHEN c.id IN (SELECT id FROM added) THEN 1 ELSE 0 END AS is_truth FROM k4c c""")
def g4_multi_source_union(spark, sf):
    """Two foreign sources (classes 8 and 9) with equal shares and running class offsets."""
    c, t = _held_out(spark, sf, [8, 9])
    return (c.join(t.select("id", F.lit(1).alias("is_truth")), "id", "left")
            .select("id", "label", *_vec_summary(c), F.coalesce("is_truth", F.lit(0)).alias("is_truth")))


@register("g1_append_union", f"""WITH {S.emb_cte()}, {S.k1_ctes()}
SELECT id, label, {_VEC_SUMMARY_SQL} FROM k1c""")
def g1_append_union(spark, sf):
    """G1: base rows plus appended copies under ids n, n+1, ..."""
    c, _ = K.near_duplicates(read_embeddings(spark, sf), FRAC, SEED)
    return c.select("id", "label", *_vec_summary(c))


STAGE = (1.0 + FRAC) ** (1.0 / 3.0) - 1.0

_MIXED_SQL = f"""{S.emb_cte()}, {S.destroy_ctes('emb', 's1', 't1', STAGE)},
{S.k1_on('s1', 's2', 't2', STAGE)},
{S.label_error_ctes('s2', 's3', 't3', STAGE, pool='emb')},
tr AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)"""


@register("k7_mixed_truth", f"""WITH {_MIXED_SQL}
SELECT tr.issue_type, tr.id, tr.id2 FROM tr""")
def k7_mixed_truth(spark, sf):
    """K7 / K8: off-topic -> near-duplicate -> label-error chain, truth tagged by issue."""
    _, t = K.mixed(read_embeddings(spark, sf), FRAC, SEED)
    return t.select("issue_type", "id", "id2")


@register("d20_contamination_info", f"""WITH {_MIXED_SQL},
n0 AS (SELECT count(*) AS n_original FROM emb), n3 AS (SELECT count(*) AS n_combined FROM s3)
SELECT issue_type, count(*) AS n_truth, any_value(n_original) AS n_original, any_value(n_combined) AS n_combined,
       any_value(n_combined) - any_value(n_original) AS n_added FROM tr, n0, n3 GROUP BY issue_type""")
def d20_contamination_info(spark, sf):
    emb = read_embeddings(spark, sf)
    c, t = K.mixed(emb, FRAC, SEED)
    return K.contamination_info(c, t, K._count(emb)).select(
        "issue_type", "n_truth", "n_original", "n_combined", "n_added")


@register("l2_mixed_eval", metrics_sql("h", by=["issue_type"], ctes=f"""{_MIXED_SQL},
{S.pairs_cte('p', 's3')}, {S.ranked_pairs_cte('rp', 'p')}, {S.pair_hits_cte('hp', 'rp', 't2')},
{S.label_ratio_ctes('s3', 'lr')},
rl AS (SELECT row_number() OVER (ORDER BY round(score, 9), id) AS rank, id FROM lr), {S.id_hits_cte('hl', 'rl', 't3')},
h AS (SELECT 'near_duplicate' AS issue_type, rank, hit FROM hp UNION ALL SELECT 'label_error' AS issue_type, rank, hit FROM hl)"""))
def l2_mixed_eval(spark, sf):
    """L2: one table with all planted issues; near-duplicate (J1a) and label
    (J1c) audits scored against their own truth, grouped by issue type."""
    from tidemark.operators.audit import near_duplicate_eval

    c, t = K.mixed(read_embeddings(spark, sf), FRAC, SEED)
    t2 = t.where(F.col("issue_type") == "near_duplicate")
    t3 = t.where(F.col("issue_type") == "label_error")
    hl = id_hits(label_error_audit(c), t3).select(F.lit("label_error").alias("issue_type"), "rank", "hit")
    labels = ranking_metrics(hl, by=["issue_type"])
    dups = near_duplicate_eval(c, t2).select(F.lit("near_duplicate").alias("issue_type"), "*")
    return labels.unionByName(dups)


@register("l2_mixed_eval_off_topic")
def l2_mixed_eval_off_topic(spark, sf):
    """L2 for the off-topic issue with the J1b hierarchy score (rows-only check)."""
    from tidemark.operators.audit import off_topic_audit

    c, t = K.mixed(read_embeddings(spark, sf), FRAC, SEED)
    t1 = t.where(F.col("issue_type") == "off_topic")
    return ranking_metrics(id_hits(off_topic_audit(c), t1).select("rank", "hit"))


@register("l1_off_topic_eval_knn", metrics_sql("h", ctes=f"""{S.emb_cte()}, {S.destroy_ctes()},
{S.knn_cte('nn', 'k3c', 5, 'l2')},
ks AS (SELECT q AS id, max(dist) AS score FROM nn GROUP BY q),
r AS (SELECT row_number() OVER (ORDER BY -round(score, 9), id) AS rank, id FROM ks),
{S.id_hits_cte('h', 'r', 'k3t')}"""))
def l1_off_topic_eval_knn(spark, sf):
    """L1 (off-topic): K3 -> J8 kNN-distance outlier ranking -> C4 -> metrics."""
    from tidemark.operators import detectors as D
    from tidemark.operators.ranking import freeze

    c, t = K.destroy(read_embeddings(spark, sf), FRAC, SEED)
    ranked = D.outliers(freeze(c), lambda e: D.knn_distance(e, 5), 0.1)
    return ranking_metrics(id_hits(ranked, t).select("rank", "hit"))


@register("k1_text_near_duplicates", f"""WITH {_DOCS_SQL}, {S.sample_cte('kts', 'docs', SEED, 'k1', FRAC)},
kt AS (SELECT id, new_id, text, length(text) AS n,
              greatest(floor(length(text) * (0.5 + 0.4 * {S.u_sql(SEED, 'k1:len', 'id')})), 1)::BIGINT AS keep FROM kts),
ks AS (SELECT *, floor((n - keep) * {S.u_sql(SEED, 'k1:start', 'id')})::BIGINT AS st FROM kt),
kc AS (SELECT id, new_id, CASE WHEN {S.u_sql(SEED, 'k1:pad', 'id')} < 0.5
                                THEN '  ' || substring(text, st + 1, keep) || '  ' ELSE substring(text, st + 1, keep) END AS t
       FROM ks)
SELECT 'near_duplicate' AS issue_type, id, new_id AS id2, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM kc""")
def k1_text_near_duplicates(spark, sf):
    """K1 on documents: a contiguous 50-90 % span of sampled texts, padded with p = .5."""
    from tidemark.sources.readers import table

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    c, t = K.near_duplicates(docs, FRAC, SEED, perturb=K.text_crop(SEED), payload="text")
    return (t.join(c.select(F.col("id").alias("id2"), "text"), "id2")
            .select("issue_type", "id", "id2", F.length("text").cast("bigint").alias("n_chars"),
                    F.md5("text").alias("text_md5")))


@register("l1_near_duplicate_eval_lsh")
def l1_near_duplicate_eval_lsh(spark, sf):
    """L1 on the scale path (C2): random-projection LSH candidates within
    distance .05 instead of all pairs; the candidate ranking is scored against
    the planted truth (recall of the candidate set = n_hits / planted pairs)."""
    from tidemark.operators.pairs import lsh_candidates
    from tidemark.operators.ranking import freeze, global_rank

    emb = read_embeddings(spark, sf)
    c, t = K.near_duplicates(emb, FRAC, SEED)
    cand = lsh_candidates(freeze(c), max_dist=0.05).withColumn("_key", F.round("dist", 9))
    ranked = global_rank(cand, ["_key", "i", "j"], "rank").select("rank", "i", "j", F.col("dist").alias("score"))
    m = ranking_metrics(pair_hits(ranked, t).select("rank", "hit"))
    planted = t.agg(F.count(F.lit(1)).alias("n_planted"))
    return m.crossJoin(planted)
