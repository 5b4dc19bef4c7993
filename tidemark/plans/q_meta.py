"""Registered queries: metadata truth, contaminations and reports
(A4, B1-B3, B7, B10, C6, C9, C12, D1-D3, D19, D20, F5, F7, F8, G1-G4, H7-H9, K2-K4, K7, L2, L3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import chained_fraction, pair_from_index, pair_to_index, sample_size
from tidemark.functions.vectors import hashed_bow, sq_norm
from tidemark.operators import contaminate as K
from tidemark.operators.audit import label_error_audit, near_duplicate_audit
from tidemark.operators.metrics import metrics_from_hit_ranks, metrics_sql, ranking_metrics
from tidemark.operators.pairs import pair_hit_ranks
from tidemark.operators.ranking import freeze
from tidemark.operators.truth import group_pair_counts, group_pair_hits, id_hits, pair_hits
from tidemark.plans import sqlparts as S
from tidemark.plans.registry import register
from tidemark.sources.fixtures import ANNOTATORS, vote_table, vote_table_sql
from tidemark.sources.readers import decode_manifest, manifest, read_embeddings, table

SEED = 42
FRAC = 0.1


def _emb(spark, sf):
    return read_embeddings(spark, sf)


def _vec_cols():
    return [F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("emb_sum"),
            F.sqrt(sq_norm("embedding")).alias("emb_norm")]


_VEC_SQL = "list_sum(embedding) AS emb_sum, sqrt(list_sum(list_transform(embedding, lambda y: y * y))) AS emb_norm"


# --------------------------------------------------------------------------- #
# metadata truth on documents / labels
# --------------------------------------------------------------------------- #

_VERIFIED = """vr AS (SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)
              WHERE l.quality IS NOT NULL)"""


def _verified(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(lab, "doc_id", "left").where(F.col("quality").isNotNull())


@register("b1_verified_rows", f"WITH {_VERIFIED} SELECT doc_id, quality FROM vr")
def b1_verified_rows(spark, sf):
    return _verified(spark, sf).select("doc_id", "quality")


@register("b2_truth_predicate", f"""WITH {_VERIFIED}
SELECT doc_id, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS is_error FROM vr""")
def b2_truth_predicate(spark, sf):
    return _verified(spark, sf).select("doc_id", F.when(F.col("quality") == 0, 1).otherwise(0).alias("is_error"))


@register("b3_dense_reindex", f"""WITH {_VERIFIED}
SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS id, doc_id FROM vr""")
def b3_dense_reindex(spark, sf):
    v = _verified(spark, sf).select(F.col("doc_id").alias("id"), F.col("doc_id"))
    return K.dense_reindex(v, ["doc_id"]).select("id", "doc_id")


@register("b10_label_column", "SELECT doc_id, lang AS label FROM documents")
def b10_label_column(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))


@register("d2_label_error_rate", f"""WITH {_VERIFIED}
SELECT count(*) AS n, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)::BIGINT AS n_errors,
       avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END) * 100 AS error_pct FROM vr""")
def d2_label_error_rate(spark, sf):
    v = _verified(spark, sf)
    e = F.when(F.col("quality") == 0, 1).otherwise(0)
    return v.agg(F.count(F.lit(1)).alias("n"), F.sum(e).cast("bigint").alias("n_errors"),
                 (F.avg(e.cast("double")) * 100).alias("error_pct"))


# --------------------------------------------------------------------------- #
# B7 factorisation, C12 vote merge, A4 manifest
# --------------------------------------------------------------------------- #

@register("b7_label_factorisation", """
WITH f AS (SELECT 'lang' AS src, lang AS name, min(doc_id) AS first_id FROM documents GROUP BY lang
           UNION ALL SELECT 'event_type' AS src, event_type AS name, min(event_id) AS first_id FROM events GROUP BY event_type)
SELECT src, name, (dense_rank() OVER (PARTITION BY src ORDER BY first_id) - 1)::INTEGER AS class_id FROM f""")
def b7_label_factorisation(spark, sf):
    """Class name -> consecutive code by first appearance (class tables are small)."""
    from pyspark.sql import Window

    d = table(spark, sf, "documents").groupBy(F.col("lang").alias("name")).agg(
        F.min("doc_id").alias("first_id")).withColumn("src", F.lit("lang"))
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(
        F.min("event_id").alias("first_id")).withColumn("src", F.lit("event_type"))
    f = d.unionByName(e)
    w = Window.partitionBy("src").orderBy("first_id")
    return f.select("src", "name", (F.dense_rank().over(w) - 1).cast("int").alias("class_id"))


@register("c12_vote_merge", f"""WITH {vote_table_sql()}
SELECT d.doc_id, d.lang, vt.sampling_type, vt.Ranking, vt.{ANNOTATORS[0]} FROM documents d JOIN vt ON vt.item_id = d.doc_id""")
def c12_vote_merge(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    vt = vote_table(spark, sf).select(F.col("item_id").alias("doc_id"), "sampling_type", "Ranking", ANNOTATORS[0])
    return docs.join(vt, "doc_id")


@register("a4_manifest", """
SELECT format('{:d}|{}.jpg', vec_id, label::VARCHAR) AS filename, vec_id::BIGINT AS id, label::INTEGER AS label FROM embeddings""")
def a4_manifest(spark, sf):
    m = manifest(_emb(spark, sf))
    return decode_manifest(m).select(
        F.format_string("%d|%s.jpg", F.col("id"), F.col("label").cast("string")).alias("filename"), "id", "label")


# --------------------------------------------------------------------------- #
# group-key truth (C6, D1, D3) on orders
# --------------------------------------------------------------------------- #

@register("c6_group_pairs", """
SELECT o_custkey, count(*) AS n_members, (count(*) * (count(*) - 1) // 2)::BIGINT AS n_pairs
FROM orders GROUP BY o_custkey""")
def c6_group_pairs(spark, sf):
    """Pairs of orders sharing a customer, counted per group (pair lists
    are never emitted; membership is the predicate of ``group_pair_hits``)."""
    return group_pair_counts(table(spark, sf, "orders"), "o_custkey")


@register("d1_duplicate_rate", """
WITH g AS (SELECT count(*) AS c FROM orders GROUP BY o_custkey),
p AS (SELECT sum(c * (c - 1) // 2) AS n_pairs, sum(c)::DOUBLE AS n FROM g)
SELECT n_pairs::BIGINT AS n_pairs, n_pairs / (n * (n - 1) / 2) * 100 AS duplicate_pct,
       2 * n_pairs / (n * (n - 1) / 2) * 100 AS duplicate_pct_ordered FROM p""")
def d1_duplicate_rate(spark, sf):
    """Pairs / (n (n-1) / 2) * 100; ``_ordered`` reproduces the reference's count."""
    g = group_pair_counts(table(spark, sf, "orders"), "o_custkey")
    p = g.agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_members").cast("double").alias("n"))
    tot = F.col("n") * (F.col("n") - 1) / 2
    return p.select(F.col("n_pairs").cast("bigint").alias("n_pairs"),
                    (F.col("n_pairs") / tot * 100).alias("duplicate_pct"),
                    (2 * F.col("n_pairs") / tot * 100).alias("duplicate_pct_ordered"))


@register("d3_groups_gt1", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def d3_groups_gt1(spark, sf):
    return (table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


# --------------------------------------------------------------------------- #
# L3: audit vs metadata truth on documents (hashed bag-of-words vectors)
# --------------------------------------------------------------------------- #

def _doc_vectors(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return docs, hashed_bow(docs, "doc_id", "text", 64)


@register("l3_metadata_duplicates", metrics_sql("h", ctes=f"""
{S.bow_cte('bw', 'documents', 'doc_id', 'text')},
{S.pairs_cte('p', 'bw')}, {S.ranked_pairs_cte('r', 'p')},
dk AS (SELECT doc_id, md5(text) AS k FROM documents),
h AS (SELECT r.rank, CASE WHEN a.k = b.k THEN 1 ELSE 0 END AS hit FROM r
      LEFT JOIN dk a ON a.doc_id = r.i LEFT JOIN dk b ON b.doc_id = r.j)"""))
def l3_metadata_duplicates(spark, sf):
    """L3 (duplicates): truth = documents sharing a text (C6 on md5(text));
    detector = J1a over hashed bag-of-words vectors; metrics D11-D14."""
    docs, vec = _doc_vectors(spark, sf)
    vec = freeze(vec)
    key = freeze(docs.select(F.md5("text").alias("k"), F.col("doc_id").alias("id")))
    # the ranks of the pairs that share a text among all pairs; the ranking itself is not written
    shared = key.join(key.withColumnRenamed("id", "id2"), "k").where("id <= id2").select("id", "id2").distinct()
    hits = group_pair_hits(pair_hit_ranks(vec, shared, repeats=True), key, "k").where("hit = 1")
    # a pair of the ranking counts once for each row of its documents
    times = vec.join(key.groupBy("id").agg(F.count(F.lit(1)).alias("w")), "id")
    n_items = times.agg(((F.sum("w") * F.sum("w") - F.sum(F.col("w") * F.col("w"))) / 2).cast("long")).first()[0]
    return metrics_from_hit_ranks(hits, n_items or 0)


@register("l3_metadata_label_errors", metrics_sql("h", ctes=f"""
{_VERIFIED}, vd AS (SELECT d.doc_id, d.text, d.lang FROM documents d JOIN vr USING (doc_id)),
{S.bow_cte('bw', 'vd', 'doc_id', 'text')},
lb AS (SELECT vd.doc_id AS id, bw.embedding, (dense_rank() OVER (ORDER BY lang) - 1)::INTEGER AS label
       FROM vd JOIN bw ON bw.id = vd.doc_id),
{S.label_ratio_ctes('lb', 'lr')},
r AS (SELECT row_number() OVER (ORDER BY round(score, 9), id) AS rank, id FROM lr),
tr AS (SELECT doc_id AS id FROM vr WHERE quality = 0),
{S.id_hits_cte('h', 'r', 'tr')}"""))
def l3_metadata_label_errors(spark, sf):
    """L3 (labels): verified documents (B1), class = language (B10, coded by
    name order), truth = quality 0 (B2); detector = J1c on bag-of-words vectors."""
    from pyspark.sql import Window

    v = _verified(spark, sf)
    vec = hashed_bow(v, "doc_id", "text", 64)
    codes = v.select("lang").distinct().withColumn(
        "label", (F.dense_rank().over(Window.orderBy("lang")) - 1).cast("int"))
    emb = (vec.join(v.select(F.col("doc_id").alias("id"), "lang"), "id")
           .join(F.broadcast(codes), "lang").select("id", "embedding", "label"))
    ranked = label_error_audit(emb)
    truth = v.where(F.col("quality") == 0).select(F.col("doc_id").alias("id"))
    return ranking_metrics(id_hits(ranked, truth).select("rank", "hit"))


# --------------------------------------------------------------------------- #
# reports (F5, F7, F8) and pair relations
# --------------------------------------------------------------------------- #

@register("f5_top_pairs_report", f"""WITH {S.emb_cte()}, {S.pairs_cte('p', 'emb')}, {S.ranked_pairs_cte('r', 'p')}
SELECT r.rank::BIGINT AS rank, r.i, r.j, r.score, a.label AS label_i, b.label AS label_j
FROM r JOIN emb a ON a.id = r.i JOIN emb b ON b.id = r.j WHERE r.rank <= 7""")
def f5_top_pairs_report(spark, sf):
    """the 7 closest pairs with their labels (top-k is the feature)."""
    emb = _emb(spark, sf)
    top = near_duplicate_audit(emb, top=7)   # all pairs are compared, the head alone is kept
    lab = emb.select("id", "label")
    return (top.join(lab.select(F.col("id").alias("i"), F.col("label").alias("label_i")), "i")
            .join(lab.select(F.col("id").alias("j"), F.col("label").alias("label_j")), "j")
            .select("rank", "i", "j", "score", "label_i", "label_j"))


@register("f7_worst_ranked_errors", f"""WITH {S.emb_cte()}, {S.label_error_ctes()}, {S.label_ratio_ctes('k5c', 'lr')},
r AS (SELECT row_number() OVER (ORDER BY round(score, 9), id)::BIGINT AS rank, id, score FROM lr)
SELECT r.rank, r.id, r.score FROM r JOIN k5t USING (id) ORDER BY r.rank DESC LIMIT 5""")
def f7_worst_ranked_errors(spark, sf):
    """the 5 planted label errors the detector ranked last."""
    c, t = K.label_errors(_emb(spark, sf), FRAC, SEED)
    hits = id_hits(label_error_audit(c), t).where(F.col("hit") == 1)
    return hits.orderBy(F.col("rank").desc()).limit(5).select("rank", "id", "score")


@register("f8_error_histogram", f"""WITH {S.emb_cte()}, {S.label_error_ctes()},
n AS (SELECT count(*)::DOUBLE AS n FROM emb)
SELECT least(floor(id * 10 / n), 9)::INTEGER AS bin, count(*) AS n_errors FROM k5t, n GROUP BY bin""")
def f8_error_histogram(spark, sf):
    """F8: where in id order the planted errors sit (10 equal-width bins)."""
    emb = _emb(spark, sf)
    _, t = K.label_errors(emb, FRAC, SEED)
    n = emb.agg(F.count(F.lit(1)).cast("double").alias("n"))
    return (t.crossJoin(n).select(F.least(F.floor(F.col("id") * 10 / F.col("n")), F.lit(9)).cast("int").alias("bin"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n_errors")))


@register("c9_same_label_pairs", f"""WITH {S.emb_cte()}
SELECT a.label, count(*) AS n_pairs FROM emb a JOIN emb b ON a.id < b.id AND a.label = b.label GROUP BY a.label""")
def c9_same_label_pairs(spark, sf):
    """Same-label pairs per label, from the sizes of the labels (no pair is built to be counted)."""
    sizes = _emb(spark, sf).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.where("n > 1").select("label", F.expr("n * (n - 1) div 2").alias("n_pairs"))


@register("h9_pair_index", f"""WITH {S.emb_cte()}
SELECT a.id AS i, b.id AS j, (row_number() OVER (ORDER BY a.id, b.id) - 1)::BIGINT AS k
FROM emb a JOIN emb b ON a.id < b.id""")
def h9_pair_index(spark, sf):
    """H9: every pair of the n embedding positions enumerated from its position
    0 .. n(n-1)/2 - 1 (``spark.range``, no self-join); ``k`` is computed back
    from the pair, so a wrong row shows instead of disappearing."""
    n = read_embeddings(spark, sf).count()
    ks = spark.range(n * (n - 1) // 2).withColumnRenamed("id", "pos")
    i, j = pair_from_index(F.col("pos"), F.lit(n))
    p = ks.select(i.alias("i"), j.alias("j"))
    return p.select("i", "j", pair_to_index("i", "j", F.lit(n)).alias("k"))


@register("h7_h8_sample_sizes", f"""WITH {S.emb_cte()}
SELECT label, count(*) AS n_c, ceil(count(*) * 0.1)::BIGINT AS n_errors,
       pow(1 + 0.1, 1.0 / 3.0) - 1 AS stage_frac,
       ceil(count(*) * (pow(1 + 0.1, 1.0 / 3.0) - 1))::BIGINT AS n_stage FROM emb GROUP BY label""")
def h7_h8_sample_sizes(spark, sf):
    """H7 sample size ceil(f n) per class and H8 chained stage fraction."""
    g = _emb(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
    return g.select("label", "n_c", sample_size("n_c", 0.1).alias("n_errors"),
                    chained_fraction(F.lit(0.1)).alias("stage_frac"),
                    F.ceil(F.col("n_c") * chained_fraction(F.lit(0.1))).cast("bigint").alias("n_stage"))


@register("d19_distinct_counts", """
SELECT (SELECT count(DISTINCT label) FROM embeddings) AS n_labels,
       (SELECT count(DISTINCT lang) FROM documents) AS n_langs,
       (SELECT count(DISTINCT event_type) FROM events) AS n_event_types""")
def d19_distinct_counts(spark, sf):
    a = _emb(spark, sf).agg(F.countDistinct("label").alias("n_labels"))
    b = table(spark, sf, "documents").agg(F.countDistinct("lang").alias("n_langs"))
    c = table(spark, sf, "events").agg(F.countDistinct("event_type").alias("n_event_types"))
    return a.crossJoin(b).crossJoin(c)
