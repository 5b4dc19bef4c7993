"""Registered queries: human votes and annotation sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import n_clean
from tidemark.operators import contaminate as K
from tidemark.operators.audit import label_error_audit
from tidemark.operators.stats import mann_whitney
from tidemark.operators.truth import missed, rank_lookup
from tidemark.operators.votes import (
    annotator_sequences, bias_strata, encode_vote, error_percentages, majority_vote,
    rolling_errors, stop_votes, unanimous,
)
from tidemark.plans import sqlparts as S
from tidemark.plans.registry import register
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.fixtures import ANNOTATORS, vote_table, vote_table_sql
from tidemark.sources.readers import read_annotations, read_embeddings, table

N_CLEAN = n_clean(0.4, 0.05)   # E2 with p_plus = .4, p_chance = .05 (FIXTURES.md): 5
VT = vote_table_sql()
_UNPIVOT = " UNION ALL ".join(
    f"SELECT item_id, {k} AS col_idx, {c} AS vote FROM vt WHERE {c} IS NOT NULL" for k, c in enumerate(ANNOTATORS))
_MAJORITY = f"""lv AS ({_UNPIVOT}),
vc AS (SELECT item_id, vote, count(*) AS c, min(col_idx) AS first FROM lv GROUP BY item_id, vote),
best AS (SELECT item_id, arg_max(vote, c * 100 - first) AS label FROM vc GROUP BY item_id),
mv AS (SELECT vt.*, best.label FROM vt LEFT JOIN best USING (item_id))"""
_STRATA = f"""{_MAJORITY},
st AS (SELECT * FROM (SELECT mv.*, row_number() OVER (PARTITION BY sampling_type ORDER BY Ranking, item_id) AS pos
       FROM mv WHERE sampling_type IN ('maximum_bias', 'minimum_bias') AND label IS NOT NULL) WHERE pos <= 50)"""


@register("a3_annotation_csv", f"WITH {VT} SELECT item_id, sampling_type, Ranking, "
          + ", ".join(ANNOTATORS) + " FROM vt")
def a3_annotation_csv(spark, sf):
    """A3: write the vote export as CSV to the shared folder, read it back with a schema."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/annotations-{uuid.uuid4().hex}"
    vote_table(spark, sf).drop("lang").write.mode("errorifexists").option("header", True).csv(path)
    return read_annotations(spark, path, ANNOTATORS)


@register("d5_majority_vote", f"WITH {VT}, {_MAJORITY} SELECT item_id, label FROM mv")
def d5_majority_vote(spark, sf):
    return majority_vote(vote_table(spark, sf), "item_id", ANNOTATORS).select("item_id", "label")


@register("b5_vote_encoding", f"""WITH {VT}, {_MAJORITY}
SELECT item_id, CASE WHEN label = 'Yes' THEN 1 ELSE 0 END AS y FROM mv""")
def b5_vote_encoding(spark, sf):
    mv = majority_vote(vote_table(spark, sf), "item_id", ANNOTATORS)
    return mv.select("item_id", encode_vote("label").alias("y"))


@register("f6_bias_strata", f"WITH {VT}, {_STRATA} SELECT sampling_type, pos::BIGINT AS pos, item_id, label FROM st")
def f6_bias_strata(spark, sf):
    mv = majority_vote(vote_table(spark, sf), "item_id", ANNOTATORS)
    return bias_strata(mv).select("sampling_type", "pos", "item_id", "label")


@register("d7_error_percentages", f"""WITH {VT}, {_STRATA},
d AS (SELECT sampling_type, CASE WHEN pos <= 25 THEN 'first' ELSE 'second' END AS half,
             CASE WHEN label = 'Yes' THEN 1 ELSE 0 END AS y FROM st)
SELECT sampling_type, 'all' AS half, round(avg(y) * 100, 1) AS error_pct, count(*) AS n FROM d GROUP BY sampling_type
UNION ALL
SELECT sampling_type, half, round(avg(y) * 100, 1) AS error_pct, count(*) AS n FROM d GROUP BY sampling_type, half""")
def d7_error_percentages(spark, sf):
    mv = majority_vote(vote_table(spark, sf), "item_id", ANNOTATORS)
    return error_percentages(bias_strata(mv))


_STRATA_BY_LANG = _STRATA.replace("PARTITION BY sampling_type", "PARTITION BY lang, sampling_type")


@register("e3_rolling_errors", f"""WITH {VT}, {_STRATA_BY_LANG},
sq AS (SELECT lang, CASE WHEN label = 'Yes' THEN 1 ELSE 0 END AS y,
              row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN sampling_type = 'maximum_bias' THEN pos ELSE pos + 1000000 END) AS i
       FROM st),
rw AS (SELECT lang, i, avg(y) OVER (PARTITION BY lang ORDER BY i ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) * 100 AS error_pct FROM sq)
SELECT lang, (i - 6)::INTEGER AS center, error_pct FROM rw WHERE i >= 11""")
def e3_rolling_errors(spark, sf):
    """E3/E4 per language (the 'dataset' of the fixture)."""
    mv = majority_vote(vote_table(spark, sf), "item_id", ANNOTATORS)
    strata = _strata_by(mv, ["lang"])
    return rolling_errors(strata, ["lang"])


def _strata_by(mv, by):
    from tidemark.operators.contaminate import rank_within

    f = mv.where(F.col("sampling_type").isin("maximum_bias", "minimum_bias") & F.col("label").isNotNull())
    r = rank_within(f, [*by, "sampling_type"], ["Ranking", "item_id"], "pos")
    return r.where(F.col("pos") <= 50)


_MWU_SQL = """
ar AS (SELECT *, (rank() OVER (PARTITION BY {g} ORDER BY y) + (count(*) OVER (PARTITION BY {g}, y) - 1) / 2.0) AS r FROM d),
sm AS (SELECT {g}, sum(CASE WHEN grp = 'x' THEN r END) AS r_x, sum(CASE WHEN grp = 'x' THEN 1 ELSE 0 END)::DOUBLE AS n_x,
              sum(CASE WHEN grp = 'x' THEN 0 ELSE 1 END)::DOUBLE AS n_y FROM ar GROUP BY {g}),
tt AS (SELECT {g}, sum(t * t * t - t) AS tie FROM (SELECT {g}, y, count(*)::DOUBLE AS t FROM d GROUP BY {g}, y) GROUP BY {g}),
uu AS (SELECT sm.*, tt.tie, r_x - n_x * (n_x + 1) / 2 AS u, n_x + n_y AS n FROM sm JOIN tt USING ({g})),
zz AS (SELECT uu.*, (u - n_x * n_y / 2) / NULLIF(sqrt(n_x * n_y / 12 * ((n + 1) - tie / NULLIF(n * (n - 1), 0))), 0) AS z FROM uu),
pp AS (SELECT zz.*, 1 - 0.5 * (1 + sign(z / sqrt(2)) * (1 - (t1 * (0.254829592 + t1 * (-0.284496736 + t1 * (1.421413741
          + t1 * (-1.453152027 + t1 * 1.061405429))))) * exp(-(z / sqrt(2)) * (z / sqrt(2))))) AS p
       FROM (SELECT zz.*, 1 / (1 + 0.3275911 * abs(z / sqrt(2))) AS t1 FROM zz) zz)
SELECT {g}, n_x::BIGINT AS n_x, n_y::BIGINT AS n_y, u, z, p, 2 * u / NULLIF(n_x * n_y, 0) AS r_b,
       2 * u / NULLIF(n_x * n_y, 0) - 1 AS r_rb,
       CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars FROM pp"""


@register("l8_mann_whitney", f"""WITH {VT}, {_STRATA_BY_LANG},
d AS (SELECT lang AS grp_key, item_id AS id, CASE WHEN sampling_type = 'maximum_bias' THEN 'x' ELSE 'y' END AS grp,
             CASE WHEN label = 'Yes' THEN 1 ELSE 0 END AS y FROM st),
{_MWU_SQL.format(g='grp_key')}""")
def l8_mann_whitney(spark, sf):
    """Max-bias vs min-bias error indicators, per language."""
    mv = majority_vote(vote_table(spark, sf), "item_id", ANNOTATORS)
    st = _strata_by(mv, ["lang"])
    d = st.select(F.col("lang").alias("grp_key"), F.col("item_id").alias("id"),
                  F.when(F.col("sampling_type") == "maximum_bias", "x").otherwise("y").alias("grp"),
                  encode_vote("label").alias("y"))
    return mann_whitney(d, "y", "grp", "x", by=["grp_key"])


@register("l8_mann_whitney_halves", f"""WITH {VT}, {_STRATA_BY_LANG},
d AS (SELECT lang AS grp_key, item_id AS id, CASE WHEN pos <= 25 THEN 'x' ELSE 'y' END AS grp,
             CASE WHEN label = 'Yes' THEN 1 ELSE 0 END AS y FROM st WHERE sampling_type = 'maximum_bias'),
{_MWU_SQL.format(g='grp_key')}""")
def l8_mann_whitney_halves(spark, sf):
    """L8 on halves (E5): max-bias ranks 1-25 vs 26-50, per language."""
    mv = majority_vote(vote_table(spark, sf), "item_id", ANNOTATORS)
    st = _strata_by(mv, ["lang"]).where(F.col("sampling_type") == "maximum_bias")
    d = st.select(F.col("lang").alias("grp_key"), F.col("item_id").alias("id"),
                  F.when(F.col("pos") <= 25, "x").otherwise("y").alias("grp"), encode_vote("label").alias("y"))
    return mann_whitney(d, "y", "grp", "x", by=["grp_key"])


_SEQ_SQL = f"""ev AS (SELECT user_id AS annotator, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS vote FROM events),
lm AS (SELECT *, max(CASE WHEN vote = 1 THEN pos END) OVER (PARTITION BY annotator ORDER BY pos
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM ev),
sp AS (SELECT annotator, min(pos) AS stop_pos FROM lm WHERE pos - coalesce(last, -1) >= {N_CLEAN} GROUP BY annotator),
kv AS (SELECT annotator, pos, vote, stop_pos,
              CASE WHEN stop_pos IS NULL OR pos <= stop_pos THEN vote END AS kept_vote FROM lm LEFT JOIN sp USING (annotator))"""


@register("e1_stopping_rule", f"WITH {_SEQ_SQL} SELECT annotator, pos::BIGINT AS pos, vote, stop_pos::BIGINT AS stop_pos, kept_vote FROM kv")
def e1_stopping_rule(spark, sf):
    seq = annotator_sequences(table(spark, sf, "events"))
    return stop_votes(seq, n_clean=N_CLEAN).select("annotator", "pos", "vote", "stop_pos", "kept_vote")


_PANEL_SQL = f"""{_SEQ_SQL},
pv AS (SELECT annotator // 3 AS panel, pos, kept_vote FROM kv WHERE kept_vote IS NOT NULL),
na AS (SELECT user_id // 3 AS panel, count(DISTINCT user_id) AS n_a FROM events GROUP BY 1),
un AS (SELECT pv.panel, pv.pos, CASE WHEN count(kept_vote) = any_value(na.n_a) AND min(kept_vote) = max(kept_vote)
                                   THEN min(kept_vote) ELSE 0 END AS all_equal_vote
       FROM pv JOIN na USING (panel) GROUP BY pv.panel, pv.pos)"""


def _panel_unanimous(spark, sf):
    ev = table(spark, sf, "events")
    seq = annotator_sequences(ev)
    kv = stop_votes(seq, n_clean=N_CLEAN).where(F.col("kept_vote").isNotNull())
    pv = kv.select(F.floor(F.col("annotator") / 3).cast("bigint").alias("panel"), "pos", "kept_vote")
    na = ev.groupBy(F.floor(F.col("user_id") / 3).cast("bigint").alias("panel")).agg(
        F.countDistinct("user_id").alias("_na"))
    return unanimous(pv, ["panel", "pos"], "annotator", "kept_vote", na)


@register("d6_unanimous_vote", f"WITH {_PANEL_SQL} SELECT panel::BIGINT AS panel, pos::BIGINT AS pos, all_equal_vote FROM un")
def d6_unanimous_vote(spark, sf):
    """Panels of three annotators (user_id div 3) vote on positions."""
    return _panel_unanimous(spark, sf).select("panel", "pos", "all_equal_vote")


@register("l5_missed_errors", f"""WITH {_PANEL_SQL}, {S.emb_cte()}, {S.label_error_ctes()}, {S.label_ratio_ctes('k5c', 'lr')},
r AS (SELECT row_number() OVER (ORDER BY round(score, 9), id) AS rank, id FROM lr),
cf AS (SELECT un.panel, r.id FROM un JOIN r ON r.rank = un.pos + 1 WHERE un.all_equal_vote = 1),
pn AS (SELECT DISTINCT panel FROM na)
SELECT pn.panel::BIGINT AS panel, count(t.id)::BIGINT AS n_missed
FROM pn CROSS JOIN k5t t LEFT JOIN cf ON cf.panel = pn.panel AND cf.id = t.id
WHERE cf.id IS NULL GROUP BY pn.panel""")
def l5_missed_errors(spark, sf):
    """E1 -> D6 -> C13 (position -> ranked id) -> C11 (true label errors
    never confirmed), per annotator panel."""
    un = _panel_unanimous(spark, sf)
    c, t = K.label_errors(read_embeddings(spark, sf), 0.1, 42)
    ranking = label_error_audit(c)
    pos = un.where(F.col("all_equal_vote") == 1).select("panel", (F.col("pos") + 1).alias("rank"))
    confirmed = rank_lookup(pos, ranking.select("rank", "id"))
    panels = table(spark, sf, "events").select(F.floor(F.col("user_id") / 3).cast("bigint").alias("panel")).distinct()
    # missed = |truth| - |truth confirmed by the panel|: no panel x truth product
    found = (confirmed.select("panel", "id").distinct().join(t.select("id").distinct(), "id", "left_semi")
             .groupBy("panel").agg(F.count(F.lit(1)).alias("_found")))
    n_truth = t.select("id").distinct().agg(F.count(F.lit(1)).alias("_nt"))
    return (panels.join(found, "panel", "left").join(F.broadcast(n_truth))
            .select("panel", (F.col("_nt") - F.coalesce(F.col("_found"), F.lit(0))).cast("bigint").alias("n_missed")))


@register("c11_missed_total", f"""WITH {_PANEL_SQL}, {S.emb_cte()}, {S.label_error_ctes()}, {S.label_ratio_ctes('k5c', 'lr')},
r AS (SELECT row_number() OVER (ORDER BY round(score, 9), id) AS rank, id FROM lr),
cf AS (SELECT DISTINCT r.id FROM un JOIN r ON r.rank = un.pos + 1 WHERE un.all_equal_vote = 1)
SELECT count(*)::BIGINT AS n_missed FROM (SELECT DISTINCT id FROM k5t) t WHERE id NOT IN (SELECT id FROM cf)""")
def c11_missed_total(spark, sf):
    """C11: true errors confirmed by no panel, counted."""
    un = _panel_unanimous(spark, sf)
    c, t = K.label_errors(read_embeddings(spark, sf), 0.1, 42)
    ranking = label_error_audit(c)
    pos = un.where(F.col("all_equal_vote") == 1).select((F.col("pos") + 1).alias("rank"))
    confirmed = rank_lookup(pos, ranking.select("rank", "id")).select("id").distinct()
    return missed(t, confirmed)


@register("b6_question_harmonisation", f"WITH {VT}, {_MAJORITY} SELECT item_id, label FROM mv")
def b6_question_harmonisation(spark, sf):
    """An export whose vote column carries a question header is renamed to ``label``."""
    from tidemark.sources.readers import QUESTION_HEADERS, harmonise_question

    mv = majority_vote(vote_table(spark, sf), "item_id", ANNOTATORS)
    exported = mv.select("item_id", F.col("label").alias(QUESTION_HEADERS[0]))
    return harmonise_question(exported).select("item_id", "label")


@register("l4_human_vote_validation", f"""WITH {VT}, {_STRATA_BY_LANG},
d AS (SELECT lang AS grp_key, item_id AS id, CASE WHEN sampling_type = 'maximum_bias' THEN 'x' ELSE 'y' END AS grp,
             CASE WHEN label = 'Yes' THEN 1 ELSE 0 END AS y FROM st),
pct AS (SELECT grp_key, round(avg(CASE WHEN grp = 'x' THEN y END) * 100, 1) AS error_pct_max_bias,
               round(avg(CASE WHEN grp = 'y' THEN y END) * 100, 1) AS error_pct_min_bias FROM d GROUP BY grp_key),
{_MWU_SQL.format(g='grp_key').split(chr(10) + "SELECT ")[0]},
mw AS (SELECT {_MWU_SQL.format(g='grp_key').split(chr(10) + "SELECT ")[1]})
SELECT pct.grp_key AS lang, error_pct_max_bias, error_pct_min_bias, mw.u, mw.p, mw.stars
FROM pct JOIN mw USING (grp_key)""")
def l4_human_vote_validation(spark, sf):
    """L4: majority vote -> strata (top 50 by Ranking) -> error % per stratum
    and the one-sided Mann-Whitney test, per language."""
    mv = majority_vote(vote_table(spark, sf), "item_id", ANNOTATORS)
    st = _strata_by(mv, ["lang"])
    d = st.select(F.col("lang").alias("grp_key"), F.col("item_id").alias("id"),
                  F.when(F.col("sampling_type") == "maximum_bias", "x").otherwise("y").alias("grp"),
                  encode_vote("label").alias("y"))
    pct = d.groupBy("grp_key").agg(
        F.round(F.avg(F.when(F.col("grp") == "x", F.col("y"))) * 100, 1).alias("error_pct_max_bias"),
        F.round(F.avg(F.when(F.col("grp") == "y", F.col("y"))) * 100, 1).alias("error_pct_min_bias"))
    mw = mann_whitney(d, "y", "grp", "x", by=["grp_key"])
    return (pct.join(mw, "grp_key").select(F.col("grp_key").alias("lang"), "error_pct_max_bias",
                                           "error_pct_min_bias", "u", "p", "stars"))
