"""Registered queries: Structured Streaming audits (S1, S2); their oracles are the batch operators."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.hashing import uniform
from tidemark.operators import contaminate as K
from tidemark.operators.metrics import metrics_sql
from tidemark.operators.ranking import freeze
from tidemark.plans import sqlparts as S
from tidemark.plans.q_votes import _SEQ_SQL, N_CLEAN
from tidemark.plans.registry import register
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.readers import read_embeddings, table
from tidemark.streaming.audit_stream import audit_stream, split_to_files
from tidemark.streaming.stopping import EVENTS_SCHEMA, HEARTBEAT, OUT_SCHEMA, stopping_stream


def _scratch(spark, what):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


@register("s1_incremental_audit", f"""WITH {S.emb_cte()}, {S.pairs_cte('pr', 'emb')}
SELECT greatest(i % 4, j % 4)::BIGINT AS batch_id, i, j, dist FROM pr WHERE dist <= 0.3""")
def s1_incremental_audit(spark, sf):
    """The embeddings arrive as 4 files; each batch is audited against the
    stored rows and itself. Returns the near-duplicate pairs (dist <= .3)."""
    src = _scratch(spark, "arrivals")
    split_to_files(table(spark, sf, "embeddings"), src, 4, "vec_id")
    q, out = audit_stream(spark, src, max_dist=0.3)
    q.awaitTermination()
    return (spark.read.schema("i long, j long, dist double, batch_id long").parquet(f"{out}/pairs")
            .select("batch_id", "i", "j", "dist"))


@register("s1_running_metrics", metrics_sql("h", by=["batch_id"], ctes=f"""
{S.emb_cte()}, {S.label_error_ctes()},
pp AS (SELECT a.id, greatest(a.id % 4, b.id % 4) AS seen, a.label = b.label AS same, {S.dist_sql('a.embedding', 'b.embedding')} AS dist
       FROM k5c a JOIN k5c b ON a.id <> b.id),
nn AS (SELECT t.b AS batch_id, e.id, min(CASE WHEN same AND seen <= t.b THEN dist END) AS ds,
              min(CASE WHEN NOT same AND seen <= t.b THEN dist END) AS d
       FROM range(4) t(b) JOIN k5c e ON e.id % 4 <= t.b LEFT JOIN pp ON pp.id = e.id GROUP BY ALL),
sc AS (SELECT batch_id, id, CASE WHEN d IS NULL THEN 1.0 ELSE coalesce(
              d * d / NULLIF(coalesce(ds, 1.0) * coalesce(ds, 1.0) + d * d, 0), 0.5) END AS score FROM nn),
h AS (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY round(score, 9), id) AS rank,
             CASE WHEN id IN (SELECT id FROM k5t) THEN 1 ELSE 0 END AS hit FROM sc)"""))
def s1_running_metrics(spark, sf):
    """Label errors are planted (K5), the rows arrive as 4 files, and the ranking of the rows so far is
    measured against the truth after each batch, from distances that each batch only updates."""
    c, t = K.label_errors(read_embeddings(spark, sf), 0.1, 42)
    src = _scratch(spark, "arrivals")
    arriving = table(spark, sf, "embeddings").drop("label").join(c.select(F.col("id").alias("vec_id"), "label"), "vec_id")
    split_to_files(arriving.select("vec_id", "embedding", "label"), src, 4, "vec_id")
    q, out = audit_stream(spark, src, max_dist=0.05, truth=freeze(t))
    q.awaitTermination()
    got = spark.read.parquet(f"{out}/metrics")
    return got.withColumn("batch_id", F.col("batch_id").cast("long"))


@register("s2_live_stopping_rule", f"""WITH {_SEQ_SQL}
SELECT annotator, pos, vote, kept_vote, greatest(pos - coalesce(stop_pos, pos), 0)::BIGINT AS dropped FROM kv""")
def s2_live_stopping_rule(spark, sf):
    """Events arrive up to 20 hours late and out of order, in one file for each day of arrival, four files
    to a micro-batch; a heartbeat closes the feed. The stopping rule runs in event time, 1 day behind."""
    src = _scratch(spark, "events-feed")
    ev = table(spark, sf, "events").select(*(F.col(c.name).cast(c.dataType) for c in StructType.fromDDL(EVENTS_SCHEMA)))
    came = F.to_date(F.timestamp_micros(F.unix_micros("ts") + (uniform(42, "arrival", "event_id") * 72e9).cast("long")))
    feed = freeze(ev.withColumn("_day", came))
    days = feed.groupBy("_day").agg(F.max("ts").alias("ts")).orderBy("_day").collect()   # a row per day
    for i, r in enumerate(days):
        feed.where(F.col("_day") == F.lit(r["_day"])).drop("_day").coalesce(1).write.parquet(f"{src}/day={i:05d}")
    if days:
        end = max(r["ts"] for r in days) + timedelta(days=3)
        (spark.createDataFrame([(None, end, None, HEARTBEAT, None, None)], EVENTS_SCHEMA).coalesce(1)
         .write.parquet(f"{src}/day={len(days):05d}"))
    q, out = stopping_stream(spark, src, n_clean=N_CLEAN, max_files_per_trigger=4)
    q.awaitTermination()
    return spark.read.schema(OUT_SCHEMA).parquet(f"{out}/votes").select("annotator", "pos", "vote", "kept_vote", "dropped")
