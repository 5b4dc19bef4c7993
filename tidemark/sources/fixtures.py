"""Derived inputs: the reference's vote tables and paired scores, built by
Spark from the given tables (so their size grows with the tables).

* wide vote export from ``documents``: five annotator columns Yes/No/null
  from md5(seed, annotator, doc_id); stratum from pmod(doc_id, 2); Ranking =
  position by n_chars inside the stratum,
* paired scores from ``events``: mean value per user in the first and the
  second half of the month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import uniform
from tidemark.operators.contaminate import rank_within
from tidemark.sources.readers import table

ANNOTATORS = [f"anno_{k}_label" for k in range(5)]
P_MISSING = 0.15
P_YES = {"maximum_bias": 0.35, "minimum_bias": 0.15}


def vote_table(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    st = F.when(F.pmod(F.col("doc_id"), F.lit(2)) == 0, F.lit("maximum_bias")).otherwise(F.lit("minimum_bias"))
    d = docs.withColumn("sampling_type", st)
    p_yes = F.when(F.col("sampling_type") == "maximum_bias", F.lit(P_YES["maximum_bias"])).otherwise(
        F.lit(P_YES["minimum_bias"]))
    for k, name in enumerate(ANNOTATORS):
        u = uniform(seed, f"anno{k}", "doc_id")
        d = d.withColumn(name, F.when(u < P_MISSING, F.lit(None).cast("string"))
                         .when(u < F.lit(P_MISSING) + p_yes, F.lit("Yes")).otherwise(F.lit("No")))
    r = rank_within(d, ["sampling_type"], ["n_chars", "doc_id"], "Ranking")
    return r.select(F.col("doc_id").alias("item_id"), "lang", "sampling_type",
                    F.col("Ranking").cast("int").alias("Ranking"), *ANNOTATORS)


def vote_table_sql(seed: int = 42) -> str:
    from tidemark.plans.sqlparts import u_sql

    cols = []
    for k, name in enumerate(ANNOTATORS):
        u = u_sql(seed, f"anno{k}", "doc_id")
        cols.append(f"CASE WHEN {u} < {P_MISSING} THEN NULL WHEN {u} < {P_MISSING} + "
                    f"(CASE WHEN doc_id % 2 = 0 THEN {P_YES['maximum_bias']} ELSE {P_YES['minimum_bias']} END) "
                    f"THEN 'Yes' ELSE 'No' END AS {name}")
    return f"""vt AS (SELECT doc_id AS item_id, lang,
    CASE WHEN doc_id % 2 = 0 THEN 'maximum_bias' ELSE 'minimum_bias' END AS sampling_type,
    (row_number() OVER (PARTITION BY doc_id % 2 ORDER BY n_chars, doc_id))::INTEGER AS Ranking,
    {', '.join(cols)} FROM documents)"""


def paired_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id = user, x = mean value days 1-15, y = mean value days 16+)``; users
    active in both halves only (an inner join)."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    first = F.dayofmonth("ts") <= 15
    a = ev.where(first).groupBy("user_id").agg(F.avg("value").alias("x"))
    b = ev.where(~first).groupBy("user_id").agg(F.avg("value").alias("y"))
    return a.join(b, "user_id").select(F.col("user_id").alias("id"), "x", "y")


PAIRED_SQL = """ps AS (SELECT a.user_id AS id, a.x, b.y FROM
  (SELECT user_id, avg(value) AS x FROM events WHERE dayofmonth(ts) <= 15 GROUP BY user_id) a JOIN
  (SELECT user_id, avg(value) AS y FROM events WHERE dayofmonth(ts) > 15 GROUP BY user_id) b USING (user_id))"""
