"""Truth joins (C3-C6, C10-C13): every membership test is a join.

The reference tests membership in Python lists (O(n m)); here the truth is a
table and each test an equi-join. Truth tables are far smaller than pair
rankings, but their size is not bounded by anything we control, so the
joins are left to Catalyst/AQE (broadcast when the statistics prove it
small, sort-merge otherwise) instead of a forced broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_hits(ranked_pairs: DataFrame, truth_pairs: DataFrame, ordered: bool = False,
              i: str = "i", j: str = "j") -> DataFrame:
    """``hit`` = predicted pair is a truth pair.

    ``ordered=False`` normalises both sides to ``(least, greatest)``;
    ``ordered=True`` keeps the reference's order-sensitive test.
    """
    if ordered:
        t = truth_pairs.select(F.col("id").alias("_ti"), F.col("id2").alias("_tj"))
        p = ranked_pairs.withColumn("_pi", F.col(i)).withColumn("_pj", F.col(j))
    else:
        t = truth_pairs.select(F.least("id", "id2").alias("_ti"), F.greatest("id", "id2").alias("_tj"))
        p = (ranked_pairs.withColumn("_pi", F.least(i, j)).withColumn("_pj", F.greatest(i, j)))
    t = t.dropDuplicates(["_ti", "_tj"]).withColumn("_hit", F.lit(1))
    return (p.join(t, (F.col("_pi") == F.col("_ti")) & (F.col("_pj") == F.col("_tj")), "left")
            .withColumn("hit", F.coalesce(F.col("_hit"), F.lit(0)))
            .drop("_pi", "_pj", "_ti", "_tj", "_hit"))


def id_hits(ranked: DataFrame, truth_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """``hit`` = ranked id is a truth id."""
    t = truth_ids.select(F.col("id").alias("_tid")).dropDuplicates(["_tid"]).withColumn("_hit", F.lit(1))
    return (ranked.join(t, F.col(id_col) == F.col("_tid"), "left")
            .withColumn("hit", F.coalesce(F.col("_hit"), F.lit(0))).drop("_tid", "_hit"))


def group_pair_counts(df: DataFrame, key: str) -> DataFrame:
    """C6 / D3 sizes: members and pairs per group, ``n (n - 1) / 2``.

    The reference lists every pair of rows sharing a key. Emitting them is
    quadratic in the group size (a key holding a third of the table would
    produce n^2 / 18 rows), so pair counts come from group sizes and pair
    membership is a predicate (:func:`group_pair_hits`).
    """
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_members"))
    return g.withColumn("n_pairs", (F.col("n_members") * (F.col("n_members") - 1) / 2).cast("bigint"))


def group_pair_hits(ranked_pairs: DataFrame, keys: DataFrame, key: str, id_col: str = "id",
                    i: str = "i", j: str = "j") -> DataFrame:
    """C6 + C3: ``hit`` = both members of a predicted pair share the group key.

    Two equi-joins of the pair table with the ``(id, key)`` table replace the
    materialised truth-pair list; rows without a key never match.
    """
    ki = keys.select(F.col(id_col).alias(i), F.col(key).alias("_ki"))
    kj = keys.select(F.col(id_col).alias(j), F.col(key).alias("_kj"))
    return (ranked_pairs.join(ki, i, "left").join(kj, j, "left")
            .withColumn("hit", F.when(F.col("_ki") == F.col("_kj"), 1).otherwise(0))
            .drop("_ki", "_kj"))


def remove_ids(df: DataFrame, issues: DataFrame, id_col: str = "id") -> DataFrame:
    """Drop rows whose id is an issue id (anti-join)."""
    return df.join(issues.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")


def missed(truth_ids: DataFrame, confirmed: DataFrame) -> DataFrame:
    """C11: true errors absent from the confirmed set, counted."""
    return (truth_ids.select("id").distinct().join(confirmed.select("id"), "id", "left_anti")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_missed")))


def rank_lookup(positions: DataFrame, ranking: DataFrame, pos_col: str = "rank") -> DataFrame:
    """Ids at given rank positions (``indices[positions]``)."""
    return positions.join(ranking, pos_col)
