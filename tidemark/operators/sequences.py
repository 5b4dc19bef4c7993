"""Skew-safe sequence primitives: positions, running maxima and average ranks.

A window ``partitionBy(key).orderBy(pos)`` sorts a whole key in one task; if
one annotator or one group holds a third of the table, that task holds a
third of the table. These helpers express the same results with global
range-partitioned ranks and bounded segments:

* :func:`positions` - 0-based position inside the key (global rank minus
  the key's first position),
* :func:`running_max` - prefix maximum along the position, as a segmented
  scan: per-segment maxima (a small table) give the carry-in, the window
  inside a segment is bounded by ``segment`` rows,
* :func:`average_rank` - ``rankdata`` (ties get the mean rank) per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.contaminate import rank_within
from tidemark.operators.ranking import global_rank


def positions(df: DataFrame, by: list[str], order: list, pos_col: str = "pos") -> DataFrame:
    """0-based position inside each ``by`` group in ``order`` (a total order)."""
    return rank_within(df, by, order, "_r1").withColumn(pos_col, (F.col("_r1") - 1).cast("bigint")).drop("_r1")


def running_max(df: DataFrame, by: list[str], pos: str, value: str, out: str,
                segment: int = 4096) -> DataFrame:
    """Prefix max of ``value`` over rows with position <= own position, per ``by``."""
    seg = F.floor(F.col(pos) / F.lit(segment)).cast("bigint")
    d = df.withColumn("_seg", seg)
    seg_max = d.groupBy(*by, "_seg").agg(F.max(value).alias("_smax"))
    # carry-in: max over earlier segments (one row per segment per key)
    wc = Window.partitionBy(*by).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = seg_max.withColumn("_carry", F.max("_smax").over(wc)).drop("_smax")
    wi = Window.partitionBy(*by, "_seg").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    inner = d.withColumn("_inner", F.max(value).over(wi))
    return (inner.join(carry, [*by, "_seg"], "left")
            .withColumn(out, F.greatest(F.col("_inner"), F.col("_carry")))
            .drop("_seg", "_inner", "_carry"))


def average_rank(df: DataFrame, value: str, out: str = "avg_rank", by: list[str] | None = None,
                 id_col: str = "id") -> DataFrame:
    """1-based rank of ``value`` inside ``by`` with ties averaged (``rankdata``)."""
    by = list(by or [])
    g = global_rank(df, [*by, value, id_col], "_gp")
    first = g.groupBy(*by).agg(F.min("_gp").alias("_g0")) if by else g.agg(F.min("_gp").alias("_g0"))
    ties = g.groupBy(*by, value).agg(F.min("_gp").alias("_t0"), F.max("_gp").alias("_t1"))
    j = g.join(ties, [*by, value])
    j = j.join(first, by) if by else j.crossJoin(first)
    return (j.withColumn(out, (F.col("_t0") + F.col("_t1")) / F.lit(2.0) - F.col("_g0") + F.lit(1.0))
            .drop("_gp", "_g0", "_t0", "_t1"))
