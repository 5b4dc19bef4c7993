"""Human-vote operators.

Two vote layouts occur: the wide export (one row per audited item, one
nullable ``Yes``/``No`` column per annotator) and annotation sequences (one
vote per annotator and position). Wide tables are turned long with
``stack`` so that any number of annotators is one ``groupBy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import n_clean as n_clean_count
from tidemark.operators.contaminate import rank_within
from tidemark.operators.sequences import positions, running_max


def encode_vote(c) -> F.Column:
    """``Yes`` -> 1, anything else -> 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == F.lit("Yes"), F.lit(1)).otherwise(F.lit(0))


def to_long(wide: DataFrame, item: str, vote_cols: list[str]) -> DataFrame:
    """Wide votes -> ``(item, col_idx, vote)`` via ``stack`` (nulls dropped)."""
    pairs = ", ".join(f"{i}, `{c}`" for i, c in enumerate(vote_cols))
    return (wide.select(item, F.expr(f"stack({len(vote_cols)}, {pairs}) AS (col_idx, vote)"))
            .where(F.col("vote").isNotNull()))


def majority_vote(wide: DataFrame, item: str, vote_cols: list[str], out: str = "label") -> DataFrame:
    """Most frequent non-null vote per item; ties go to the value seen in the
    earliest column; null when nobody voted (kept by the left join)."""
    lv = to_long(wide, item, vote_cols)
    counts = lv.groupBy(item, "vote").agg(F.count(F.lit(1)).alias("_c"), F.min("col_idx").alias("_first"))
    best = counts.groupBy(item).agg(F.max_by("vote", F.struct(F.col("_c"), -F.col("_first"))).alias(out))
    return wide.join(best, item, "left")


def bias_strata(df: DataFrame, label: str = "label", limit: int = 50,
                stratum: str = "sampling_type", ranking: str = "Ranking", item: str = "item_id") -> DataFrame:
    """B9 + F6: voted rows of the maximum- and minimum-bias strata, first
    ``limit`` of each by ``Ranking`` (ties by item id). Adds ``pos`` 1..limit."""
    f = df.where(F.col(stratum).isin("maximum_bias", "minimum_bias") & F.col(label).isNotNull())
    r = rank_within(f, [stratum], [ranking, item], "pos")
    return r.where(F.col("pos") <= limit)


def error_percentages(strata: DataFrame, label: str = "label", stratum: str = "sampling_type",
                      half: int = 25) -> DataFrame:
    """D7 + E5: error % per stratum and for the first / second half of each stratum."""
    y = encode_vote(label)
    d = strata.withColumn("_y", y).withColumn(
        "half", F.when(F.col("pos") <= half, F.lit("first")).otherwise(F.lit("second")))
    whole = d.groupBy(stratum).agg(F.lit("all").alias("half"), F.round(F.avg("_y") * 100, 1).alias("error_pct"),
                                   F.count(F.lit(1)).alias("n"))
    halves = d.groupBy(stratum, "half").agg(F.round(F.avg("_y") * 100, 1).alias("error_pct"),
                                            F.count(F.lit(1)).alias("n"))
    return whole.unionByName(halves)


def rolling_errors(strata: DataFrame, by: list[str], label: str = "label", width: int = 11,
                   stratum: str = "sampling_type") -> DataFrame:
    """E3 + E4: max-bias rows followed by min-bias rows, rolling error % over
    ``width`` rows, full windows only; x = window centre starting at 5."""
    from pyspark.sql import Window

    y = encode_vote(label)
    seq = strata.withColumn("_y", y).withColumn(
        "_second", F.when(F.col(stratum) == "maximum_bias", 0).otherwise(1))
    # concatenated order: all max-bias rows then all min-bias rows (E4);
    # groups are (dataset, issue type) x 100 rows at most, so a window is bounded
    w = Window.partitionBy(*by).orderBy("_second", "pos")
    r = seq.withColumn("i", F.row_number().over(w))
    wr = w.rowsBetween(-(width - 1), 0)
    out = (r.withColumn("error_pct", F.avg("_y").over(wr) * 100)
           .where(F.col("i") >= width)
           .select(*by, (F.col("i") - (width - (width // 2)) + 0).cast("int").alias("center"), "error_pct"))
    return out


def annotator_sequences(events: DataFrame, issue_type: str = "error") -> DataFrame:
    """Vote sequences from an event table: annotator = user, order = (ts, event_id),
    vote 1 when the event is an issue. Output ``(annotator, pos, vote)``."""
    v = events.select(F.col("user_id").alias("annotator"), "ts", "event_id",
                      F.when(F.col("event_type") == issue_type, 1).otherwise(0).alias("vote"))
    return positions(v, ["annotator"], ["ts", "event_id"]).select("annotator", "pos", "vote")


def stop_votes(seq: DataFrame, p_plus: float = 0.05, p_chance: float = 0.05, n_clean: int | None = None,
               by: list[str] | None = None) -> DataFrame:
    """Stop each annotator at the first position where the items since the
    last issue (or the start) reach n_clean; later votes become null.

    streak(i) = i - last_issue(i) with last_issue = -1 before the first issue;
    missing votes count as non-issues. Without a stop every vote is kept.
    Adds ``stop_pos`` (null = never stopped) and ``kept_vote``.
    """
    by = list(by or ["annotator"])
    n = n_clean if n_clean is not None else n_clean_count(p_plus, p_chance)
    issue_at = F.when(F.col("vote") == 1, F.col("pos"))
    r = running_max(seq.withColumn("_ia", issue_at), by, "pos", "_ia", "_last")
    streak = F.col("pos") - F.coalesce(F.col("_last"), F.lit(-1))
    stops = (r.where(streak >= n).groupBy(*by).agg(F.min("pos").alias("stop_pos")))
    return (r.join(stops, by, "left")
            .withColumn("kept_vote", F.when(F.col("stop_pos").isNull() | (F.col("pos") <= F.col("stop_pos")),
                                            F.col("vote")))
            .drop("_ia", "_last"))


def unanimous(votes: DataFrame, item: list[str], annotator: str, vote: str, n_annotators: DataFrame | int) -> DataFrame:
    """The common vote when every annotator voted the same, else 0 (a
    missing vote makes the item non-unanimous)."""
    agg = votes.groupBy(*item).agg(F.count(vote).alias("_nv"), F.min(vote).alias("_lo"), F.max(vote).alias("_hi"))
    if isinstance(n_annotators, int):
        agg = agg.withColumn("_na", F.lit(n_annotators))
    else:
        agg = agg.join(n_annotators, [c for c in n_annotators.columns if c != "_na"])
    return agg.select(*item, F.when((F.col("_nv") == F.col("_na")) & (F.col("_lo") == F.col("_hi")),
                                    F.col("_lo")).otherwise(F.lit(0)).alias("all_equal_vote"))
