"""Contaminations: plant known errors and keep the truth.

Every operator is ``DataFrame -> (contaminated DataFrame, truth DataFrame)``.
The relational part (which rows, which new ids, which unions) is the
operator; the perturbation is a pluggable ``Column -> Column`` function
(U3). All randomness is the seeded md5 hash, so a contamination is the same
on any cluster layout and can be replayed in SQL.

Sampling m rows = the m smallest ``(md5(seed:salt:id), id)``; the position in
that order (from :func:`global_rank`, no single-partition window) gives the
new ids ``n, n + 1, ...``. Counts (n, m, number of classes) are one-row
aggregates joined in, so the whole plan stays lazy apart from the rank
checkpoint.

Truth tables have the schema ``(issue_type string, id bigint, id2 bigint)``.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_key, uniform
from tidemark.functions.scalars import chained_fraction_py
from tidemark.functions.vectors import l2_normalize, per_row
from tidemark.operators.ranking import freeze, global_rank

NEAR_DUP, OFF_TOPIC, LABEL_ERR = "near_duplicate", "off_topic", "label_error"
TRUTH_SCHEMA = "issue_type string, id bigint, id2 bigint"

Perturb = Callable[[Column, Column], Column]   # (payload, id) -> payload


# --------------------------------------------------------------------------- #
# perturbations (U3): (payload column, id column) -> payload column
# --------------------------------------------------------------------------- #

def vector_noise(seed: int = 42, scale: float = 0.05, salt: str = "k1") -> Perturb:
    """Vector K1: add uniform hash noise of width ``scale`` per dimension, renormalise."""
    def f(v: Column, rid: Column) -> Column:
        noisy = F.transform(v, lambda x, i: x + F.lit(scale) * (
            F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt),
                                                 rid.cast("string"), i.cast("string"))), 1, 8),
                   16, 10).cast("double") / F.lit(4294967296.0) - F.lit(0.5)))
        return l2_normalize(noisy)
    return f


def vector_destroy(levels: float = 2.0, width: int = 2) -> Perturb:
    """Vector K3: moving average over +-``width`` dims, coarse quantisation
    (``levels`` steps per unit of the smoothed vector's RMS), renormalise."""
    def f(v: Column, rid: Column) -> Column:
        n = F.size(v)

        def smooth_at(x, i):
            lo = F.greatest(i - width, F.lit(0))
            hi = F.least(i + width, n - 1)
            win = F.slice(v, lo + 1, hi - lo + 1)
            return F.aggregate(win, F.lit(0.0), lambda acc, y: acc + y) / (hi - lo + 1)

        sm = F.transform(v, smooth_at)
        rms = F.sqrt(F.aggregate(sm, F.lit(0.0), lambda acc, y: acc + y * y) / n)
        quant = per_row(sm, rms, lambda x, r: F.coalesce(
            F.round(F.try_divide(x, r) * F.lit(levels)) / F.lit(levels), F.lit(0.0)))
        return l2_normalize(quant)
    return f


def text_crop(seed: int = 42, salt: str = "k1") -> Perturb:
    """Text K1: keep a contiguous 50-90 % span; pad with spaces with p = .5."""
    def f(t: Column, rid: Column) -> Column:
        n = F.length(t)
        keep = F.greatest(F.floor(n * (F.lit(0.5) + F.lit(0.4) * uniform(seed, salt + ":len", rid))),
                          F.lit(1)).cast("int")
        start = F.floor((n - keep) * uniform(seed, salt + ":start", rid)).cast("int")
        span = F.substring(t, start + 1, keep)
        return F.when(uniform(seed, salt + ":pad", rid) < 0.5,
                      F.concat(F.lit("  "), span, F.lit("  "))).otherwise(span)
    return f


def text_mask() -> Perturb:
    """Text K3: destroy content by masking letters and digits."""
    def f(t: Column, rid: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(t, r"\p{L}", "x"), r"\p{N}", "0")
    return f


# --------------------------------------------------------------------------- #
# helpers
# --------------------------------------------------------------------------- #

def _count(df: DataFrame, name: str = "_n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("bigint").alias(name))


def sample_rows(df: DataFrame, seed: int, salt: str, frac: float | None = None,
                n_errors: int | None = None, id_col: str = "id") -> DataFrame:
    """The ``ceil(frac * n)`` (or ``n_errors``) rows first in seeded hash order.

    Adds ``_hrank`` (1..m), the position in hash order. Only (hash, id) is
    sorted and written; the rows of the chosen ids are joined afterwards. The
    chosen rows are those up to the last chosen (hash, id), so the others are
    left out where they are read and their payload isn't shuffled.
    """
    keyed = df.select(id_col, hash_key(seed, salt, id_col).alias("_hkey"))
    ranked = global_rank(keyed, ["_hkey", id_col], "_hrank")
    if n_errors is not None:
        chosen = ranked.where(F.col("_hrank") <= F.lit(int(n_errors)))
    else:
        m = _count(df).select(F.ceil(F.col("_n") * F.lit(float(frac))).cast("bigint").alias("_m"))
        chosen = ranked.crossJoin(m).where(F.col("_hrank") <= F.col("_m")).drop("_m")
    last = chosen.agg(F.max(F.struct("_hkey", id_col)).alias("_last"))   # one row
    upto = F.struct(hash_key(seed, salt, id_col).alias("_hkey"), F.col(id_col).alias(id_col)) <= F.col("_last")
    near = df.crossJoin(F.broadcast(last)).where(upto).drop("_last").repartition(id_col)
    return near.join(chosen.drop("_hkey"), id_col).select(*df.columns, "_hrank")


def _next_id(df: DataFrame, name: str = "_n") -> DataFrame:
    """One row: the first free id (max id + 1; equals n for dense ids)."""
    return df.agg(F.coalesce(F.max("id") + 1, F.lit(0)).cast("bigint").alias(name))


def _append_ids(df: DataFrame, sampled: DataFrame, id_col: str = "id") -> DataFrame:
    """New ids ``n + _hrank - 1`` (G1) where n is the first free id of the base."""
    return sampled.crossJoin(_next_id(df)).withColumn(
        "_new_id", (F.col("_n") + F.col("_hrank") - 1).cast("bigint")).drop("_n")


def _truth(df: DataFrame, issue: str, id_c: str, id2_c: str | None) -> DataFrame:
    return df.select(F.lit(issue).alias("issue_type"), F.col(id_c).cast("bigint").alias("id"),
                     (F.col(id2_c).cast("bigint") if id2_c else F.lit(None).cast("bigint")).alias("id2"))


def dense_reindex(df: DataFrame, order=("id",), id_col: str = "id") -> DataFrame:
    """Replace ids by dense positions 0..n-1 in ``order`` (``reset_index``)."""
    ranked = global_rank(df, list(order), "_pos")
    return ranked.withColumn(id_col, (F.col("_pos") - 1).cast("bigint")).drop("_pos")


def rank_within(df: DataFrame, by: list[str], order: list, rank_col: str) -> DataFrame:
    """1-based position inside each ``by`` group, skew-safe.

    A ``row_number`` window partitioned by a hot key would put a third of
    the table in one task; instead rank globally on ``by + order`` and
    subtract the group's first position (one row per group).
    """
    g = global_rank(df, [*by, *order], "_gpos")
    first = g.groupBy(*by).agg(F.min("_gpos").alias("_g0"))
    # one row per group; AQE broadcasts it when its runtime size is small
    return (g.join(first, by)
            .withColumn(rank_col, (F.col("_gpos") - F.col("_g0") + 1).cast("bigint"))
            .drop("_gpos", "_g0"))


# --------------------------------------------------------------------------- #
# K1 / K2: near-duplicates appended as new rows (G1)
# --------------------------------------------------------------------------- #

def near_duplicates(df: DataFrame, frac: float = 0.1, seed: int = 42, perturb: Perturb | None = None,
                    payload: str = "embedding", n_errors: int | None = None,
                    salt: str = "k1") -> tuple[DataFrame, DataFrame]:
    """K1: append one perturbed copy of ``ceil(frac n)`` sampled rows.

    Truth: ``(near_duplicate, original id, new id)``.
    """
    perturb = perturb or vector_noise(seed)
    s = _append_ids(df, sample_rows(df, seed, salt, frac, n_errors))
    # compute the payload before the id column is replaced: a lambda would
    # otherwise resolve ``id`` to the new alias
    s = s.withColumn("_payload", perturb(F.col(payload), F.col("id")))
    copies = s.select(*[
        (F.col("_new_id").alias(c) if c == "id"
         else F.col("_payload").alias(c) if c == payload
         else F.col(c)) for c in df.columns])
    out = df.unionByName(copies)
    return out, _truth(s, NEAR_DUP, "id", "_new_id")


WATERMARK_TEXT = "CONFIDENTIAL"


def artefacts(df: DataFrame, frac: float = 0.1, seed: int = 42, payload: str = "text",
              p_watermark: float = 0.5, p_bar: float = 0.5, p_mosaic: float = 0.5,
              text: str = WATERMARK_TEXT, mosaic_scale: float = 0.5, grayscale: bool = False,
              n_errors: int | None = None) -> tuple[DataFrame, DataFrame]:
    """K2 (text form): watermark, colour bar and mosaic steps, each with its own p.

    * watermark: insert ``text`` at a hashed character position,
    * colour bar: append a constant strip,
    * mosaic: append the first ``mosaic_scale`` share of a hashed partner row
      (joined by its hash rank, an equi-join - no broadcast of the table),
    * grayscale: lower-case.
    """
    salt = "k2"
    s = _append_ids(df, sample_rows(df, seed, salt, frac, n_errors))
    # partner row for the mosaic: the row whose hash position equals a hashed
    # position of the sampled row (dense positions 1..n from the same rank).
    pos = global_rank(df.select("id", F.col(payload).alias("_ptext"))
                      .withColumn("_pk", hash_key(seed, salt + ":partner", "id")),
                      ["_pk", "id"], "_ppos").select("_ppos", "_ptext")
    n_df = _count(df)
    s = (s.crossJoin(n_df)
         .withColumn("_ppos", (F.floor(uniform(seed, salt + ":pick", "id") * F.col("_n")) + 1).cast("bigint"))
         .join(pos, "_ppos", "left").drop("_n"))
    t = F.col(payload)
    wm_at = F.floor(F.length(t) * uniform(seed, salt + ":wpos", "id")).cast("int")
    t = F.when(uniform(seed, salt + ":wm", "id") < p_watermark,
               F.concat(F.substring(t, F.lit(1), wm_at), F.lit(f" {text} "),
                        F.substring(t, wm_at + 1, F.length(t) + 1))
               ).otherwise(t)
    t = F.when(uniform(seed, salt + ":bar", "id") < p_bar, F.concat(t, F.lit(" ||||||||"))).otherwise(t)
    half = F.substring(F.col("_ptext"), 1, F.floor(F.length(F.col("_ptext")) * F.lit(mosaic_scale)).cast("int"))
    t = F.when(uniform(seed, salt + ":mosaic", "id") < p_mosaic,
               F.concat(t, F.lit(" "), F.coalesce(half, F.lit("")))).otherwise(t)
    if grayscale:
        t = F.lower(t)
    s = s.withColumn("_payload", t)
    copies = s.select(*[
        (F.col("_new_id").alias(c) if c == "id" else F.col("_payload").alias(c) if c == payload
         else F.col(c)) for c in df.columns])
    return df.unionByName(copies), _truth(s, NEAR_DUP, "id", "_new_id")


# --------------------------------------------------------------------------- #
# K3 / K4: off-topic rows
# --------------------------------------------------------------------------- #

def destroy(df: DataFrame, frac: float = 0.1, seed: int = 42, perturb: Perturb | None = None,
            payload: str = "embedding", label_col: str = "label",
            n_errors: int | None = None) -> tuple[DataFrame, DataFrame]:
    """K3 (G2): replace sampled rows by destroyed copies under a new class.

    The originals are removed (anti-join), the copies get ids ``n, n+1, ..``
    and label = number of classes (the new "off-topic" class).
    """
    perturb = perturb or vector_destroy()
    salt = "k3"
    s = _append_ids(df, sample_rows(df, seed, salt, frac, n_errors))
    n_cls = df.agg((F.max(label_col) + 1).cast("int").alias("_ncls"))
    s = s.withColumn("_payload", perturb(F.col(payload), F.col("id")))
    copies = s.crossJoin(n_cls).select(*[
        (F.col("_new_id").alias(c) if c == "id"
         else F.col("_payload").alias(c) if c == payload
         else F.col("_ncls").alias(c) if c == label_col
         else F.col(c)) for c in df.columns])
    kept = df.join(s.select("id"), "id", "left_anti")
    truth = _truth(s, OFF_TOPIC, "_new_id", None)
    return kept.unionByName(copies), truth


def foreign(df: DataFrame, sources: list[DataFrame], frac: float = 0.1, seed: int = 42,
            label_col: str = "label", n_errors: int | None = None) -> tuple[DataFrame, DataFrame]:
    """K4 (G3/G4): append ``ceil(frac n)`` rows sampled from foreign tables.

    With several sources each gives an equal share ``floor(m / #sources)``;
    labels are offset by the running class count so foreign classes never
    collide with the base ones. Sources must have the base's columns.
    """
    n_df = _next_id(df)
    m_total = _count(df).select((F.lit(int(n_errors)) if n_errors is not None
                           else F.ceil(F.col("_n") * F.lit(float(frac)))).cast("bigint").alias("_m"))
    base_classes = df.agg((F.max(label_col) + 1).cast("int").alias("_off0"))
    parts = []
    offset_cols = base_classes
    start = F.lit(0).cast("bigint")
    k = len(sources)
    running_off = None
    prev_share = None
    for idx, src in enumerate(sources):
        share = m_total.select((F.floor(F.col("_m") / F.lit(k)) if k > 1 else F.col("_m")).cast("bigint").alias("_share"))
        ranked = global_rank(src.withColumn("_hkey", hash_key(seed, f"k4:{idx}", "id")),
                             ["_hkey", "id"], "_hrank")
        src_classes = src.agg((F.max(label_col) + 1).cast("int").alias(f"_c{idx}"))
        picked = (ranked.crossJoin(share).where(F.col("_hrank") <= F.col("_share"))
                  .crossJoin(n_df).crossJoin(base_classes))
        # id offset: previous sources' shares; class offset: base + previous sources' classes
        picked = picked.withColumn("_slot", F.col("_hrank") + F.lit(idx) * F.col("_share"))
        if running_off is not None:
            picked = picked.crossJoin(running_off)
            cls_off = F.col("_off0") + F.col("_prev_cls")
        else:
            cls_off = F.col("_off0")
        picked = picked.select(*[
            ((F.col("_n") + F.col("_slot") - 1).cast("bigint").alias(c) if c == "id"
             else (F.col(label_col) + cls_off).cast("int").alias(c) if c == label_col
             else F.col(c)) for c in df.columns], F.col("id").alias("_src_id"))
        parts.append(picked)
        running_off = (src_classes.withColumnRenamed(f"_c{idx}", "_prev_cls") if running_off is None
                       else running_off.crossJoin(src_classes)
                       .select((F.col("_prev_cls") + F.col(f"_c{idx}")).alias("_prev_cls")))
    added = reduce(lambda a, b: a.unionByName(b), parts)
    truth = _truth(added, OFF_TOPIC, "id", None)
    return df.unionByName(added.drop("_src_id")), truth


# --------------------------------------------------------------------------- #
# K5 / K6: label errors
# --------------------------------------------------------------------------- #

def _relabel(sampled: DataFrame, seed: int, n_cls: DataFrame, label_col: str, salt: str) -> DataFrame:
    """New label uniform over the other classes: (y + 1 + floor(u (C - 1))) mod C."""
    step = F.floor(uniform(seed, salt + ":new", "id") * (F.col("_ncls") - 1)).cast("int")
    return sampled.crossJoin(n_cls).withColumn(
        "_new_label", F.pmod(F.col(label_col) + 1 + step, F.col("_ncls")).cast("int"))


def label_errors(df: DataFrame, frac: float = 0.1, seed: int = 42, per_class: bool = False,
                 label_col: str = "label", n_errors: int | None = None,
                 candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """K5 (uniform) / K6 (per class): flip labels of sampled rows to another class.

    ``candidates`` restricts the sample to given ids (K7 samples originals only);
    the fraction still refers to the candidate count.
    """
    salt = "k6" if per_class else "k5"
    pool = df if candidates is None else df.join(candidates.select("id"), "id", "left_semi")
    n_cls = df.agg((F.max(label_col) + 1).cast("int").alias("_ncls"))
    if per_class:
        keyed = pool.withColumn("_hkey", hash_key(seed, salt, "id"))
        ranked = rank_within(keyed, [label_col], ["_hkey", "id"], "_crank")
        sizes = pool.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))
        quota = (F.lit(int(n_errors)) if n_errors is not None
                 else F.ceil(F.col("_nc") * F.lit(float(frac))))
        sampled = (ranked.join(F.broadcast(sizes), label_col)
                   .where(F.col("_crank") <= quota).drop("_hkey", "_crank", "_nc"))
    else:
        sampled = sample_rows(pool, seed, salt, frac, n_errors).drop("_hrank")
    flipped = _relabel(sampled.select("id", label_col), seed, n_cls, label_col, salt)
    changes = flipped.select("id", "_new_label")
    out = (df.join(changes, "id", "left")
           .withColumn(label_col, F.coalesce(F.col("_new_label"), F.col(label_col)))
           .select(*df.columns))
    return out, _truth(changes, LABEL_ERR, "id", None)


# --------------------------------------------------------------------------- #
# K7: mixed contamination
# --------------------------------------------------------------------------- #

def mixed(df: DataFrame, frac: float = 0.1, seed: int = 42, off_topic: str = "destroy",
          foreign_sources: list[DataFrame] | None = None, dup_perturb: Perturb | None = None,
          payload: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """K7: off-topic -> near-duplicate -> label error, each at the chained
    fraction (1 + f)^(1/3) - 1; label errors sample original ids only.
    Truth tables of the three stages are unioned, tagged by ``issue_type``."""
    f = chained_fraction_py(frac)
    if off_topic == "foreign":
        s1, t1 = foreign(df, foreign_sources or [], f, seed)
    else:
        s1, t1 = destroy(df, f, seed, payload=payload)
    # each stage samples by a global rank of the previous stage's output:
    # materialise between stages so no stage replays the ones before it
    s1 = freeze(s1)
    s2, t2 = near_duplicates(s1, f, seed, perturb=dup_perturb, payload=payload)
    s2 = freeze(s2)
    originals = df.select("id").join(t1.select("id"), "id", "left_anti")
    s3, t3 = label_errors(s2, f, seed, candidates=originals)
    # three chained stages: materialise the result once so audits that read
    # it several times never replay the chain
    return freeze(s3), freeze(t1.unionByName(t2).unionByName(t3))


def contaminate(df: DataFrame, kind: str, frac: float = 0.1, seed: int = 42,
                n_errors: int | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """Contamination by name."""
    kinds = {
        "augment": near_duplicates, "artefact": artefacts, "blur": destroy,
        "combined": foreign, "label_error": label_errors, "mixed": mixed,
    }
    if kind not in kinds:
        raise ValueError(f"unknown contamination {kind!r}; one of {sorted(kinds)}")
    if kind == "combined":
        return foreign(df, kw.pop("sources"), frac, seed, n_errors=n_errors, **kw)
    if kind == "mixed":
        return mixed(df, frac, seed, **kw)
    return kinds[kind](df, frac=frac, seed=seed, n_errors=n_errors, **kw)


def contamination_info(contaminated: DataFrame, truth: DataFrame, n_original: DataFrame) -> DataFrame:
    """Original, added, combined counts and truth rows per issue type."""
    by_issue = truth.groupBy("issue_type").agg(F.count(F.lit(1)).cast("bigint").alias("n_truth"))
    return (by_issue.crossJoin(n_original.select(F.col("_n").alias("n_original")))
            .crossJoin(_count(contaminated).select(F.col("_n").alias("n_combined")))
            .withColumn("n_added", F.col("n_combined") - F.col("n_original")))
