"""Mix sources to target weights with a low-discrepancy schedule (DataFrame functions only).

1. **Targets.** Sources share the total size by weight; a target stops at
   ``cap`` times its source's size and the excess goes to the others by
   weight (water-filling, solved in closed form over sources ordered by cap
   per weight).
2. **Blocks.** Each source's documents are laid end to end in hash order and
   cut into equal blocks of its own, ``LEAST`` or more (one of each word, if
   it has fewer), none over ``ceil(total / slots)`` words. The place of a document is a
   distributed prefix sum: sums per (source, hash bucket), running sums over
   those, and a window inside a bucket, which holds a bounded share of the
   documents. A hot source is spread over all buckets.
3. **Schedule.** Slot ``i`` gets the golden-ratio point
   ``i * 2654435769 mod 2**32`` (a Weyl sequence in integers), and the source
   in whose stretch of the ring the point lies. A stretch is as long as the
   source's target in blocks, so sources of shorter blocks get more slots.
   Any run of slots is mixed near the weights. Slots are ranked per source, in chunks.
4. **Join.** The slot of rank ``r`` of a source takes its block ``r mod
   blocks``; a source's blocks are used at most ``cap`` times.

Words are counted in blocks: the error of a source's share is a few of its
own blocks, so a few in ``LEAST`` at most, whatever the size of the corpus.

Defined cases: a null text has size 0; documents of size 0 are returned and
never taken; sources without words have target 0. A null source is a source,
ordered last. Repeated rows count as documents of their own. An empty table
gives an empty result. Extra columns are ignored. Sources are ordered
by one window: one row per source, not per document, meets there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, Scratch

GOLDEN, RING = 2654435769, 1 << 32   # fixed values: 2**32 / golden ratio, and the ring of points
CELLS = 4096                          # cells of the ring by which points find their source
LEAST = 1024                          # blocks of a source, at least
PER_BUCKET = 512                      # documents or slots meant to meet in one bucket


@dataclass
class Mix:
    targets: DataFrame    # source, position, source_size, target, blocks
    fragments: DataFrame  # doc_id, source, size, at, block, words: pieces of documents in blocks
    schedule: DataFrame   # slot, source, block, round
    block_words: int      # words of a block, at most
    sized: DataFrame      # doc_id, source, size of every row


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(
        F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def water_fill(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``(position, source, source_size, target)``; targets add up to all sizes."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("position", F.row_number().over(order))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("position") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * cap)
    # by cap per weight: when the first k stop at their caps, the rest share what is left by weight
    fill = Window.orderBy(F.col("cap") / F.col("w"), "position")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_w = F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0))
    per = per.withColumn("level", left / open_w)
    # the level of the first source that its cap doesn't stop holds for it and all after
    free = F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level"))
    level = F.first(free, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0))
    return per.select("position", "source", "source_size", F.coalesce(
        F.least(F.col("cap").cast("double"), level * F.col("w")), F.col("cap").cast("double")).alias("target"))


def _prefix(df: DataFrame, by: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """Exclusive running sum of ``value`` per ``by``, through sums per bucket."""
    sums = df.groupBy(*by, bucket).agg(F.sum(value).alias("_s"))
    run = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.struct(*by, bucket).alias("_k"), F.coalesce(F.sum("_s").over(run), F.lit(0)).alias("_b"))
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("_i", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (d.join(sums, F.struct(*by, bucket).eqNullSafe(F.col("_k")))
            .withColumn(name, F.col("_b") + F.col("_i")).drop("_i", "_b", "_k"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, slots: int = 1 << 18,
        seed: int = 0) -> Mix:
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sized = scratch.write(sizes(docs), "sizes")
    total, n = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    words = max(1, -(-total // slots))
    blocks = F.greatest(F.ceil(F.col("source_size") / words), F.least("source_size", F.lit(LEAST)))
    targets = water_fill(sized, weights, cap).withColumn("blocks", blocks.cast("long"))
    targets = scratch.write(targets, "targets")
    turns = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    n_slots = targets.agg(F.ceil(F.coalesce(F.sum(turns), F.lit(0.0)))).first()[0]

    h = F.xxhash64(F.lit(seed), "doc_id", "size")
    buckets = max(1, n // PER_BUCKET)
    placed = _prefix(sized.where("size > 0").withColumn("h", h).withColumn("k", F.pmod("h", F.lit(buckets))),
                     ["source"], "k", ["h", "doc_id", "size"], F.col("size"), "at")
    cuts = targets.select(F.struct(F.col("source")).alias("c"), F.col("source_size").alias("s"),
                          F.col("blocks").alias("n"))
    piece = (placed.join(cuts, F.struct(F.col("source")).eqNullSafe(F.col("c")))
             .withColumn("block", F.explode(F.expr("sequence(at * n div s, (at + size - 1) * n div s)"))))
    # block b holds the words x with x * n div s = b
    inside = F.expr("least(at + size, ((block + 1) * s + n - 1) div n) - greatest(at, (block * s + n - 1) div n)")
    fragments = piece.select("doc_id", "source", "size", "at", "block", inside.alias("words"))

    # stretches of the ring, in integers, so that every engine cuts at the same points
    share = F.floor(turns / F.lit(float(max(n_slots, 1))) * F.lit(float(RING))).cast("long")
    run = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    ring = (targets.select("position", "source", "blocks", share.alias("share"))
            .withColumn("lo", F.coalesce(F.sum("share").over(run), F.lit(0))))
    ring = ring.withColumn("hi", F.col("lo") + F.col("share")).where("share > 0")
    width = RING // CELLS
    ring = ring.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    point = (F.col("slot") * GOLDEN) % RING
    slot = (spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("point", point)
            .withColumn("cell", F.floor(F.col("point") / width)))
    hit = (slot.join(ring, "cell").where("point >= lo and point < hi")
           .select("slot", "position", "source", "blocks").withColumn("k", F.floor(F.col("slot") / PER_BUCKET)))
    ranked = _prefix(hit, ["position"], "k", ["slot"], F.lit(1), "r")
    schedule = (ranked.withColumn("round", F.floor(F.col("r") / F.col("blocks"))).where(F.col("round") < cap)
                .select("slot", "source", (F.col("r") % F.col("blocks")).alias("block"), "round"))
    return Mix(targets, fragments, schedule, words, sized)


def taken(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs``."""
    m = mix(docs, **options)
    used = m.schedule.groupBy("source", "block").agg(F.count(F.lit(1)).alias("used"))
    used = used.select(F.struct("source", "block").alias("k"), "used")
    f = m.fragments.join(used, F.struct("source", "block").eqNullSafe(F.col("k")), "left")
    per = (f.groupBy("source", "at", "doc_id", "size")
           .agg(F.coalesce(F.sum(F.col("words") * F.col("used")), F.lit(0)).alias("taken")))
    none = m.sized.where("size = 0")
    rows = per.select("doc_id", "source", "size", "taken").unionByName(
        none.select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken")))
    t = m.targets.select(F.struct(F.col("source")).alias("k"), "source_size", "target")
    return (rows.join(t, F.struct(F.col("source")).eqNullSafe(F.col("k")))
            .select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")))
