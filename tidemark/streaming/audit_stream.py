"""Incremental audit of arriving vectors with Structured Streaming.

Each micro-batch meets the rows that came before through a persisted index,
and nothing that is known already is computed again:

* ``state`` holds every row, in a folder per batch and cell. A cell is the
  nearest of at most ``CELLS`` pivots, chosen by hash from the first batch
  that has rows and kept for good.
* ``cells`` holds a row per batch and cell: how many rows, the nearest and the
  farthest from the pivot, and how far the farthest of their nearest
  neighbours was when they came (``reach``). Nearest neighbours only come
  closer, so ``reach`` stays a bound.
* ``near`` holds what each batch changed: the nearest same-label and
  other-label distances of its own rows, and of older rows that it brought
  closer. A row's distances are the minima over the batches.

A new row visits a cell only if some row of it may be within ``max_dist``,
nearer than the row's nearest inside its own batch, or have the new row nearer
than ``reach`` (triangle inequality on the distance to the pivot). Only the
visited cells' folders are read. Results are exact: pairs equal ``all_pairs``
with ``max_dist``, distances equal ``nearest_by_label``, over all rows so far.
On clustered rows a batch's cost depends on the cells that it touches; rows
without clusters, or a wide ``max_dist``, leave every cell open, and then a
batch is compared with all rows.

Outputs under ``out_dir``: ``pairs`` (near-duplicates found by each batch),
``labels`` (J1c scores of the batch's rows when it came), ``counts`` (rows so
far, rows compared with and rows of visited cells). :func:`label_scores`
reads the scores of all rows up to a batch, :func:`running_metrics` the
ranking metrics against planted truth after each batch.

``foreachBatch`` makes every write idempotent by ``batch_id``: a replayed
batch overwrites its own folders and reads only other batches' ones.

Defined cases: rows with a null id or vector take no part; a null label is a
label of its own; rows that repeat an id are no pair and no neighbours; an
empty batch writes its counts only.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.vectors import l2_normalize
from tidemark.operators.pairs import _blocks, _by_cell, _layout, _pairwise, _unpack, all_pairs, cross_cells, nearest_by_label
from tidemark.operators.pruned_knn import _space, _straight
from tidemark.operators.ranking import freeze, global_rank
from tidemark.session import ensure_checkpoint_dir, path_exists

EMB_SCHEMA = "vec_id bigint, embedding array<float>, label int"
STATE_SCHEMA = "id bigint, embedding array<double>, label int, far double, d_same double, d_other double, batch_id bigint, cell int"
CELL_SCHEMA = "cell int, n bigint, lo double, hi double, reach double, batch_id bigint"
NEAR_SCHEMA = "id bigint, d_same double, d_other double, batch_id bigint"
COUNT_SCHEMA = "n_rows bigint, n_compared bigint, n_visited bigint, batch_id bigint"
CELLS = 256
BLOCK = 1024          # rows of a block of a cell, and new rows that travel to a cell together
HELD = 200_000        # results a task holds before it sends them on
METRIC = "half_cosine"
SLACK = 1e-6          # floating-point error of distances by inner products
NO_LABEL = -(1 << 31)


def _write_part(df: DataFrame, path: str, batch_id: int, *more: str) -> None:
    # the whole folder of a batch is replaced, also where a replay writes fewer cells
    out = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (out.partitionBy(*more) if more else out).parquet(f"{path}/batch_id={int(batch_id)}")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # only a missing folder means "nothing yet"; any other failure is an error
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def _pivots(spark: SparkSession, new: DataFrame, path: str) -> np.ndarray:
    """At most CELLS vectors, chosen once; few of them in small first batches."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        n = new.count()
        if not n:
            return np.empty((0, 0))
        (new.orderBy(F.xxhash64("id"), "id").limit(max(1, min(CELLS, int(4 * n ** 0.5)))).select("id", "embedding")
         .coalesce(1).write.mode("overwrite").parquet(path))
    rows = spark.read.parquet(path).orderBy(F.xxhash64("id"), "id").select("embedding").toPandas()["embedding"]
    return np.stack(rows.to_numpy())


def _open(far: np.ndarray, bound: np.ndarray, c, max_dist: float) -> np.ndarray:
    """The new rows that a cell may concern, from their distances to its pivot."""
    limit = np.maximum(bound, _straight(np.array([max(max_dist, c.reach)]), METRIC)[0])
    return np.flatnonzero(np.maximum(far - c.hi, c.lo - far) <= limit + SLACK)


def _bound(d_same, d_other) -> np.ndarray:
    """Straight distance within which a new row may find a nearer one than in its own batch."""
    own = np.stack([np.asarray(d_same, float), np.asarray(d_other, float)], axis=1)
    return np.where(np.isnan(own).any(1), np.inf, _straight(own.max(1), METRIC))


def _meet(frames, shared, max_dist: float):
    """A side of new rows, with the side's blocks of visited cells streamed past it: close pairs, and nearest
    distances of both sides. A new row meets only the cells that may concern it."""
    pivots, cells = shared.value
    table = {c.cell: c for c in cells.itertuples(index=False)}
    held, compared, out = 0, 0, []

    def sent():
        got = pd.concat(out).reindex(columns=["kind", "i", "j", "dist", "d_same", "d_other", "compared"]).replace(np.inf, np.nan)
        out.clear()
        return got.astype({"i": "Int64", "j": "Int64", "compared": "Int64"})

    for _, rows in _by_cell(frames):
        new, far_of, far = [], None, None
        for r in rows:
            if r.role == 0:
                new.append((*_unpack(r), np.asarray(r.x_label, np.int32), _bound(r.x_d_same, r.x_d_other)))
                continue
            if not new:
                break
            if far_of is None:
                ids, vecs, labels, bound = (np.concatenate([n[i] for n in new]) for i in range(4))
                new = [None]   # the rows now lie in one array
                points, best = _space(vecs, METRIC), np.full((2, len(ids)), np.inf)
            if r.of_cell != far_of:   # blocks come in the order of their cells
                far_of = int(r.of_cell)
                far = _pairwise(points, _space(pivots[[far_of]], METRIC), "l2")[:, 0]
            ib, vb = _unpack(r)
            lb, was = np.asarray(r.x_label, np.int32), (np.asarray(r.x_d_same, float), np.asarray(r.x_d_other, float))
            least = np.full((2, len(ib)), np.inf)
            go = _open(far, bound, table[far_of], max_dist)
            for a in range(0, len(go), BLOCK):
                at = go[a : a + BLOCK]
                d = _pairwise(vecs[at], vb, METRIC)
                same, other_id = labels[at][:, None] == lb[None], ids[at][:, None] != ib[None]
                x, y = np.nonzero((d <= max_dist) & other_id)
                if len(x):
                    gi, gj = ids[at][x], ib[y]
                    out.append(pd.DataFrame({"i": np.minimum(gi, gj), "j": np.maximum(gi, gj), "dist": d[x, y], "kind": "pair"}))
                    held += len(x)
                for i, m in enumerate((np.where(same & other_id, d, np.inf), np.where(~same & other_id, d, np.inf))):
                    best[i, at] = np.minimum(best[i, at], m.min(1))
                    least[i] = np.minimum(least[i], m.min(0))
                compared += d.size
            closer = (least[0] < was[0]) | (least[1] < was[1])
            if closer.any():
                out.append(pd.DataFrame({"i": ib[closer], "d_same": least[0][closer], "d_other": least[1][closer], "kind": "near"}))
                held += int(closer.sum())
            if held >= HELD:
                yield sent()
                held = 0
        if far_of is not None:
            out.append(pd.DataFrame({"i": ids, "d_same": best[0], "d_other": best[1], "kind": "near"}))
            yield sent()
            held = 0
    yield pd.DataFrame({"kind": ["work"], "compared": [compared]}).reindex(
        columns=["kind", "i", "j", "dist", "d_same", "d_other", "compared"]).astype({"i": "Int64", "j": "Int64"})


def process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, out_dir: str,
                  max_dist: float = 0.3) -> None:
    """Audit one micro-batch against the stored rows (idempotent per ``batch_id``)."""
    earlier = F.col("batch_id") != batch_id   # a replay doesn't meet its own first attempt
    new = freeze(batch.where("vec_id is not null and embedding is not null").select(
        F.col("vec_id").alias("id"), l2_normalize("embedding").alias("embedding"),
        F.coalesce(F.col("label").cast("int"), F.lit(NO_LABEL)).alias("label")))
    pivots = _pivots(spark, new, f"{out_dir}/pivots")
    if not len(pivots) or not new.take(1):
        done = _read(spark, f"{out_dir}/cells", CELL_SCHEMA).where(earlier).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
        _write_part(done.select("n_rows", F.lit(0).cast("long").alias("n_compared"), F.lit(0).cast("long").alias("n_visited")),
                    f"{out_dir}/counts", batch_id)
        return
    # at most CELLS rows
    cells = (_read(spark, f"{out_dir}/cells", CELL_SCHEMA).where(earlier).groupBy("cell").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("reach").alias("reach")).toPandas())
    inner = new.join(nearest_by_label(new), "id", "left").select(
        "id", "embedding", "label", F.nanvl("d_same", F.lit(None)).alias("d_same"), F.nanvl("d_other", F.lit(None)).alias("d_other"))
    shared = spark.sparkContext.broadcast((pivots, cells))   # bounded by CELLS

    def visits(frames):
        p, table = shared.value
        for pdf in frames:
            if len(pdf):
                d = _pairwise(_space(np.stack(pdf["embedding"].to_numpy()).astype(float), METRIC), _space(p, METRIC), "l2")
                bound = _bound(pdf["d_same"], pdf["d_other"])
                yield pd.DataFrame({"cell": [c.cell for c in table.itertuples(index=False)
                                             if len(_open(d[:, c.cell], bound, c, max_dist))]}, dtype="int32")

    inner = freeze(inner)
    visited = sorted(r["cell"] for r in inner.mapInPandas(visits, "cell int").distinct().collect())   # at most CELLS
    n_rows = {int(c): int(n) for c, n in zip(cells["cell"], cells["n"]) if c in set(visited)}
    n_visited = sum(n_rows.values())
    old = _read(spark, f"{out_dir}/state", STATE_SCHEMA).where(earlier & F.col("cell").isin(visited))
    # a cell's rows in blocks, numbered in the order of the cells; both sides travel once to each cell of the grid
    subs, first = [], 0
    for c in visited:
        subs.append((int(c), -(-n_rows[c] // BLOCK), first))
        first += subs[-1][1]
    none = F.lit(float("inf"))
    places = spark.createDataFrame(subs, "cell int, subs int, first int")
    row = F.struct("id", "embedding", "label", F.coalesce("d_same", none).alias("d_same"), F.coalesce("d_other", none).alias("d_other"))
    blocks = (old.join(F.broadcast(places), "cell")
              .groupBy(F.col("cell").alias("of_cell"), (F.col("first") + F.pmod(F.xxhash64("id"), F.col("subs"))).cast("int").alias("blk"))
              .agg(F.collect_list(row).alias("_r"))
              .select("blk", F.col("_r.id").alias("ids"), F.flatten("_r.embedding").alias("vecs"),
                      *[F.col(f"_r.{c}").alias(f"x_{c}") for c in ("label", "d_same", "d_other")], "of_cell"))
    nb, new_sides = _layout(inner, BLOCK)
    _, old_sides = _layout(inner, BLOCK, n=n_visited)
    asked = _blocks(inner, "id", "embedding", nb, ["label", "d_same", "d_other"]).withColumn("of_cell", F.lit(None).cast("int"))
    met = freeze(cross_cells(asked, blocks, new_sides, old_sides).mapInPandas(
        lambda frames: _meet(frames, shared, max_dist),
        "kind string, i long, j long, dist double, d_same double, d_other double, compared long"))

    pairs = all_pairs(new, max_dist=max_dist).unionByName(met.where("kind = 'pair'").select("i", "j", "dist"))
    _write_part(pairs, f"{out_dir}/pairs", batch_id)
    clean = lambda c: F.nanvl(F.col(c), F.lit(None)).alias(c)
    changed = freeze(inner.select("id", "d_same", "d_other").unionByName(
        met.where("kind = 'near'").select(F.col("i").alias("id"), clean("d_same"), clean("d_other")))
        .groupBy("id").agg(F.min("d_same").alias("d_same"), F.min("d_other").alias("d_other")))
    _write_part(changed, f"{out_dir}/near", batch_id)
    mine = changed.join(new.select("id").distinct(), "id", "left_semi")
    _write_part(mine.select("id", _score().alias("score")), f"{out_dir}/labels", batch_id)

    def place(frames):
        p = shared.value[0]
        for pdf in frames:
            if len(pdf):
                d = _pairwise(_space(np.stack(pdf["embedding"].to_numpy()).astype(float), METRIC), _space(p, METRIC), "l2")
                yield pdf.assign(cell=d.argmin(1).astype(np.int32), far=d.min(1))

    placed = freeze(new.join(mine, "id").mapInPandas(
        place, "id long, embedding array<double>, label int, d_same double, d_other double, cell int, far double"))
    _write_part(placed.repartition("cell"), f"{out_dir}/state", batch_id, "cell")
    reach = F.max(F.greatest(F.coalesce("d_same", none), F.coalesce("d_other", none)))
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi"),
                                       reach.alias("reach"))
    _write_part(stats, f"{out_dir}/cells", batch_id)
    total = _read(spark, f"{out_dir}/cells", CELL_SCHEMA).agg(F.sum("n").alias("n_rows"))
    compared = met.agg(F.coalesce(F.sum("compared"), F.lit(0)).cast("long").alias("n_compared"))
    _write_part(total.crossJoin(compared).withColumn("n_visited", F.lit(n_visited).cast("long")),
                f"{out_dir}/counts", batch_id)


def _score():
    """J1c from the two distances (a missing same-label neighbour counts as 1, 0/0 as 0.5)."""
    ds, do = F.coalesce("d_same", F.lit(1.0)), F.col("d_other")
    return F.when(do.isNull(), 1.0).otherwise(F.coalesce(F.try_divide(do * do, ds * ds + do * do), F.lit(0.5)))


def label_scores(spark: SparkSession, out_dir: str, upto: int | None = None) -> DataFrame:
    """J1c ``(id, score)`` of all rows that came up to a batch, as after that batch."""
    near = _read(spark, f"{out_dir}/near", NEAR_SCHEMA)
    if upto is not None:
        near = near.where(F.col("batch_id") <= upto)
    return (near.groupBy("id").agg(F.min("d_same").alias("d_same"), F.min("d_other").alias("d_other"))
            .select("id", _score().alias("score")))


def running_metrics(spark: SparkSession, out_dir: str, truth: DataFrame, upto: int) -> DataFrame:
    """Label-error metrics (D11-D14) after batch ``upto``: the ranking of all rows so far against ``truth`` (id)."""
    from tidemark.operators.metrics import ranking_metrics
    from tidemark.operators.truth import id_hits

    ranked = global_rank(label_scores(spark, out_dir, upto).withColumn("_key", F.round("score", 9)), ["_key", "id"], "rank")
    return ranking_metrics(id_hits(ranked, truth).select("rank", "hit")).withColumn("batch_id", F.lit(int(upto)).cast("long"))


def audit_stream(spark: SparkSession, source_dir: str, out_dir: str | None = None, max_dist: float = 0.3,
                 max_files_per_trigger: int = 1, truth: DataFrame | None = None):
    """Start the incremental audit over Parquet files arriving in ``source_dir``; returns ``(query, out_dir)``.

    With ``truth`` (id) the running metrics are written to ``metrics`` after each batch.
    """
    out_dir = out_dir or f"{ensure_checkpoint_dir(spark).rstrip('/')}/audit-stream-{uuid.uuid4().hex}"

    def process(batch: DataFrame, batch_id: int) -> None:
        process_batch(spark, batch, batch_id, out_dir, max_dist)
        if truth is not None:
            _write_part(running_metrics(spark, out_dir, truth, batch_id).drop("batch_id"), f"{out_dir}/metrics", batch_id)

    stream = (spark.readStream.schema(EMB_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    q = (stream.writeStream.foreachBatch(process)
         .option("checkpointLocation", f"{out_dir}/_checkpoint")
         .trigger(availableNow=True).start())
    return q, out_dir


def split_to_files(df: DataFrame, folder: str, parts: int, key: str) -> None:
    """Write ``df`` as ``parts`` Parquet files by ``pmod(key, parts)`` (arrival simulation)."""
    for p in range(parts):
        df.where(F.pmod(F.col(key), F.lit(parts)) == p).coalesce(1).write.mode("overwrite").parquet(
            f"{folder}/part={p:04d}")
