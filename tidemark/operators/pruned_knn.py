"""Exact kNN that skips blocks by the triangle inequality.

* **Cells.** At most ``CELLS`` pivots (a few rounds of k-means over a bounded
  sample) cut the space; every base row goes to its nearest pivot.
* **Rings.** Inside a cell rows are cut by their distance to the pivot into at
  most ``RINGS`` rings, at quantiles of a mergeable sketch. The table of rings
  (count, nearest and farthest row) has at most ``CELLS * RINGS`` rows and is
  all that is broadcast. A ring's rows are packed into blocks of about
  ``block_rows`` rows, so a hot cell or ring is many blocks.
* **First bound.** Each query meets one block of its own ring. Its k-th
  distance there, or the distance within which whole cells must hold k rows,
  bounds its true k-th distance.
* **Visits.** Queries and blocks are dealt to sides, and each side of blocks
  streams past each side of queries (``pairs.cross_cells``), so the shuffle
  doesn't grow with what is visited. A query meets a block only if its lower bound
  does not exceed the query's: the distance to the pivot less the farthest
  row, the nearest row less the distance to the pivot, or half of how much
  farther the pivot is than the query's own. The bound falls as rows are found.

Distances and their order are those of ``pairs.knn``, so results are equal.
``compared`` counts the rows that a query was compared with. Data without
clusters, or many equal vectors, leave little to skip; then all is visited.

Ids of ``base`` are unique. Defined cases: rows with a null id or vector take no part; fewer base rows
than ``k``: all are returned; empty tables give no rows. Zero vectors under
the cosine metrics have no bound and visit every block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import as_double_array
from tidemark.operators.pairs import TILE, Nearest, _blocks, _by_cell, _layout, _pairwise, _unpack, cross_cells
from tidemark.operators.ranking import materialize

CELLS, RINGS = 2048, 32
PER_CELL = 8          # sampled rows for each pivot
LEAST = 128           # rows of a ring, about
CHUNK = 512           # queries that travel to a block together
HELD = 200_000        # queries of 64 numbers held before chunks are sent
UNIT = 1e-9           # distances are told apart in this unit (``pairs._keys``)


def _space(x: np.ndarray, metric: str) -> np.ndarray:
    """Points whose straight distance is never above the one that :func:`_straight` makes of the metric's."""
    if metric in ("l2", "sql2"):
        return x
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.hstack([x / np.where(norm == 0, 1.0, norm), (norm == 0).astype(float)])


def _straight(dist: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return dist
    return np.sqrt(np.maximum(dist, 0) * {"sql2": 1.0, "cosine": 2.0, "half_cosine": 4.0}[metric])


def _pivots(sample: np.ndarray, m: int, rounds: int = 4) -> np.ndarray:
    centres = sample[:: max(1, len(sample) // m)][:m].copy()
    for _ in range(rounds):
        at = _pairwise(sample, centres, "sql2").argmin(1)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Rings:
    """The bounded table of rings and what it says about a query."""

    def __init__(self, pivots: np.ndarray, rows: list, cuts: dict, subs: dict):
        self.cells = np.array(sorted({r["cell"] for r in rows}), np.int64)
        self.pivots, self.cuts, self.subs = pivots[self.cells], cuts, subs
        place = {c: i for i, c in enumerate(self.cells.tolist())}
        rows = sorted(rows, key=lambda r: (r["cell"], r["ring"]))
        self.cell = np.array([place[r["cell"]] for r in rows], np.int64)
        self.ring = np.array([r["ring"] for r in rows], np.int64)
        self.lo, self.hi = (np.array([r[c] for r in rows], float) for c in ("lo", "hi"))
        self.first = np.searchsorted(self.cell, np.arange(len(self.cells)))
        self.radius = np.maximum.reduceat(self.hi, self.first)
        self.count = np.add.reduceat(np.array([r["n"] for r in rows], np.int64), self.first)
        # floating-point error of distances by inner products
        self.slack = 1e-6 * (1 + float(np.linalg.norm(self.pivots, axis=1).max()) + float(self.radius.max()))

    def far(self, g: np.ndarray) -> np.ndarray:
        return _pairwise(g, self.pivots, "l2")

    def sure(self, d: np.ndarray, k: int) -> np.ndarray:
        """Distance within which whole cells hold ``k`` rows besides the query's own (infinite: too few rows)."""
        reach = d + self.radius
        order = np.argsort(reach, axis=1)
        held = np.cumsum(self.count[order], axis=1) > k
        at = np.take_along_axis(reach, np.take_along_axis(order, held.argmax(1)[:, None], 1), 1)[:, 0]
        return np.where(held[:, -1], at + self.slack, np.inf)

    def home(self, d: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """A block near each query: the ring of its own distance, one of its blocks by the id."""
        out = []
        for c, x, i in zip(d.argmin(1), d.min(1), ids):
            cell = int(self.cells[c])
            have = self.ring[self.first[c] : self.first[c] + (self.cell == c).sum()]
            ring = int(have[np.abs(have - np.searchsorted(self.cuts[cell], x)).argmin()])
            out.append((cell, ring, int(i % self.subs[cell, ring])))
        return out


def pruned_knn(queries: DataFrame, base: DataFrame | None = None, k: int = 5, id_col: str = "id",
               vec_col: str = "embedding", metric: str = "l2", exclude_self: bool = True,
               block_rows: int = 1024, cells: int | None = None) -> DataFrame:
    """``(q, nbr, dist, nn_rank, compared)``: as ``pairs.knn``, ties broken by neighbour id."""
    if metric not in ("l2", "sql2", "cosine", "half_cosine"):
        raise ValueError(f"{metric} has no triangle inequality; use pairs.knn")
    spark = queries.sparkSession
    drop_self = exclude_self and base is None

    def points(df):
        return (df.select(F.col(id_col).cast("long").alias("id"), as_double_array(vec_col).alias("v"))
                .where("id is not null and v is not null"))

    asked, rows = points(queries), points(queries if base is None else base)
    n = rows.count()
    m = cells or min(CELLS, max(1, math.isqrt(n)))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(m * PER_CELL).select("v").toPandas()["v"]  # bounded sample
    if not len(picked):
        return spark.createDataFrame([], "q long, nbr long, dist double, nn_rank int, compared long")
    pivots = _pivots(_space(np.stack(picked.to_numpy()).astype(float), metric), m)
    shared = spark.sparkContext.broadcast(pivots)   # at most CELLS vectors

    def place(frames: Iterator[pd.DataFrame]):
        for pdf in frames:
            if len(pdf):
                d = _pairwise(_space(np.stack(pdf["v"].to_numpy()).astype(float), metric), shared.value, "l2")
                yield pdf.assign(cell=d.argmin(1).astype(np.int32), far=d.min(1))

    rows = materialize(rows.mapInPandas(place, "id long, v array<double>, cell int, far double"))
    parts = [i / RINGS for i in range(1, RINGS)]
    sketched = rows.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("far", parts).alias("cuts"))
    cuts = {}
    for r in sketched.collect():   # at most CELLS rows
        step = -(-RINGS // max(1, min(RINGS, r["n"] // LEAST)))
        cuts[r["cell"]] = np.unique(np.array(r["cuts"][step - 1 :: step], float))
    cut_rows = spark.createDataFrame([(c, x.tolist()) for c, x in cuts.items()], "cell int, cuts array<double>")
    rows = rows.join(F.broadcast(cut_rows), "cell").withColumn(
        "ring", F.size(F.filter("cuts", lambda c: c < F.col("far")))).drop("cuts")
    table = rows.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("far").alias("lo"),
                                             F.max("far").alias("hi")).collect()   # at most CELLS * RINGS rows
    subs = {(r["cell"], r["ring"]): -(-r["n"] // block_rows) for r in table}
    sub_rows = spark.createDataFrame([(*key, s) for key, s in subs.items()], "cell int, ring int, subs int")
    blocks = materialize(
        rows.join(F.broadcast(sub_rows), ["cell", "ring"])
        .withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int")).groupBy("cell", "ring", "sub")
        .agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("vecs"),
             F.min("far").alias("lo"), F.max("far").alias("hi")))
    rings = spark.sparkContext.broadcast(Rings(pivots, table, cuts, subs))

    def homes(frames: Iterator[pd.DataFrame]):
        """Queries in chunks, each to one block near it."""
        r, held, size = rings.value, {}, 0

        def chunks():
            out = [(*key, np.array([i for i, _ in part[a : a + CHUNK]]), np.concatenate([v for _, v in part[a : a + CHUNK]]))
                   for key, part in held.items() for a in range(0, len(part), CHUNK)]
            held.clear()
            return pd.DataFrame(out, columns=["cell", "ring", "sub", "ids", "vecs"])

        for pdf in frames:
            for a in range(0, len(pdf), CHUNK):
                part = pdf.iloc[a : a + CHUNK]
                x, ids = np.stack(part["v"].to_numpy()).astype(float), part["id"].to_numpy()
                for i, key in enumerate(r.home(r.far(_space(x, metric)), ids)):
                    held.setdefault(key, []).append((ids[i], x[i]))
                size += x.size
                if size >= HELD * 64:
                    yield chunks()
                    size = 0
        if held:
            yield chunks()

    def first_bound(frames: Iterator[pd.DataFrame]):
        """The k-th distance of each query in its near block, where that holds k rows."""
        for _, part in _by_cell(frames, ("cell", "ring", "sub")):
            ids = None
            for row in part:
                if row.role == 0:
                    ids, v = _unpack(row)
                elif ids is not None:
                    qids, q = _unpack(row)
                    d = _pairwise(q, v, metric)
                    if drop_self:
                        d[qids[:, None] == ids[None]] = np.inf
                    if d.shape[1] >= k:
                        kth = np.partition(d, k - 1, axis=1)[:, k - 1]
                        yield pd.DataFrame({"id": qids, "kth": np.where(np.isfinite(kth), kth, np.nan)})

    key = ["cell", "ring", "sub"]
    near = (blocks.select(*key, "ids", "vecs", F.lit(0).alias("role"))
            .unionByName(asked.mapInPandas(homes, "cell int, ring int, sub int, ids array<long>, vecs array<double>")
                         .withColumn("role", F.lit(1)))
            .repartition(*key).sortWithinPartitions(*key, "role").mapInPandas(first_bound, "id long, kth double"))
    kth = near.groupBy("id").agg(F.min(F.nanvl("kth", F.lit(None).cast("double"))).alias("kth"))

    def bound(frames: Iterator[pd.DataFrame]):
        r = rings.value
        for pdf in frames:
            for a in range(0, len(pdf), CHUNK):
                part = pdf.iloc[a : a + CHUNK]
                x = np.stack(part["v"].to_numpy()).astype(float)
                d = r.far(_space(x, metric))
                most = np.fmin(_straight(part["kth"].to_numpy(float) + UNIT, metric), r.sure(d, k))
                if metric in ("cosine", "half_cosine"):
                    most[~x.any(1)] = np.inf
                yield part.drop(columns="kth").assign(bound=most, own=d.min(1))

    bounded = materialize(asked.join(kth, "id", "left").mapInPandas(
        bound, "id long, v array<double>, bound double, own double"))

    def nearest(frames: Iterator[pd.DataFrame]):
        """A side of queries, with the side's blocks streamed past it: a query meets a block only if its bound leaves it open."""
        r = rings.value
        for _, part in _by_cell(frames):
            held, best, cell = [], None, None
            for row in part:
                if row.role == 0:
                    held.append((*_unpack(row), np.asarray(row.x_bound, float), np.asarray(row.x_own, float)))
                    continue
                if not held:
                    break
                if best is None:
                    qids, q, most, own = (np.concatenate([h[i] for h in held]) for i in range(4))
                    held = [None]   # the queries now lie in one array
                    points, best, seen = _space(q, metric), Nearest(qids, k), np.zeros(len(qids), np.int64)
                if row.cell_no != cell:   # blocks come in the order of their cells
                    cell = int(row.cell_no)
                    far = _pairwise(points, r.pivots[np.searchsorted(r.cells, cell)][None], "l2")[:, 0]
                limit = most + r.slack
                go = np.flatnonzero(np.maximum(np.maximum(far - row.hi, row.lo - far), (far - own) / 2) <= limit)
                ids, v = _unpack(row)
                for a in range(0, len(go), TILE):
                    at = go[a : a + TILE]
                    d = _pairwise(q[at], v, metric)
                    if drop_self:
                        d[qids[at][:, None] == ids[None]] = np.inf
                    best.meet(at, ids, d)
                    most[at] = np.where(np.isinf(most[at]) & ~q[at].any(1), np.inf,
                                        np.fmin(most[at], _straight(best.dist[at, -1] + UNIT, metric)))
                seen[go] += len(ids)
            if best is not None:
                found = best.frame()
                x = np.nonzero(np.isfinite(best.dist))[0]
                yield found.assign(compared=np.where(np.r_[True, x[1:] != x[:-1]][: len(x)], seen[x], 0))

    nq, q_sides = _layout(bounded, block_rows)
    _, b_sides = _layout(rows, block_rows, n=n)
    queries_ = _blocks(bounded, "id", "v", nq, ["bound", "own"])
    # blocks are numbered in the order of their cells, so the sides are even whatever the cells
    start, first = [], 0
    for c, g in sorted(subs):
        start.append((c, g, first))
        first += subs[c, g]
    numbered = (blocks.join(F.broadcast(spark.createDataFrame(start, "cell int, ring int, first long")), ["cell", "ring"])
                .select((F.col("first") + F.col("sub")).cast("int").alias("blk"), "ids", "vecs", "lo", "hi",
                        F.col("cell").alias("cell_no")))
    nothing = {"lo": "double", "hi": "double", "cell_no": "int"}
    asked_blocks = queries_.select("*", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    base_blocks = numbered.select("*", *[F.lit(None).cast("array<double>").alias(c) for c in ("x_bound", "x_own")])
    found = cross_cells(asked_blocks, base_blocks, q_sides, b_sides).mapInPandas(
        nearest, "q long, nbr long, dist double, key long, compared long")
    w = Window.partitionBy("q")
    return (found.withColumn("nn_rank", F.row_number().over(w.orderBy("key", "nbr")))
            .withColumn("compared", F.sum("compared").over(w)).where(F.col("nn_rank") <= k)
            .select("q", "nbr", "dist", F.col("nn_rank").cast("int").alias("nn_rank"), "compared"))
