"""Approximate nearest neighbours: hierarchical k-means tree, best bin first.

* **Tree.** K-means on a bounded sample of vectors (the smallest by a hash of
  the id; 32 for each leaf, at least ``SAMPLE``, at most ``SAMPLE_NUMBERS``
  numbers in all), split again inside each cluster. The tree aims at as many
  leaves as the square root of the rows, at least ``LEAVES``; the sample bounds
  them at 16,384 for 64 dimensions, so what is broadcast is bounded.
* **Index.** Every row is sent to its leaf; the rows of a leaf are packed
  into blocks of at most ``BLOCK`` vectors, so a full leaf is many blocks.
* **Traversal.** A query walks the tree with a priority queue ordered by the
  distance to the centres and meets leaves best first.
* **Widening.** A calibration set of queries (``CALIBRATION`` rows by hash) is
  searched by brute force over all rows, in blocks. The number of leaves
  visited is doubled and then narrowed to the least that reaches the recall
  asked for. Every query visits that many leaves, and more until they hold
  enough rows.
* **Search.** Blocks and the chunks of queries that visit their leaf are
  joined on the leaf and, for a leaf of many blocks, on one of its parts: its
  blocks are dealt to parts of ``PART`` blocks, its chunks go to each part. One matrix product per pair proposes the best (a task
  merges those of all its pairs); their cosines are computed again in double precision from the original vectors
  (row sums in a fixed order), so equal vectors tie exactly.

Defined cases: vectors that are null, zero, hold null or non-finite values,
or differ in length from the commonest length (the longer at a tie) take no
part; rows of a null id neither. Of rows that repeat an id the smallest vector
counts. Fewer candidates than ``k``: all are returned. Extra columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, rows_at_once

SAMPLE, SAMPLE_NUMBERS, LEAVES, CALIBRATION = 16_384, 1 << 25, 144, 200
BLOCK, CHUNK, PART = 2048, 256, 16
HELD = 200_000   # found rows that a task merges before it sends them on
VECTORS = "leaf int, block long, ids binary, vectors binary"
CHUNKS = "leaf int, part int, qids binary, qvectors binary"


# ---------------------------------------------------------------- tree

@dataclass
class Tree:
    """Nodes by number; the root is 0. ``children`` of a leaf are empty, ``leaf`` numbers the leaves."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest centre on every level."""
        node = np.zeros(len(x), np.int64)
        moving = np.ones(len(x), bool)
        while moving.any():
            for n in np.unique(node[moving]):
                at = np.flatnonzero(moving & (node == n))
                kids = self.children[n]
                if len(kids):
                    node[at] = kids[_nearest(x[at], self.centres[kids])]
                else:
                    moving[at] = False
        return self.leaf[node]

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order in which a priority queue over the tree meets them."""
        heap, tick = [(0.0, 0, 0)], 0
        while heap:
            _, _, n = heapq.heappop(heap)
            kids = self.children[n]
            if not len(kids):
                yield int(self.leaf[n])
                continue
            for c, d in zip(kids, ((self.centres[kids] - q) ** 2).sum(1)):
                tick += 1
                heapq.heappush(heap, (float(d), tick, int(c)))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def build_tree(x: np.ndarray, branch: int, least: int = 32, seed: int = 5) -> Tree:
    """Hierarchical k-means of the rows of ``x`` (unit vectors); a leaf has ``least`` of them or more."""
    rng = np.random.default_rng(seed)
    centres, children, leaf = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [np.empty(0, int)], [-1]
    todo, leaves = deque([(0, x)]), 0
    while todo:
        n, rows = todo.popleft()
        k = min(branch, len(rows) // least)
        c = _kmeans(rows, k, rng) if k > 1 else rows[:0]
        if len(c) < 2:
            leaf[n], leaves = leaves, leaves + 1
            continue
        at = _nearest(rows, c)
        children[n] = np.arange(len(centres), len(centres) + len(c))
        for i in range(len(c)):
            todo.append((len(centres), rows[at == i]))
            centres.append(c[i])
            children.append(np.empty(0, int))
            leaf.append(-1)
    return Tree(np.array(centres), children, np.array(leaf))


# ---------------------------------------------------------------- vectors

def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, v)`` in double precision of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where("id is not null and v is not null").where(fine & F.exists("v", lambda x: x != 0))
    v = v.groupBy("id").agg(F.min("v").alias("v"))
    length = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    return v.join(F.broadcast(length.select("n")), F.size("v") == F.col("n"), "left_semi")  # one row


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that very large or small vectors keep their direction
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact cosines of paired rows; sums run along rows, so a pair's value doesn't depend on its neighbours."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        c = (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))
    bad = ~np.isfinite(c)
    if bad.any():
        c[bad] = (_unit(q[bad]) * _unit(x[bad])).sum(1)
    return c


def _pack(rows: DataFrame, leaf_of, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows of one leaf, per task."""
    def run(frames: Iterator[pd.DataFrame]):
        held: dict[int, list] = {}
        seen = 0

        def blocks(leaf, parts):
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            for i in range(0, len(ids), size):
                yield leaf, i, ids[i : i + size].tobytes(), x[i : i + size].tobytes()

        def all_blocks():
            out = pd.DataFrame([b for leaf, parts in held.items() for b in blocks(leaf, parts)],
                               columns=["leaf", "block", "ids", "vectors"])
            held.clear()
            return out

        for pdf in frames:
            x, ids = np.stack(pdf["v"].to_numpy()), pdf["id"].to_numpy()
            leaves = leaf_of(x)
            order = np.argsort(leaves, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(leaves[order]) != 0])
            for at in np.split(order, cut[1:]):
                held.setdefault(int(leaves[at[0]]), []).append((ids[at], x[at]))
            seen += x.size
            if seen >= 12_000_000:  # about 100 MB
                yield all_blocks()
                seen = 0
        if held:
            yield all_blocks()

    return rows.mapInPandas(run, VECTORS)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per query of each task's (block, chunk) pairs, then of all of them."""
    def first(parts: list) -> pd.DataFrame:
        x = pd.concat(parts).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return x[x.groupby("query_id", sort=False).cumcount() < k]

    def run(frames: Iterator[pd.DataFrame]):
        held, size = [], 0
        for pdf in frames:
            for r in pdf.itertuples():
                ids, qids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.qids, np.int64)
                x = np.frombuffer(r.vectors).reshape(len(ids), -1)
                q = np.frombuffer(r.qvectors).reshape(len(qids), -1)
                s = _unit(q) @ _unit(x).T
                s[qids[:, None] == ids[None]] = -np.inf
                if len(ids) > k:
                    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                    a, b = np.nonzero(s >= np.maximum(kth, -2)[:, None] - 1e-9)
                else:
                    a, b = np.nonzero(s > -2)
                exact = _cosines(q[a], x[b])
                order = np.lexsort((ids[b], -exact, a))
                a, b, exact = a[order], b[order], exact[order]
                rank = np.arange(len(a)) - np.searchsorted(a, a)
                keep = rank < k
                held.append(pd.DataFrame({"query_id": qids[a[keep]], "vec_id": ids[b[keep]], "score": exact[keep]}))
                size += len(held[-1])
                if size >= HELD:
                    held = [first(held)]
                    size = len(held[0])
                    if size >= HELD // 2:   # many queries rather than many blocks
                        yield held[0]
                        held, size = [], 0
        if held:
            yield first(held)

    found = pairs.mapInPandas(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


# ---------------------------------------------------------------- search

def search(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = 0.97, branch: int = 12,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each query; ``is_query`` is on ``id``."""
    spark = vectors.sparkSession
    rows_at_once(spark, 32)  # a row of the join holds a block and a chunk
    scratch = Scratch(spark, "ann")
    rows = scratch.write(usable(vectors, id_col, vec_col), "rows")
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    leaves = max(LEAVES, math.isqrt(n))
    size = max(1, min(max(SAMPLE, 32 * leaves), SAMPLE_NUMBERS // max(dim, 1)))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(size).select("v").toPandas()["v"]
    x = _unit(np.stack(picked.to_numpy())) if len(picked) else np.zeros((0, 1))
    tree = build_tree(x, branch, max(32, len(x) // leaves))
    shared = spark.sparkContext.broadcast(tree)  # fewer centres than sampled rows / 16
    packed = scratch.write(_pack(rows, lambda x: shared.value.assign(_unit(x)), BLOCK), "packed")
    # one row per leaf
    sizes = dict(packed.groupBy("leaf").agg((F.sum(F.octet_length("ids")) / 8).cast("long")).collect())

    # calibration: brute force for a bounded number of queries, against every block of rows
    some = rows.where(is_query).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION)
    truth = _best(_against_all(packed, some), k)
    home = packed.select("leaf", F.explode(F.transform(F.sequence(
        F.lit(0), (F.octet_length("ids") / 8 - 1).cast("int")), lambda i: i)).alias("i"), "ids")
    ids_of = home.select("leaf", F.expr("conv(hex(reverse(substring(ids, i * 8 + 1, 8))), 16, -10)")
                         .cast("long").alias("vec_id"))
    near = truth.join(ids_of, "vec_id").select("query_id", "leaf").collect()
    visits = _least_visits(tree, dict(some.collect()), near, recall)

    parts = {leaf: -(-size // (BLOCK * PART)) for leaf, size in sizes.items()}

    def ordered(frames: Iterator[pd.DataFrame]):
        """Queries with the leaves that they visit, in chunks per leaf."""
        held: dict[int, list] = {}
        n = 0

        def chunks():
            rows = [(leaf, p, np.array([a for a, _ in part[i : i + CHUNK]]).tobytes(),
                     np.stack([b for _, b in part[i : i + CHUNK]]).tobytes())
                    for leaf, part in held.items() for i in range(0, len(part), CHUNK) for p in range(parts[leaf])]
            held.clear()
            return pd.DataFrame(rows, columns=["leaf", "part", "qids", "qvectors"])

        for pdf in frames:
            for i, v in zip(pdf["id"].to_numpy(), pdf["v"]):
                got, seen = 0, 0
                for leaf in shared.value.best_first(_unit(v[None])[0]):
                    if seen >= visits and got > k:
                        break
                    if leaf in sizes:
                        held.setdefault(leaf, []).append((i, v))
                        got += sizes[leaf]
                    seen += 1
                n += seen
                if n >= 50_000:
                    yield chunks()
                    n = 0
        if held:
            yield chunks()

    queries = rows.where(is_query).repartition("id").mapInPandas(ordered, CHUNKS)
    dealt = spark.createDataFrame(list(parts.items()), "leaf int, parts int")
    blocks = (packed.join(F.broadcast(dealt), "leaf")
              .withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int")).drop("parts"))
    # as many tasks whatever the size: each sends on k rows of a query, however many blocks the query meets there
    tasks, key = 2 * spark.sparkContext.defaultParallelism, ["leaf", "part"]
    return _best(blocks.repartition(tasks, *key).join(queries.repartition(tasks, *key), key), k)


def _against_all(packed: DataFrame, some: DataFrame) -> DataFrame:
    """Each block of rows with the calibration queries, which are at most ``CALIBRATION`` vectors."""
    q = some.collect()
    ids = np.array([r[0] for r in q], np.int64)
    vec = np.array([r[1] for r in q], np.float64)
    if not len(q):
        return packed.where("false").select("*", F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))
    return packed.select("*", F.lit(bytearray(ids.tobytes())).alias("qids"),
                         F.lit(bytearray(vec.tobytes())).alias("qvectors"))


def _least_visits(tree: Tree, queries: dict, near: list, recall: float) -> int:
    """Widen the visits until the calibration queries find ``recall`` of their true neighbours."""
    leaves = int((tree.leaf >= 0).sum())
    place = {i: {leaf: n for n, leaf in enumerate(tree.best_first(_unit(np.array([v], np.float64))[0]))}
             for i, v in queries.items()}
    at = np.array([place[i][leaf] for i, leaf in near])
    found = lambda n: (at < n).mean() if len(at) else 1.0
    visits = 1
    while visits < leaves and found(visits) < recall:
        visits *= 2
    low = visits // 2
    while visits - low > 1:
        mid = (low + visits) // 2
        low, visits = (low, mid) if found(mid) >= recall else (mid, visits)
    return min(visits, leaves)
