"""Pair joins over vector tables: all pairs (C1), kNN (C7), candidates.

Exact all-pairs is quadratic by nature. We never form an n x n matrix in one
place: rows are hashed into blocks of bounded size, blocks are dealt to sides
of at most ``SIDE_ROWS`` rows, and a cell is a pair of sides. A block travels
once to each cell of its side, so the shuffle carries the table as many times
as there are sides (enough for every core; more only beyond ``SIDE_ROWS`` rows
a side), not once for each block pair. The task of a cell holds one side,
streams the other side's blocks past it, and each block pair becomes one NumPy
matrix product inside ``mapInPandas``. Task memory is bounded by the two sides
whatever the table size.

kNN keeps a running top-k of the queries of a side, then a ``row_number``
window per query merges the sides.

Rows with a null id or vector take no part; a null label is neither the same
as another label nor different from it.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import as_double_array

SIDE_ROWS = 65_536    # rows of a side of a cell, about (32 MB of 64 dimensions)
STRIP = 256           # rows of a block that are filtered at once
TILE = 4096           # queries of a side that are compared with a block at once
METRICS = ("half_cosine", "cosine", "l2", "sql2", "dot")


def _pairwise(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric in ("half_cosine", "cosine"):
        na = np.linalg.norm(a, axis=1, keepdims=True)
        nb = np.linalg.norm(b, axis=1, keepdims=True)
        na[na == 0] = 1.0
        nb[nb == 0] = 1.0
        cos = (a / na) @ (b / nb).T
        d = 1.0 - cos
        return d / 2.0 if metric == "half_cosine" else d
    if metric in ("l2", "sql2"):
        sq = (np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :]
              - 2.0 * (a @ b.T))
        np.maximum(sq, 0.0, out=sq)
        return np.sqrt(sq) if metric == "l2" else sq
    if metric == "dot":
        return -(a @ b.T)
    raise ValueError(f"unknown metric {metric}")


def _layout(df: DataFrame, block_rows: int, groups: int = 1, n: int | None = None) -> tuple[int, int]:
    """``(blocks, sides)``: blocks of at most ``block_rows`` rows, at least as many sides as give
    every core a few cells, of at most ``SIDE_ROWS`` rows (never below 64 rows per block)."""
    n = df.count() if n is None else n
    cores = int(math.ceil(math.sqrt(8.0 * df.sparkSession.sparkContext.defaultParallelism / groups)))
    blocks = max(1, int(math.ceil(n / float(block_rows))), min(cores, int(math.ceil(n / 64.0))))
    return blocks, min(blocks, max(cores, int(math.ceil(n / float(SIDE_ROWS)))))


def _blocks(df: DataFrame, id_col: str, vec_col: str, n_blocks: int, extra=(), by=()) -> DataFrame:
    """One row per block: ids, flattened vectors and any extra columns as lists."""
    blk = F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_blocks)).cast("int").alias("blk")
    row = F.struct(F.col(id_col).alias("id"), as_double_array(vec_col).alias("v"), *[F.col(c).alias(f"x_{c}") for c in extra])
    return (df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
            .groupBy(*by, blk).agg(F.collect_list(row).alias("_r"))
            .select(*by, "blk", F.col("_r.id").alias("ids"), F.flatten("_r.v").alias("vecs"),
                    *[F.col(f"_r.x_{c}").alias(f"x_{c}") for c in extra]))


def _dealt(cells: DataFrame, n_cells: int, by=()) -> DataFrame:
    """A cell's rows in one task: the held side (role 0) before the blocks that stream past it (role 1)."""
    if by:
        par = cells.sparkSession.sparkContext.defaultParallelism
        cells = cells.repartition(max(4 * par, n_cells), *by, "cell")
    else:
        cells = cells.repartitionById(n_cells, F.col("cell").cast("int"))
    return cells.sortWithinPartitions(*by, "cell", "role", "blk")


def pair_cells(blocks: DataFrame, sides: int) -> DataFrame:
    """Every unordered pair of blocks in the cell of their sides (``a <= b``), each block with itself too."""
    side = F.pmod(F.col("blk"), F.lit(sides))
    at = lambda a, b: (a * sides + b).cast("long")
    held = blocks.withColumn("cell", F.explode(F.transform(F.sequence(side, F.lit(sides - 1)), lambda t: at(side, t))))
    met = blocks.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), side), lambda t: at(t, side))))
    return held.withColumn("role", F.lit(0)).unionByName(met.withColumn("role", F.lit(1)))


def _numbered(cells: DataFrame, sides: int) -> DataFrame:
    """Cells ``a * sides + b`` with ``a <= b`` numbered without gaps, and dealt."""
    a, b = F.floor(F.col("cell") / sides), F.pmod("cell", F.lit(sides))
    return _dealt(cells.withColumn("cell", (a * sides - F.floor(a * (a - 1) / 2) + b - a).cast("long")),
                  sides * (sides + 1) // 2)


def cross_cells(a: DataFrame, b: DataFrame, a_sides: int, b_sides: int, by=()) -> DataFrame:
    """Every block of ``a`` (held) with every block of ``b``, in the cells of their sides."""
    at = F.pmod(F.col("blk"), F.lit(a_sides)).cast("long") * b_sides
    held = a.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(b_sides - 1)), lambda t: at + t)))
    other = F.pmod(F.col("blk"), F.lit(b_sides)).cast("long")
    met = b.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(a_sides - 1)), lambda t: t * b_sides + other)))
    return _dealt(held.withColumn("role", F.lit(0)).unionByName(met.withColumn("role", F.lit(1))), a_sides * b_sides, by)


def _by_cell(frames, keys=("cell",)):
    """``(key, rows)`` of each cell of a task, in turn."""
    rows = (row for pdf in frames for row in pdf.itertuples(index=False))
    return groupby(rows, key=lambda row: tuple(getattr(row, k) for k in keys))


def _block_pairs(frames):
    """The block pairs ``(a, b)`` of the cells of :func:`pair_cells`, each once."""
    for _, rows in _by_cell(frames):
        held = []
        for row in rows:
            if row.role == 0:
                held.append(row)
            else:
                there = {a.blk for a in held}
                for a in held:
                    if a.blk <= row.blk or row.blk not in there:   # within a side each pair of blocks once
                        yield a, row


def _flat(ids, vecs):
    ids = np.asarray(ids, dtype=np.int64)
    return ids, np.asarray(vecs, dtype=np.float64).reshape(len(ids), -1)


def _unpack(row):
    return _flat(row.ids, row.vecs)


def _measure(metric):
    """A metric's name, or a function of two blocks of vectors."""
    return metric if callable(metric) else lambda a, b: _pairwise(a, b, metric)


class Whole:
    """How counting kernels measure two blocks. Any metric: all pairs of the blocks at once.

    ``prepared`` is what a block's vectors are kept as, ``within`` gives the flat places of all pairs of two blocks
    that are no farther than ``far`` and their distances, ``of`` the distances of named pairs. A pair has the same
    distance in both, to the last bit.
    """

    def __init__(self, metric):
        self.all = _measure(metric)

    def prepared(self, v):
        return v

    def rough(self, a, b):
        return self.all(a, b)

    def margin(self, a) -> float:
        return 0.0

    def within(self, a, b, far):
        d = self.all(a, b).ravel()
        at = np.flatnonzero(d <= far)
        return at, d[at]

    def of(self, a, b, ii, jj):
        return self.all(a, b)[ii, jj]


class Filtered(Whole):
    """A metric whose ``rough`` is a cheap form in single precision, wrong by ``margin`` at most: pairs that may be near
    are measured again, each by sums in the order of its components, whatever block they come from."""

    def within(self, a, b, far):
        d = self.rough(a, b)
        limit = np.float32(far) + np.float32(self.margin(a))
        if d.min() > limit:   # not so with a NaN
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        at = np.flatnonzero(~(d.ravel() > limit))
        exact = self.of(a, b, *np.divmod(at, d.shape[1]))
        near = exact <= far
        return at[near], exact[near]


def _products(x: np.ndarray, y: np.ndarray, ii: np.ndarray, jj: np.ndarray) -> np.ndarray:
    """Scalar products of named columns of ``x`` and ``y``, each summed in the order of the components."""
    n = x.shape[1] * y.shape[1]
    out = np.zeros(len(ii))
    if 5 * len(ii) > n:   # most pairs of the blocks: all at once, strip by strip
        full = np.zeros((x.shape[1], y.shape[1]))
        for lo in range(0, x.shape[1], 64):
            strip = full[lo : lo + 64]
            for k in range(len(x)):
                strip += x[k, lo : lo + 64, None] * y[k]
        return full[ii, jj]
    for lo in range(0, len(ii) if len(x) else 0, 2048):
        p, q = ii[lo : lo + 2048], jj[lo : lo + 2048]
        out[lo : lo + 2048] = np.add.accumulate(x[:, p] * y[:, q], axis=0)[-1]
    return out


class HalfCosine(Filtered):
    """The audit distance ``(1 - cos) / 2``."""

    def __init__(self):
        super().__init__("half_cosine")

    def prepared(self, v):
        n = np.linalg.norm(v, axis=1, keepdims=True)
        n[n == 0] = 1.0
        x = v / n
        return np.ascontiguousarray(x.T), x.astype(np.float32)

    def margin(self, a):
        return (len(a[0]) + 8) * 2.0**-23

    def rough(self, a, b):
        c = a[1] @ b[1].T
        c *= np.float32(-0.5)
        c += np.float32(0.5)
        return c

    def within(self, a, b, far):
        limit = np.float32(1.0 - 2.0 * (far + self.margin(a)))
        found, wide = [], len(b[1])
        cos = np.empty((min(STRIP, len(a[1])), wide), dtype=np.float32)
        for lo in range(0, len(a[1]), STRIP):
            c = np.matmul(a[1][lo : lo + STRIP], b[1].T, out=cos[: len(a[1]) - lo])
            if not c.max() < limit:   # not so with a NaN
                found.append(np.flatnonzero(~(c.ravel() < limit)) + lo * wide)
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        at = np.concatenate(found)
        exact = self.of(a, b, *np.divmod(at, wide))
        near = exact <= far
        return at[near], exact[near]

    def of(self, a, b, ii, jj):
        return (1.0 - _products(a[0], b[0], ii, jj)) / 2.0


def _counting(metric) -> Whole:
    """The measure of a counting kernel for a metric's name, a function of two blocks, or a measure itself."""
    if isinstance(metric, Whole):
        return metric
    return HalfCosine() if metric == "half_cosine" else Whole(metric)


def _prepared_pairs(frames, measure):
    """:func:`_block_pairs` with ``(blk, ids, prepared vectors)`` of both blocks; a block is prepared once in a cell."""
    for _, rows in _by_cell(frames):
        held, there = [], set()
        for row in rows:
            ids, vecs = _unpack(row)
            part = (row.blk, ids, measure.prepared(vecs))
            if row.role == 0:
                held.append(part)
                there.add(row.blk)
                continue
            for a in held:
                if a[0] <= row.blk or row.blk not in there:
                    yield a, part


def _once(at: np.ndarray, columns: int, same_block: bool):
    """Which flat places count: all, or in a block's pairs with itself one half."""
    return slice(None) if not same_block else np.flatnonzero(at // columns < at % columns)


def _halved(d: np.ndarray, same_block: bool) -> np.ndarray:
    """Distances of a block to itself once for each pair (the rest infinite)."""
    if same_block:
        d[np.tril_indices(len(d))] = np.inf
    return d


def nearest_by_label(df: DataFrame, id_col: str = "id", vec_col: str = "embedding",
                     label_col: str = "label", metric: str = "half_cosine",
                     block_rows: int = 1024) -> DataFrame:
    """Nearest same-label and other-label distance of every row (inside J1c).

    A cell emits one minimum per row of its held side and of each block that
    met it; a ``groupBy(id)`` merges the cells, so the n^2 distances never
    leave the kernel.
    """
    nb, sides = _layout(df, block_rows)
    cells = _numbered(pair_cells(_blocks(df, id_col, vec_col, nb, [label_col]), sides), sides)

    def out(ids, same, other):
        return pd.DataFrame({"id": ids, "d_same": same, "d_other": other}).replace([np.inf], np.nan)

    def kernel(frames):
        for _, rows in _by_cell(frames):
            held, best = [], []
            for row in rows:
                ids, vecs = _unpack(row)
                labels = pd.Series(getattr(row, f"x_{label_col}"))
                part = (row.blk, ids, vecs, labels.to_numpy(), labels.notna().to_numpy())
                if row.role == 0:
                    held.append(part)
                    best.append(np.full((2, len(ids)), np.inf))
                    continue
                mine = np.full((2, len(ids)), np.inf)
                there = {p[0] for p in held}
                _, ib, vb, lb, kb = part
                for (blk, ia, va, la, ka), top in zip(held, best):
                    if blk > row.blk and row.blk in there:
                        continue
                    d = _pairwise(va, vb, metric)
                    if blk == row.blk:
                        d[ia[:, None] == ib[None, :]] = np.inf
                    same = la[:, None] == lb[None, :]
                    other = ~same
                    if not (ka.all() and kb.all()):
                        known = ka[:, None] & kb[None, :]
                        same, other = same & known, other & known
                    for i, m in enumerate((np.where(same, d, np.inf), np.where(other, d, np.inf))):
                        np.fmin(top[i], np.fmin.reduce(m, axis=1), out=top[i])
                        if blk != row.blk:
                            np.fmin(mine[i], np.fmin.reduce(m, axis=0), out=mine[i])
                yield out(ib, *mine)
            for (_, ia, _, _, _), top in zip(held, best):
                yield out(ia, *top)

    parts = cells.mapInPandas(kernel, "id bigint, d_same double, d_other double")
    least = lambda c: F.min(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(c)
    return parts.groupBy("id").agg(least("d_same"), least("d_other"))


def all_pairs(df: DataFrame, id_col: str = "id", vec_col: str = "embedding",
              metric="half_cosine", max_dist: float | None = None,
              label_col: str | None = None, block_rows: int = 1024, top: int | None = None) -> DataFrame:
    """Every unordered pair ``i < j`` once with its distance.

    Output ``(i, j, dist)`` plus ``same_label`` when ``label_col`` is given
    (C9). ``max_dist`` keeps only close pairs (threshold pushed into the
    block kernel, so far pairs are never materialised); ``top`` keeps the
    first pairs by (distance in units of 1e-9, i, j): a task sends on its own
    first ones only. ``metric`` may be a function of two blocks.
    """
    nb, sides = _layout(df, block_rows)
    extra = [label_col] if label_col else []
    cells = _numbered(pair_cells(_blocks(df, id_col, vec_col, nb, extra), sides), sides)
    measure = _measure(metric.all if isinstance(metric, Whole) else metric)

    def found(a, b, limit):
        ia, va = _unpack(a)
        ib, vb = _unpack(b)
        d = measure(va, vb)
        if limit is None:
            ii, jj = np.triu_indices(len(ia), k=1) if a.blk == b.blk else np.divmod(np.arange(d.size), d.shape[1])
        else:
            ii, jj = np.nonzero(_halved(d, a.blk == b.blk) <= limit)
        gi, gj = ia[ii], ib[jj]
        out = {"i": np.minimum(gi, gj), "j": np.maximum(gi, gj), "dist": d[ii, jj]}
        if label_col:
            la, lb = np.asarray(getattr(a, f"x_{label_col}")), np.asarray(getattr(b, f"x_{label_col}"))
            out["same_label"] = la[ii] == lb[jj]
        return pd.DataFrame(out)

    def kernel(frames):
        best, limit = [], max_dist if top is None or max_dist is not None else np.finfo(float).max
        for a, b in _block_pairs(frames):
            pdf = found(a, b, limit)
            if top is None:
                yield pdf
            elif len(pdf):
                best = [_first_pairs(pd.concat([*best, pdf]), top)]
                if len(best[0]) == top:
                    limit = min(limit, _limit(_keys(best[0]["dist"].to_numpy()[-1:]))[0])
        yield from best

    schema = "i bigint, j bigint, dist double" + (", same_label boolean" if label_col else "")
    pairs = cells.mapInPandas(kernel, schema)
    if top is None:
        return pairs
    return pairs.orderBy(F.rint(F.col("dist") * 1e9), "i", "j").limit(top)   # a few rows of each task


def _first_pairs(pdf: pd.DataFrame, top: int) -> pd.DataFrame:
    key = _keys(pdf["dist"].to_numpy())
    if len(key) > top:
        near = np.flatnonzero(key <= np.partition(key, top - 1)[top - 1])
        pdf, key = pdf.iloc[near], key[near]
    return pdf.iloc[np.lexsort((pdf["j"].to_numpy(), pdf["i"].to_numpy(), key))[:top]]


def knn(queries: DataFrame, base: DataFrame | None = None, k: int = 5,
        id_col: str = "id", vec_col: str = "embedding", metric: str = "l2",
        exclude_self: bool = True, block_rows: int = 1024,
        base_id_col: str | None = None, base_vec_col: str | None = None) -> DataFrame:
    """C7 + E7: the k nearest base rows of every query row.

    Output ``(q, nbr, dist, nn_rank)`` with ``nn_rank`` 1..k, ties broken by
    neighbour id. ``base=None`` joins the table with itself; then
    ``exclude_self`` drops the query's own row.
    """
    self_join = base is None
    base = queries if base is None else base
    bid = base_id_col or id_col
    bvec = base_vec_col or vec_col
    nq, q_sides = _layout(queries, block_rows)
    nbb, b_sides = _layout(base, block_rows) if not self_join else (nq, q_sides)
    qb = _blocks(queries, id_col, vec_col, nq)
    bb = _blocks(base.select(F.col(bid).alias(id_col), F.col(bvec).alias(vec_col)), id_col, vec_col, nbb)
    drop_self = exclude_self and self_join

    def kernel(frames):
        for _, rows in _by_cell(frames):
            yield from _nearest_in_cell(rows, k, metric, drop_self)

    cand = cross_cells(qb, bb, q_sides, b_sides).mapInPandas(kernel, "q bigint, nbr bigint, dist double, key bigint")
    # the kernel's integer key (distance in units of 1e-9) orders everywhere, ties break on the id
    w = Window.partitionBy("q").orderBy("key", "nbr")
    return (cand.withColumn("nn_rank", F.row_number().over(w)).drop("key")
            .where(F.col("nn_rank") <= k)
            .withColumn("nn_rank", F.col("nn_rank").cast("int")))


def _nearest_in_cell(rows, k: int, metric: str, drop_self: bool):
    """The k best of a cell's held queries (one frame), with the cell's blocks streamed past them."""
    held, best = [], None
    for row in rows:
        if row.role == 0:
            held.append((row.blk, *_unpack(row)))
            continue
        if not held:
            break
        if best is None:
            best = Nearest(np.concatenate([h[1] for h in held]), k)
            vecs = np.concatenate([h[2] for h in held])
            start = dict(zip([h[0] for h in held], np.cumsum([0] + [len(h[1]) for h in held])))
            own = {h[0]: h[1] for h in held}
            held = [None]   # the blocks now lie in one array
        ib, vb = _unpack(row)
        for at in range(0, len(vecs), TILE):
            d = _pairwise(vecs[at : at + TILE], vb, metric)
            if drop_self and row.blk in own:   # a row's own id lies in the same block of both sides
                first, ia = start[row.blk] - at, own[row.blk]
                x, y = np.nonzero(ia[:, None] == ib[None, :])
                x += first
                ok = (x >= 0) & (x < len(d))
                d[x[ok], y[ok]] = np.inf
            best.meet(np.arange(at, min(at + TILE, len(vecs))), ib, d)
    if best is not None:
        yield best.frame()


class Nearest:
    """Running k nearest of an array of queries, by (key, id), however many tie."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.key = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.nbr = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.dist = np.full((len(ids), k), np.inf)
        self.limit = np.full(len(ids), np.finfo(float).max)   # no candidate farther than this is among the k

    def meet(self, at: np.ndarray, ib: np.ndarray, d: np.ndarray) -> None:
        """Compare the queries at places ``at`` (distinct) with ``ib``; ``d`` holds their distances."""
        k, limit = self.k, self.limit[at]
        close = d <= limit[:, None]
        if close.sum() > 2 * k * len(at) and d.shape[1] > k:
            kth = np.partition(d, k - 1, axis=1)[:, k - 1]
            near = np.where(kth < np.finfo(float).max, kth, 0.0)
            limit = np.where(kth < np.finfo(float).max, np.minimum(limit, _limit(_keys(near))), limit)
            close = d <= limit[:, None]
        if close.sum() > 8 * k * len(at):   # many ties: by sorted columns
            f = _k_best(np.arange(len(at)), ib, d, k)
            q, nbr, dist, key = (f[c].to_numpy() for c in ("q", "nbr", "dist", "key"))
        else:
            q, c = np.nonzero(close)
            nbr, dist = ib[c], d[q, c]
            key = _keys(dist)
        if not len(q):
            return
        u, q = np.unique(q, return_inverse=True)
        rows = at[u]
        q = np.concatenate([np.repeat(np.arange(len(u)), k), q])
        key = np.concatenate([self.key[rows].ravel(), key])
        nbr = np.concatenate([self.nbr[rows].ravel(), nbr])
        dist = np.concatenate([self.dist[rows].ravel(), dist])
        order = np.lexsort((nbr, key, q))
        first = np.searchsorted(q[order], np.arange(len(u)))
        take = order[first[:, None] + np.arange(k)]   # k are there already, be they empty
        self.key[rows], self.nbr[rows], self.dist[rows] = key[take], nbr[take], dist[take]
        full = self.key[rows, -1] < np.iinfo(np.int64).max
        self.limit[rows[full]] = _limit(self.key[rows[full], -1])

    def frame(self) -> pd.DataFrame:
        x, y = np.nonzero(np.isfinite(self.dist))
        return pd.DataFrame({"q": self.ids[x], "nbr": self.nbr[x, y], "dist": self.dist[x, y], "key": self.key[x, y]})


def _limit(key: np.ndarray) -> np.ndarray:
    """Distances up to which a key may be this one or less."""
    return (key + 0.5) * 1e-9 + 1e-15 * np.maximum(1, np.abs(key) * 1e-9)


def _keys(d: np.ndarray) -> np.ndarray:
    """Distances as integers of 1e-9: the one sort key of all kernels."""
    return np.rint(d * 1e9).astype(np.int64)


def _k_best(ia: np.ndarray, ib: np.ndarray, d: np.ndarray, k: int) -> pd.DataFrame:
    """The k smallest columns by (key, id) of every row of a block pair, however many tie."""
    by_id = np.argsort(ib, kind="stable")
    ib, d = ib[by_id], d[:, by_id]
    kk = min(k, d.shape[1])
    key = np.where(np.isfinite(d), _keys(np.where(np.isfinite(d), d, 0)), np.iinfo(np.int64).max)
    first = np.argsort(key, axis=1, kind="stable")[:, :kk]   # stable on columns in id order
    qi = np.repeat(np.arange(len(ia)), kk)
    cj = first.ravel()
    keep = np.isfinite(d[qi, cj])
    qi, cj = qi[keep], cj[keep]
    return pd.DataFrame({"q": ia[qi], "nbr": ib[cj], "dist": d[qi, cj], "key": key[qi, cj]})


def lsh_candidates(df: DataFrame, id_col: str = "id", vec_col: str = "embedding",
                   max_dist: float = 0.05, bits: int = 10, num_tables: int = 16, seed: int = 42,
                   block_rows: int = 1024) -> DataFrame:
    """Scale path of C1 - close pairs only, through sign signatures.

    Each of ``num_tables`` tables signs a vector with ``bits`` random
    hyperplanes (all bits must agree), and one agreeing table is enough. Rows
    meet on (table, signature) only: with b bits a pair at angle t agrees in
    a table with probability ``(1 - t/pi) ** b``, so far pairs meet in about
    ``num_tables * 2 ** -bits`` of the tables. A full bucket is cut into blocks of ``block_rows``
    whose pairs go through the block kernel, so a hot signature is spread
    over tasks. The result is a subset of :func:`all_pairs` restricted to
    ``dist <= max_dist`` (approximate recall, exact distances).
    """
    shape: dict[int, np.ndarray] = {}
    rows = df.select(F.col(id_col).alias("id"), as_double_array(vec_col).alias("v"))

    def sign(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy())
            if x.shape[1] not in shape:
                shape[x.shape[1]] = np.random.default_rng(seed).normal(size=(x.shape[1], num_tables * bits))
            on = (x @ shape[x.shape[1]] > 0).reshape(len(x), num_tables, bits)
            code = (on * (1 << np.arange(bits, dtype=np.int64))).sum(2)
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), num_tables), "v": np.repeat(
                pdf["v"].to_numpy(), num_tables), "tab": np.tile(np.arange(num_tables), len(x)),
                "sig": code.ravel()})

    signed = rows.mapInPandas(sign, "id bigint, v array<double>, tab int, sig bigint")
    full = signed.groupBy("tab", "sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    signed = (signed.join(full, ["tab", "sig"])
              .withColumn("blk", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block_rows)).cast("int")))
    blocks = signed.groupBy("tab", "sig", "blk").agg(
        F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("vecs"))
    side = lambda s: blocks.select("tab", "sig", *[F.col(c).alias(f"{s}_{c}") for c in ("blk", "ids", "vecs")])
    joined = side("a").join(side("b"), ["tab", "sig"]).where("a_blk <= b_blk")

    def kernel(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ia, va = _flat(row.a_ids, row.a_vecs)
                ib, vb = _flat(row.b_ids, row.b_vecs)
                d = _pairwise(va, vb, "half_cosine")
                ii, jj = np.nonzero((d <= max_dist) & ((ia[:, None] < ib[None, :]) if row.a_blk == row.b_blk
                                                       else (ia[:, None] != ib[None, :])))
                gi, gj = ia[ii], ib[jj]
                yield pd.DataFrame({"i": np.minimum(gi, gj), "j": np.maximum(gi, gj), "dist": d[ii, jj]})

    cand = joined.mapInPandas(kernel, "i bigint, j bigint, dist double")
    return cand.groupBy("i", "j").agg(F.min("dist").alias("dist"))


def pairs_between(a_df: DataFrame, b_df: DataFrame, id_col: str = "id", vec_col: str = "embedding",
                  metric: str = "half_cosine", max_dist: float | None = None,
                  block_rows: int = 1024) -> DataFrame:
    """All pairs ``(a, b)`` across two tables (ids never compared with themselves),
    optionally only those within ``max_dist``; output ``(i, j, dist)`` with i < j."""
    na, a_sides = _layout(a_df, block_rows)
    nb, b_sides = _layout(b_df, block_rows)
    cells = cross_cells(_blocks(a_df, id_col, vec_col, na), _blocks(b_df, id_col, vec_col, nb), a_sides, b_sides)

    def kernel(frames):
        for _, rows in _by_cell(frames):
            held = []
            for row in rows:
                if row.role == 0:
                    held.append(_unpack(row))
                    continue
                ib, vb = _unpack(row)
                for ia, va in held:
                    d = _pairwise(va, vb, metric)
                    keep = np.ones(d.shape, dtype=bool) if max_dist is None else d <= max_dist
                    keep &= ia[:, None] != ib[None, :]
                    ii, jj = np.nonzero(keep)
                    gi, gj = ia[ii], ib[jj]
                    yield pd.DataFrame({"i": np.minimum(gi, gj), "j": np.maximum(gi, gj), "dist": d[ii, jj]})

    return cells.mapInPandas(kernel, "i bigint, j bigint, dist double")


HIT_RUN = 2_000_000   # hit keys a pass over the block pairs carries (24 bytes each)


def pair_hit_ranks(df: DataFrame, truth: DataFrame, id_col: str = "id", vec_col: str = "embedding",
                   metric="half_cosine", block_rows: int = 1024, repeats: bool = False) -> DataFrame:
    """Ranks of the truth pairs inside the full all-pairs ranking, without
    materialising or sorting the n(n-1)/2 pairs.

    The ranking order is ``(round(dist, 9), i, j)`` ascending (as
    :func:`tidemark.operators.audit.near_duplicate_audit`). Pass 1 computes the
    truth pairs' distances in the same block kernel (same NumPy product, so
    identical keys). Pass 2 gives every cell's kernel sorted hit keys and
    emits, per hit key interval, how many pairs of that cell fall in it;
    summed bins and their running sum give each hit's rank. The hits are the
    stated query set: they are taken in runs of at most ``HIT_RUN`` keys, one
    pass over the block pairs for each, the same for every size of truth.
    Truth pairs with an id that is not in the table are no hits; of rows that
    repeat an id one is a hit, with ``repeats`` each is. ``metric`` may be a
    function of two blocks. Output ``(i, j, dist, rank, n_items)``.
    """
    from tidemark.operators.ranking import freeze, global_rank

    spark = df.sparkSession
    t = truth.select(F.least("id", "id2").alias("i"), F.greatest("id", "id2").alias("j")).distinct()
    nb, sides = _layout(df, block_rows)
    # both passes read the same blocks, so a pair has the same distance in both
    cells = pair_cells(freeze(_blocks(df, id_col, vec_col, nb)), sides)
    measure = _counting(metric)
    # pass 1: distances of the truth pairs, in the cell of their blocks
    blk = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(nb)).cast("int")
    s1, s2 = F.pmod("_b1", F.lit(sides)), F.pmod("_b2", F.lit(sides))
    asked = (t.withColumn("_b1", blk("i")).withColumn("_b2", blk("j"))
             .withColumn("cell", (F.least(s1, s2) * sides + F.greatest(s1, s2)).cast("long"))
             .groupBy("cell", F.least("_b1", "_b2").alias("blk"), F.greatest("_b1", "_b2").alias("blk2"))
             .agg(F.collect_list("i").alias("ids"), F.collect_list("j").alias("ids2")).withColumn("role", F.lit(-1)))

    def hit_kernel(frames):
        for _, rows in _by_cell(frames):
            held, wanted = [], {}
            for row in rows:
                if row.role == -1:
                    wanted[int(row.blk), int(row.blk2)] = tuple(np.asarray(x, dtype=np.int64) for x in (row.ids, row.ids2))
                elif row.role == 0:
                    held.append([row, None])
                else:
                    there, met = {a.blk for a, _ in held}, None
                    for part in held:
                        a = part[0]
                        if a.blk > row.blk and row.blk in there:
                            continue
                        key = (min(a.blk, row.blk), max(a.blk, row.blk))
                        if key in wanted:
                            if part[1] is None:
                                ids, vecs = _unpack(a)
                                part[1] = ids, measure.prepared(vecs)
                            if met is None:
                                ids, vecs = _unpack(row)
                                met = ids, measure.prepared(vecs)
                            yield hits_of(*part[1], *met, a.blk == row.blk, *wanted[key])

    def hits_of(ia, va, ib, vb, same_block, x, y):
        if repeats and any(len(np.unique(ids)) < len(ids) for ids in (ia, ib)):
            ii, jj = _all_places(ia, ib, x, y, same_block)
            return _hits(np.minimum(ia[ii], ib[jj]), np.maximum(ia[ii], ib[jj]), measure.of(va, vb, ii, jj))
        # each truth pair one way round or the other, if both ids are here
        x, y = np.r_[x, y], np.r_[y, x]
        pa, pb = _places(ia, x), _places(ib, y)
        ok = (pa >= 0) & (pb >= 0)
        if same_block:
            ok &= pa < pb   # the half of a diagonal block that the counts read
        x, y = x[ok], y[ok]
        return _hits(np.minimum(x, y), np.maximum(x, y), measure.of(va, vb, pa[ok], pb[ok]))

    # written before they are ranked: ranking samples its input first, which would run the kernel twice
    hits = freeze(_numbered(cells.unionByName(asked, allowMissingColumns=True), sides).mapInPandas(
        hit_kernel, "i bigint, j bigint, dist double, key bigint"))
    ranked = freeze(global_rank(hits, ["key", "i", "j"], "_h"))
    n_hits = ranked.count()

    # pass 2: per cell, histogram of pair keys over the hit-key intervals
    def count_kernel(frames, run_keys):
        krd, ki, kj = run_keys.value
        before = _HitOrder(krd, ki, kj)
        far = _limit(krd[-1:])[0]   # most pairs are farther than the last hit and need no search
        cnt = np.zeros(len(krd) + 1, dtype=np.int64)
        for (ba, ia, va), (bb, ib, vb) in _prepared_pairs(frames, measure):
            at, d = measure.within(va, vb, far)
            n = len(ia) * (len(ia) - 1) // 2 if ba == bb else len(ia) * len(ib)
            once = _once(at, len(ib), ba == bb)
            at, rd = at[once], _keys(d[once])
            if len(at):   # bin = number of hit keys strictly below the pair's (key, i, j)
                gi, gj = ia[at // len(ib)], ib[at % len(ib)]
                cnt += np.bincount(before(rd, np.minimum(gi, gj), np.maximum(gi, gj)), minlength=len(cnt))
            cnt[-1] += n - len(at)
        nz = np.flatnonzero(cnt)
        yield pd.DataFrame({"bin": nz.astype(np.int64), "c": cnt[nz]})

    n_items = df.agg(F.count(F.lit(1)).alias("n")).select(F.expr("(n * (n - 1)) div 2").alias("n_items"))
    kind = "i bigint, j bigint, dist double, rank bigint"
    out = [] if n_hits else [spark.createDataFrame([], kind)]
    for lo in range(0, n_hits, HIT_RUN):
        hk = (ranked.where((F.col("_h") > lo) & (F.col("_h") <= lo + HIT_RUN)).orderBy("_h")
              .select("i", "j", "dist", "key").toPandas())   # at most HIT_RUN rows
        keys = spark.sparkContext.broadcast(tuple(hk[c].to_numpy(np.int64) for c in ("key", "i", "j")))
        bins = (_numbered(cells, sides).mapInPandas(lambda it, keys=keys: count_kernel(it, keys), "bin bigint, c bigint")
                .groupBy("bin").agg(F.sum("c").alias("c")).toPandas())
        cnt = np.zeros(len(hk) + 1, dtype=np.int64)
        cnt[bins["bin"].to_numpy()] = bins["c"].to_numpy()
        # hit t lies in its own bin, so its 1-based rank is the number of pairs in bins 0..t
        hk["rank"] = np.cumsum(cnt)[: len(hk)]
        if repeats:   # equal triples share the first one's bin; they take its last places in turn
            hk["rank"] -= hk.groupby(["key", "i", "j"]).cumcount(ascending=False)
        part = spark.createDataFrame(hk[["i", "j", "dist", "rank"]].astype(
            {"i": "int64", "j": "int64", "dist": "float64", "rank": "int64"}), kind)
        out.append(part if n_hits <= HIT_RUN else freeze(part))
    res = out[0]
    for part in out[1:]:
        res = res.unionByName(part)
    return res.crossJoin(F.broadcast(n_items))   # one row


class _HitOrder:
    """How many of the sorted hits ``(key, i, j)`` lie strictly before each of some pairs."""

    def __init__(self, key, i, j):
        self.key, self.order = key, _triples(key, i, j)
        self.keys, self.i = np.unique(key), np.unique(i)
        self.row = np.searchsorted(self.keys, key) * len(self.i) + np.searchsorted(self.i, i)   # of (key, i) in order

    def __call__(self, key, i, j):
        bins = np.searchsorted(self.key, key, side="left")
        tie = np.flatnonzero(self.key[np.minimum(bins, len(self.key) - 1)] == key)
        if len(tie):   # by i among the hits of the same key, by j among those of the same key and i
            k, ti = key[tie], i[tie]
            at = np.searchsorted(self.i, ti)
            row = np.searchsorted(self.keys, k) * len(self.i) + at
            bins[tie] = np.searchsorted(self.row, row, side="left")
            first = np.minimum(bins[tie], len(self.row) - 1)
            same = np.flatnonzero((at < len(self.i)) & (self.i[np.minimum(at, len(self.i) - 1)] == ti)
                                  & (bins[tie] < len(self.row)) & (self.row[first] == row))
            bins[tie[same]] = np.searchsorted(self.order, _triples(k[same], ti[same], j[tie[same]]), side="left")
        return bins


BINS = 1 << 16   # of the distances between 0 and 1, in the first pass of pair_order_statistics
BELOW = -(1 << 62)


def pair_order_statistics(df: DataFrame, places: list[int], id_col: str = "id", vec_col: str = "embedding",
                          metric="half_cosine", block_rows: int = 1024) -> dict[int, float]:
    """Exact distances at 0-based ``places`` of all pairs in order of distance, without writing the pairs.

    Three passes over the block pairs. The first counts distances in single precision in ``BINS`` bins: that moves no
    distance by more than the measure's margin, nor the one at a place, so each place gets a bracket of keys (units of
    1e-9) that holds it. The second measures the pairs in the brackets exactly and counts their keys, the third the
    values of the keys found. For distances between 0 and 1; a NaN comes before all others.
    """
    from tidemark.operators.ranking import freeze

    nb, sides = _layout(df, block_rows)
    cells = pair_cells(freeze(_blocks(df, id_col, vec_col, nb)), sides)
    measure = _counting(metric)

    def counted(of, kind):
        """Rows ``(part, x, c)`` of ``of(a, b, rough distances)``, summed."""
        def kernel(frames):
            acc, size, margin = [], 0, 0.0
            for (ba, ia, va), (bb, _, vb) in _prepared_pairs(frames, measure):
                d = measure.rough(va, vb)
                if ba == bb:
                    d[np.tril_indices(len(ia))] = np.inf   # a block's pairs with itself once
                margin = measure.margin(va)
                for part, x, c in of(va, vb, d, margin):
                    acc.append(pd.DataFrame({"part": part, "x": x, "c": c}))
                    size += len(x)
                if size >= 1_000_000:
                    acc = [pd.concat(acc).groupby(["part", "x"], as_index=False, dropna=False).sum()]
                    size = len(acc[0])
            if acc:
                yield pd.concat(acc).groupby(["part", "x"], as_index=False, dropna=False).sum()
            if margin and kind == "double":
                yield pd.DataFrame({"part": [-1], "x": [margin], "c": [0]})
        got = _numbered(cells, sides).mapInPandas(kernel, f"part int, x {kind}, c long").groupBy("part", "x").agg(
            F.sum("c").alias("c"))
        got = got.toPandas()   # bins, the keys of a bracket, or the values of a few keys
        return got.sort_values("x", na_position="first"), got["x"].where(got["part"] == -1).max()

    def bins_of(va, vb, d, margin):
        np.maximum(d, 0, out=d)
        if np.isnan(d.min()):
            d[np.isnan(d)] = 0
        at = (np.minimum(d, 2) * BINS).astype(np.int32).ravel()
        c = np.bincount(at, minlength=BINS + 2)[: 2 * BINS]
        x = np.flatnonzero(c)
        yield 0, x.astype(np.float64), c[x]

    def exact(va, vb, d, low, high):
        """Exact distances of the pairs whose rough one isn't outside ``low`` and ``high``."""
        at = np.flatnonzero(~((d.ravel() < low) | (d.ravel() > high)))
        return measure.of(va, vb, *np.divmod(at, d.shape[1])) if len(at) else np.zeros(0)

    def keys_of(d):
        return np.where(np.isnan(d), BELOW + 1, _keys(np.where(np.isnan(d), 0, d)))

    table, margin = counted(bins_of, "double")
    table = table[table["part"] == 0]
    margin = 0.0 if not margin > 0 else float(margin)
    ends = np.cumsum(table["c"].to_numpy())
    near = {p: float(table["x"].iloc[int(np.searchsorted(ends, p, side="right"))]) / BINS for p in places}
    # the place's rough distance lies in its bin, its exact one no farther off than the margin
    lows = {p: BELOW if x == 0 else math.floor((x - 2 * margin) * 1e9) - 1 for p, x in near.items()}
    highs = {p: math.ceil((x + 1 / BINS + 2 * margin) * 1e9) + 1 for p, x in near.items()}
    brackets = sorted({(lows[p], highs[p]) for p in places})

    def keys_inside(va, vb, d, margin):
        for part, (low, high) in enumerate(brackets):
            sure = max(low * 1e-9 - 1e-9 - 2 * margin, -1e9)
            e = keys_of(exact(va, vb, d, sure, high * 1e-9 + 1e-9 + 2 * margin))
            below = np.count_nonzero(d < sure) + np.count_nonzero(e < low)
            x, c = np.unique(e[(e >= low) & (e <= high)], return_counts=True)
            yield part, np.r_[BELOW, x], np.r_[below, c]

    table, _ = counted(keys_inside, "long")
    found = {}
    for p in places:
        t = table[table["part"] == brackets.index((lows[p], highs[p]))]
        ends = np.cumsum(t["c"].to_numpy())
        i = int(np.searchsorted(ends, p, side="right"))
        found[p] = int(t["x"].iloc[i]), p - int(ends[i - 1])
    keys = sorted({k for k, _ in found.values()})

    def values_of(va, vb, d, margin):
        for part, key in enumerate(keys):
            sure = -1e9 if key < 0 else key * 1e-9 - 1e-9 - 2 * margin
            e = exact(va, vb, d, sure, max(key, 0) * 1e-9 + 1e-9 + 2 * margin)
            x, c = np.unique(e[keys_of(e) == key], return_counts=True)
            yield part, x, c

    table, _ = counted(values_of, "double")
    out = {}
    for p, (key, rest) in found.items():
        t = table[table["part"] == keys.index(key)]
        out[p] = float(t["x"].iloc[int(np.searchsorted(np.cumsum(t["c"].to_numpy()), rest, side="right"))])
    return out


def _hits(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"i": i, "j": j, "dist": d, "key": _keys(d)})


def _all_places(ia: np.ndarray, ib: np.ndarray, x: np.ndarray, y: np.ndarray, same_block: bool):
    """Places ``(in ia, in ib)`` of all rows of the wanted pairs, one way round or the other."""
    a, b = pd.DataFrame({"p": ia, "ii": np.arange(len(ia))}), pd.DataFrame({"q": ib, "jj": np.arange(len(ib))})
    want = pd.DataFrame({"p": np.r_[x, y], "q": np.r_[y, x]}).drop_duplicates()
    got = want.merge(a, on="p").merge(b, on="q")
    if same_block:
        got = got[got["ii"] < got["jj"]]
    return got["ii"].to_numpy(), got["jj"].to_numpy()


def _places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted id among ``ids``; -1 where it is missing."""
    order = np.argsort(ids, kind="stable")
    at = np.minimum(np.searchsorted(ids[order], wanted), len(ids) - 1)
    return np.where(ids[order][at] == wanted, order[at], -1)


def _triples(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Records that sort by (a, b, c)."""
    out = np.empty(len(a), dtype=[("a", "<i8"), ("b", "<i8"), ("c", "<i8")])
    out["a"], out["b"], out["c"] = a, b, c
    return out


def knn_by(queries: DataFrame, base: DataFrame, by: list[str], k: int = 5, metric: str = "l2",
           block_rows: int = 1024) -> DataFrame:
    """kNN inside groups: every query row meets only the base rows of its own
    ``by`` group (e.g. many experiment runs in one job, keyed by run).

    Blocks and cells are formed per group, so no run sees another run's rows
    and the whole grid of runs is one job. Output
    ``(by..., q, nbr, dist, nn_rank)``.
    """
    by = list(by)
    sizes = lambda df: (df.groupBy(*by).agg(F.count(F.lit(1)).alias("_c"))
                        .agg(F.max("_c"), F.count(F.lit(1))).first())
    (most_q, runs), (most_b, _) = sizes(queries), sizes(base)
    nq, q_sides = _layout(queries, block_rows, max(runs, 1), most_q or 0)
    nb, b_sides = _layout(base, block_rows, max(runs, 1), most_b or 0)
    cells = cross_cells(_blocks(queries, "id", "embedding", nq, by=by), _blocks(base, "id", "embedding", nb, by=by),
                        q_sides, b_sides, by)

    def kernel(frames):
        for key, rows in _by_cell(frames, (*by, "cell")):
            for frame in _nearest_in_cell(rows, k, metric, False):
                for c, v in zip(by, key):
                    frame[c] = v
                yield frame[[*by, "q", "nbr", "dist", "key"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields if f.name in by)
    cand = cells.mapInPandas(kernel, f"{schema}, q bigint, nbr bigint, dist double, key bigint")
    w = Window.partitionBy(*by, "q").orderBy("key", "nbr")
    return (cand.withColumn("nn_rank", F.row_number().over(w)).where(F.col("nn_rank") <= k).drop("key")
            .withColumn("nn_rank", F.col("nn_rank").cast("int")))
