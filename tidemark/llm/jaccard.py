"""N-gram Jaccard join of documents by grouped prefixes, down to classes of linked documents.

A document's set holds its distinct five-word shingles (64-bit hashes of
A-Z-lower-cased words). Two documents link when the Jaccard similarity of
their sets is at least ``num / den``. The answer is one row per document
with its class, so no copy is paired with every other copy.

1. **Sets.** Documents with equal sets are one *node* (64-bit hash of the
   sorted set): exact copies, however many, meet no join.
2. **Frequencies.** A shingle that only one node holds can't be shared. The
   map tasks send their shingles in blobs, one per hash bucket, and a
   shingle which two nodes of a batch hold only once, so a frequent shingle
   costs an entry per batch. The buckets send back how many nodes hold it, and
   the shared shingles meet at their nodes, in blobs again; no text is read
   twice for them or shuffled. Nodes with too few shared shingles to reach
   the threshold have no link and leave here. A shingle is known by its
   bucket and 40 more bits of its hash.
3. **Prefix groups.** Shingles are ordered rarest first. Two linked sets
   share one of the first ``n - ceil(t*n) + 1``. Nodes of the same size and
   the same prefix are collapsed into one group, which is posted once.
4. **Stars.** In each posting list a few rounds verify every group against
   one pivot of the list. Verified links are united, so that what remains
   to be compared are pairs of different classes. Members of a group can be
   of several classes; from the second round on a group is posted once for
   each of them, by the smallest member of that class.
5. **Remaining pairs.** Parts of groups (their members of one class) that are
   of different classes, share a prefix shingle and pass the size and
   position filters are expanded into their members, and every such pair is
   verified. Only pairs already in one class are left out, so no link
   between classes is lost.

Defined cases: null or empty texts have an empty set, link with nothing and
are their own class. Repeated rows belong to the same node. Rows with a null
id take part; their class carries the smallest id that is not null (null if
there is none). Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import (Scratch, WordHasher, nullable, placed, rows_at, rows_at_once, shingle_hashes,
                                 whole, words)
from tidemark.llm.components import connected

BATCH = 500_000       # shingles a map task holds before it sends them
BUCKET = 2_000_000    # shingles meant to meet in one bucket
STARS = 3             # rounds of step 4; more rounds change the cost, not the result
LOW = np.uint64((1 << 24) - 1)
SENT = ["bucket", "batch", "nodes", "counts", "hashes", "anon", "many", "ns"]
COUNTED = ["kind", "key", "at", "nodes", "counts", "ids", "dfs", "ns"]


def _sets(texts, size: int, hasher: WordHasher):
    from xxhash import xxh3_64_intdigest

    for t in texts:
        s = np.unique(shingle_hashes(hasher(words(t)), size))
        yield s, np.int64(np.uint64(xxh3_64_intdigest(s.tobytes())).view(np.int64))


def document_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """``(doc_id, n, node, part, pos)`` per row; node is null for an empty set. For part and pos see ``placed``."""
    def run(frames: Iterator[pd.DataFrame]):
        hasher = WordHasher()
        for pdf in frames:
            got = [(len(s), k) for s, k in _sets(pdf["text"], size, hasher)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": np.array([g[0] for g in got], np.int64),
                                "node": pd.array([g[1] if g[0] else None for g in got], "Int64"),
                                "part": pdf["part"], "pos": pdf["pos"]})

    out = placed(docs, whole("doc_id"), "text").mapInPandas(run, "doc_id long, n long, node long, part long, pos long")
    return out.withColumn("doc_id", nullable("doc_id"))


def _pack5(x: np.ndarray) -> bytes:
    """The low 40 bits of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack5(blobs) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def _cat(blobs, kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _send(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """Blobs of shingles by bucket, and one row per batch (in a negative bucket) that stays with the batch.

    A shingle is known by its bucket and 40 bits. One that a single node of
    the batch holds goes to its bucket with the node; one that several hold
    goes there once, with their number, and who they are stays in the batch's
    own row.
    """
    def flush(held: dict, batch: int):
        nodes = np.fromiter(held.keys(), np.int64, len(held))
        sets = list(held.values())
        lens = np.array([len(s) for s in sets], np.int32)
        h = np.concatenate(sets)
        key = ((h & LOW) % np.uint64(buckets)) << np.uint64(40) | h >> np.uint64(24)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], np.repeat(np.arange(len(sets)), lens)[order]
        twice = np.r_[False, (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])]
        key, owner = key[~twice], owner[~twice]
        new = np.r_[True, key[1:] != key[:-1]]
        run = np.cumsum(new) - 1
        holders = np.bincount(run)
        common = (holders > 1)[run]
        # held by several: once, with the number of holders
        shared, many = key[new & common], holders[holders > 1].astype(np.int32)
        index = (np.cumsum(holders > 1) - 1)[run[common]]
        by_owner = np.argsort(owner[common], kind="stable")
        own = np.bincount(owner[common], minlength=len(nodes)).astype(np.int32)
        rows = [(-1 - batch, batch, nodes.tobytes(), own.tobytes(), b"", shared.tobytes(),
                 index[by_owner].astype(np.int32).tobytes(), lens.tobytes())]
        # held by one: in runs of a node
        key, owner = key[~common], owner[~common]
        bucket = (key >> np.uint64(40)).astype(np.int64)
        order = np.argsort(bucket << 32 | owner, kind="stable")
        key, owner, bucket = key[order], owner[order], bucket[order]
        bucket_s = (shared >> np.uint64(40)).astype(np.int64)
        present = np.unique(np.concatenate([bucket, bucket_s]))
        for i, lo, hi, lo_s, hi_s in zip(present.tolist(), np.searchsorted(bucket, present),
                                         np.searchsorted(bucket, present, "right"), np.searchsorted(bucket_s, present),
                                         np.searchsorted(bucket_s, present, "right")):
            o = owner[lo:hi]
            first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]][: len(o)])
            reps = np.diff(np.r_[first, len(o)]).astype(np.int32)
            rows.append((i, batch, nodes[o[first]].tobytes(), reps.tobytes(), _pack5(key[lo:hi]),
                         _pack5(shared[lo_s:hi_s]), many[lo_s:hi_s].tobytes(), b""))
        return pd.DataFrame(rows, columns=SENT)

    def run(frames: Iterator[pd.DataFrame]):
        from pyspark import TaskContext

        hasher, held, total, batch = WordHasher(), {}, 0, TaskContext.get().partitionId() << 24
        for pdf in frames:
            for s, node in _sets(pdf["text"], size, hasher):
                if len(s) and node not in held:
                    held[int(node)] = s
                    total += len(s)
                if total >= BATCH:
                    yield flush(held, batch)
                    held, total, batch = {}, 0, batch + 1
        if held:
            yield flush(held, batch)

    return docs.select("text").mapInPandas(run, "bucket long, batch long, nodes binary, counts binary, hashes binary, "
                                                "anon binary, many binary, ns binary")


def _count_bucket(pdf: pd.DataFrame, slices: int) -> pd.DataFrame:
    """How many nodes hold each shingle of a bucket: to the nodes (0) and back to the batches (1).

    The row that a batch keeps passes through (2).
    """
    if pdf["bucket"].iloc[0] < 0:
        r = pdf.iloc[0]
        return pd.DataFrame([(2, r["batch"], 0, r["nodes"], r["counts"], r["anon"], r["many"], r["ns"])], columns=COUNTED)
    bucket = int(pdf["bucket"].iloc[0])
    node = np.repeat(_cat(pdf["nodes"], np.int64), _cat(pdf["counts"], np.int32))
    alone, anon, many = _unpack5(pdf["hashes"]), _unpack5(pdf["anon"]), _cat(pdf["many"], np.int32)
    found, at = np.unique(np.concatenate([alone, anon]), return_inverse=True)
    at, back = at[: len(alone)], at[len(alone) :]
    order = np.lexsort((node, at))
    node, at = node[order], at[order]
    fresh = np.r_[True, (at[1:] != at[:-1]) | (node[1:] != node[:-1])][: len(at)]  # a node may be in several batches
    node, at = node[fresh], at[fresh]
    df = np.bincount(at, minlength=len(found)) + np.bincount(back, many, minlength=len(found)).astype(np.int64)
    rows, end = [], 0
    for batch, blob in zip(pdf["batch"], pdf["many"]):
        begin, end = end, end + len(blob) // 4
        if begin < end:
            rows.append((1, batch, bucket, b"", b"", b"", df[back[begin:end]].astype(np.int32).tobytes(), b""))
    shared = df[at] > 1
    node, at = node[shared], at[shared]
    part = np.mod(node, slices)
    order = np.lexsort((node, part))
    node, at, part = node[order], at[order], part[order]
    ids = (np.uint64(bucket) << np.uint64(40) | found[at]).astype(np.uint64)
    dfs = np.minimum(df[at], np.iinfo(np.int32).max).astype(np.int32)
    present = np.unique(part)
    for i, lo, hi in zip(present.tolist(), np.searchsorted(part, present), np.searchsorted(part, present, "right")):
        who, reps = np.unique(node[lo:hi], return_counts=True)
        rows.append((0, i, 0, who.tobytes(), reps.astype(np.int32).tobytes(), ids[lo:hi].tobytes(),
                     dfs[lo:hi].tobytes(), b""))
    return pd.DataFrame(rows, columns=COUNTED)


def _answer_batch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one batch: each node with those of its shingles that others of the batch hold, and their counts."""
    kept = pdf[pdf["kind"] == 2].iloc[0]
    dfs = _cat(pdf[pdf["kind"] == 1].sort_values("at")["dfs"], np.int32)
    shared, index = np.frombuffer(kept["ids"], np.uint64), np.frombuffer(kept["dfs"], np.int32)
    nodes, own = np.frombuffer(kept["nodes"], np.int64), np.frombuffer(kept["counts"], np.int32)
    if len(dfs) != len(shared):
        raise ValueError("counts of a batch are incomplete")
    cut = np.cumsum(own)[:-1]
    return pd.DataFrame({
        "node": nodes, "nodes": [n.tobytes() for n in nodes], "counts": [n.tobytes() for n in own],
        "ids": [x.tobytes() for x in np.split(shared[index], cut)],
        "dfs": [x.tobytes() for x in np.split(dfs[index], cut)],
        "ns": [n.tobytes() for n in np.frombuffer(kept["ns"], np.int32)]})


def _sets_of_slice(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Nodes of a slice that may have a link, with their shared shingles, rarest first."""
    of = np.repeat(_cat(pdf["nodes"], np.int64), _cat(pdf["counts"], np.int32))
    ids, dfs = _cat(pdf["ids"], np.int64), _cat(pdf["dfs"], np.int32)
    sized = pdf[pdf["ns"].str.len() > 0]
    nodes, n = _cat(sized["nodes"], np.int64), _cat(sized["ns"], np.int32).astype(np.int64)
    order = np.argsort(nodes)
    nodes, n = nodes[order], n[order]
    order = np.lexsort((ids, dfs, of))
    of, ids = of[order], ids[order]
    fresh = np.r_[True, (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])][: len(of)]  # from a bucket and from a batch
    of, ids = of[fresh], ids[fresh]
    lo, hi = np.searchsorted(of, nodes), np.searchsorted(of, nodes, "right")
    stays = np.flatnonzero(((hi - lo) * den >= n * num) & (hi > lo))
    return pd.DataFrame({"node": nodes[stays], "n": n[stays], "hs": pd.Series([ids[lo[k] : hi[k]] for k in stays], dtype=object),
                         "alone": n[stays] - (hi - lo)[stays]})


def shared_sets(docs: DataFrame, rows: DataFrame, scratch: Scratch, num: int, den: int, size: int) -> DataFrame:
    """``(node, n, hs, alone)`` of nodes with enough shared shingles for any link at all (never too few).

    ``hs`` are the shingles that other nodes hold too, rarest first; ``alone``
    is the number of the others. Texts stay where they lie.
    """
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = min(max(4, math.ceil(total / BUCKET)), 1 << 24)
    counted = scratch.write(_send(docs, size, buckets).groupBy("bucket").applyInPandas(
        lambda pdf: _count_bucket(pdf, buckets), "kind int, key long, at long, nodes binary, counts binary, "
                                                 "ids binary, dfs binary, ns binary"), "counted")
    own = counted.where("kind > 0").groupBy("key").applyInPandas(
        _answer_batch, "node long, nodes binary, counts binary, ids binary, dfs binary, ns binary")
    # any batch that holds a copy of a node knows all that the buckets don't
    own = own.groupBy("node").agg(F.first(F.struct("nodes", "counts", "ids", "dfs", "ns")).alias("x"))
    own = own.select(F.pmod("node", F.lit(buckets)).alias("key"), "x.*")
    named = counted.where("kind = 0").select("key", "nodes", "counts", "ids", "dfs", "ns")
    sets = named.unionByName(own).groupBy("key").applyInPandas(
        lambda pdf: _sets_of_slice(pdf, num, den), "node long, n long, hs array<long>, alone long")
    sets = scratch.write(sets, "sets")
    scratch.drop("counted")
    return sets


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the node pairs ``(u, v)`` that link, by their whole sets."""
    a = sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("hs").alias("hu"))
    b = sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("hs").alias("hv"))
    both = F.size(F.array_intersect("hu", "hv")).cast("long")
    return (pairs.join(a, "u").join(b, "v").withColumn("i", both)
            .where(F.col("i") * den >= (F.col("nu") + F.col("nv") - F.col("i")) * num).select("u", "v"))


def links(docs: DataFrame, rows: DataFrame, scratch: Scratch, num: int = 3, den: int = 4,
          size: int = 5) -> DataFrame:
    """``(node, comp)`` for nodes that link with another node."""
    sets = shared_sets(docs, rows, scratch, num, den, size)
    prefix = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - F.col("alone")
    sets_p = sets.withColumn("p", F.slice("hs", 1, F.greatest(prefix, F.lit(0)).cast("int")))
    group = scratch.write(sets_p.groupBy("n", "alone", "p").agg(
        F.min("node").alias("g"), F.collect_list("node").alias("members")), "groups")
    member = group.select("g", F.explode("members").alias("node"))
    post = scratch.write(group.select("g", "n", "alone", F.posexplode("p").alias("pos", "h"))
                         .withColumn("pos", F.col("pos") + F.col("alone")), "posts")
    edges = member.where("g != node").select(F.col("g").alias("u"), F.col("node").alias("v"))
    edges = scratch.write(_verified(edges, sets, num, den), "edges-0")
    comp = None
    size_ok = lambda a, b: ((F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num))

    def classed(c):  # members with their classes
        return member.join(c, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def labelled(c, name):  # posts of each class in a group, by its smallest member r
        if c is None:
            return post.withColumn("comp", F.col("g")).withColumn("r", F.col("g"))
        parts = classed(c).groupBy("g", "comp").agg(F.min("node").alias("r"))
        return post.join(scratch.write(parts, name), "g")

    for k in range(1, STARS + 1):
        lab = labelled(comp, f"parts-{k}")
        pivot = lab.groupBy("h").agg(
            F.min_by(F.struct("r", "n", "comp"), F.struct("alone", F.xxhash64("r", F.lit(k)))).alias("q"))
        cand = (lab.join(pivot, "h").where((F.col("comp") != F.col("q.comp")) & size_ok("n", "q.n"))
                .groupBy("r", F.col("q.r").alias("q")).agg(F.count(F.lit(1)).alias("votes"))
                .groupBy("r").agg(F.max_by("q", F.struct("votes", "q")).alias("q")))
        more = _verified(cand.select(F.col("q").alias("u"), F.col("r").alias("v")), sets, num, den)
        more = scratch.write(more, f"edges-{k}")
        if k > 1 and more.isEmpty():
            break
        edges = edges.unionByName(more)
        comp = scratch.write(connected(edges, scratch, f"cc{k}"), f"comp-{k}")
    # what is left: parts of different classes in one list, each pair once
    lab = labelled(comp, "parts-last")
    most = (lab.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("h").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.count(F.lit(1)).alias("k"))
            .where("k > 1").drop("k"))
    live = lab.join(most, "h")
    side = lambda s: [F.col(x).alias(s + x) for x in ("g", "n", "pos", "comp")]
    few = live.where("comp != most").select("h", *side("a"))
    need = F.ceil((F.col("an") + F.col("bn")) * num / (num + den))
    room = F.least(F.col("an") - F.col("apos"), F.col("bn") - F.col("bpos"))
    pairs = (few.join(live.select("h", "most", *side("b")), "h")
             .where((F.col("acomp") != F.col("bcomp")) & (F.col("ag") != F.col("bg")) & size_ok("an", "bn")
                    & ((F.col("bcomp") == F.col("most")) | (F.col("acomp") < F.col("bcomp"))))
             # the first shared shingle of a pair passes; a pair that only passes later is kept too
             .where(room >= need).select("ag", "acomp", "bg", "bcomp").distinct())
    who = classed(comp)
    mem = lambda s: who.select(*(F.col(x).alias(s + x) for x in ("g", "comp", "node")))
    rest = pairs.join(mem("a"), ["ag", "acomp"]).join(mem("b"), ["bg", "bcomp"])
    inner = who.groupBy("g").agg(F.count_distinct("comp").alias("k")).where("k > 1").select(F.col("g").alias("ag"))
    within = (mem("a").join(inner, "ag").join(mem("b").withColumnRenamed("bg", "ag"), "ag")
              .where("anode < bnode and acomp != bcomp"))
    ends = lambda d: d.select(F.least("anode", "bnode").alias("u"), F.greatest("anode", "bnode").alias("v"))
    every = ends(rest).unionByName(ends(within)).distinct()
    last = scratch.write(_verified(every, sets, num, den), "edges-last")
    if not last.isEmpty():
        comp = connected(edges.unionByName(last), scratch, "cc-last")
    scratch.drop("sets", "groups", "posts", "parts-last", "edges-last",
                 *(f"{t}-{k}" for t in ("parts", "edges") for k in range(STARS + 1)))
    return comp


def _joined(docs: DataFrame, num: int, den: int, size: int) -> tuple[DataFrame, DataFrame, Scratch]:
    """Rows of ``document_sets``, written, and ``(node, comp)`` of nodes that link with another."""
    rows_at_once(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = scratch.write(document_sets(docs, size), "rows")
    return rows, links(docs, rows, scratch, num, den, size), scratch


def document_classes(docs: DataFrame, num: int = 3, den: int = 4, size: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row; component_id is the smallest id of the class."""
    rows, comp, _ = _joined(docs, num, den, size)
    first = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    first = first.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = first.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = first.join(least, "comp").select("node", "component_id")
    return (rows.join(named, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def one_of_each(docs: DataFrame, num: int = 3, den: int = 4, size: int = 5) -> DataFrame:
    """``docs`` with one row of each class: of the smallest id, null ids last, the first row read among equals.

    Rows without words link with nothing and all stay. Texts aren't shuffled: see ``rows_at``.
    """
    rows, comp, scratch = _joined(docs, num, den, size)
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "part", "pos")
    first = rows.where("n > 0").groupBy("node").agg(F.min(best).alias("best"))
    first = first.join(comp, "node", "left").groupBy(F.coalesce("comp", "node").alias("comp")).agg(
        F.min("best").alias("best"))
    keep = first.select("best.part", "best.pos").unionByName(rows.where("n = 0").select("part", "pos"))
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    return rows_at(docs, keep, counts, scratch, "keep")
