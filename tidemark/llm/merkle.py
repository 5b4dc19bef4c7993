"""Merkle manifest of a dataset: leaves per document, a subroot per source, one root, and proofs.

``H`` is the lowercase hex sha256 of its inputs in a row. A leaf is H of the
columns of a row. Leaves of a source stand in order of their id; every
``fanout`` consecutive nodes become their H until one remains, the subroot;
subroots in order of their sources (nulls first) become the root likewise.

1. **Places.** Rows are sorted by a range partition on (source, id, leaf),
   written, and numbered per source from sums per partition, so a source that
   holds a third of all rows is spread over many tasks.
2. **Slot pivot.** Nodes are grouped by (source, place div fanout). A
   conditional aggregate for each slot spreads a parent's children over
   ``fanout`` columns. The columns in a row hash to the parent; all but the
   own one are a child's siblings.
3. **Paths.** From the root down, a parent hands each child its own path with
   the child's siblings in front. Leaves are unfolded from the parents' rows,
   so siblings are never stored for each leaf. A parent's path is a few kilobytes,
   stored once for ``fanout`` children.

Only ids and digests are shuffled, texts never. The number of rounds is the
logarithm of the largest source's rows to the base ``fanout``.

Defined cases: null values hash as ``-``; rows with a null id come first in
their source; repeated ids are leaves of their own, ordered by leaf, and equal
leaves are interchangeable. A source with one row has its leaf as subroot; one
source's subroot is the root. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
POSITION = (1 << 33) - 1   # bits of monotonically_increasing_id that count rows of a partition
PATH = "array<struct<before:string,after:string>>"


def framed(value: Column) -> Column:
    """A value for hashing: its UTF-8 byte count, a colon and the value; ``-`` if null."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, columns)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``(source, doc_id, leaf, other)``; ``other`` is the leaf after tampering (lower-cased text), else null."""
    cols = [F.col(c) for c in COLUMNS]
    other = F.when(F.lit(False) if tampered is None else tampered,
                   leaf_hash([*cols[:-1], lower_ascii(cols[-1])]))
    return docs.select("source", "doc_id", leaf_hash(cols).alias("leaf"), other.alias("other"))


def numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with ``tree`` (number of the source in order), ``place`` in it (both from 0) and ``size`` of the tree."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    laid = scratch.write(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("part", F.spark_partition_id())
                         .withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit(POSITION))), "laid")
    runs = laid.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    # a source meets once for each partition it reaches into, a partition once for each source it holds
    of_source = Window.partitionBy("source").orderBy("part")
    before = F.coalesce(F.sum("n").over(of_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = (runs.withColumn("before", before).withColumn("size", F.sum("n").over(Window.partitionBy("source")))
            .withColumn("starts", (F.col("before") == 0).cast("long")))
    in_part = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_first())
    runs = scratch.write(runs.withColumn("upto", F.sum("starts").over(
        in_part.rowsBetween(Window.unboundedPreceding, 0))), "runs")
    parts = runs.groupBy("part").agg(F.sum("starts").alias("s"))
    parts = parts.select("part", F.coalesce(F.sum("s").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    runs = runs.join(parts, "part").select(
        "part", F.struct("source").alias("key"), "size", (F.col("before") - F.col("low")).alias("base"),
        (F.col("earlier") + F.col("upto") - 1).alias("tree"))
    return (laid.withColumn("key", F.struct("source")).alias("l")
            .join(runs.alias("r"), (F.col("l.part") == F.col("r.part")) & F.col("l.key").eqNullSafe(F.col("r.key")))
            .select("tree", (F.col("at") + F.col("base")).alias("place"), F.col("leaf").alias("node"), "size",
                    F.struct("doc_id", "other").alias("own")))


def pivot(nodes: DataFrame, fanout: int, own: bool) -> DataFrame:
    """One row for each parent, with its children in columns ``c0``, ``c1``, ... and their hash as its ``node``."""
    cells = [f"max(if(place % {fanout} = {k}, {c}, null)) as {c[0]}{k}"
             for c in ("node", *(["own"] if own else [])) for k in range(fanout)]
    up = nodes.groupBy("tree", F.expr(f"place div {fanout}").alias("place")).agg(
        *map(F.expr, cells), F.expr(f"ceil(max(size) / {fanout}) as size"))
    return up.withColumn("node", F.sha2(F.concat_ws("", *(f"n{k}" for k in range(fanout))), 256))


def climb(nodes: DataFrame, fanout: int, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Pivoted levels, lowest first, above ``(tree, place, node, size)``, and ``(tree, node)`` of the tops.

    ``size`` is the number of nodes that a tree has on a level; a tree of one node is done.
    """
    levels, tops = [], [nodes.where("size = 1").select("tree", "node")]
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        up = pivot(nodes.where("size > 1"), fanout, "own" in nodes.columns)
        nodes, most = scratch.write(up, f"{name}-{len(levels)}"), -(-most // fanout)
        levels.append(nodes)
        nodes = nodes.select("tree", "place", "node", "size")
        tops.append(nodes.where("size = 1").select("tree", "node"))
    return levels, functools.reduce(DataFrame.unionByName, tops)


def unfold(parents: DataFrame, fanout: int) -> DataFrame:
    """Children of pivoted rows; their siblings (all columns but the own one) come before the parent's path."""
    def others(slots):
        return "concat_ws('', " + ", ".join(["''", *(f"n{j}" for j in slots)]) + ")"

    own = "o0" in parents.columns
    child = [f"struct(place * {fanout} + {k} as place, n{k} as node, {f'o{k} as own, ' if own else ''}concat(array("
             f"struct({others(range(k))} as before, {others(range(k + 1, fanout))} as after)), path) as path)"
             for k in range(fanout)]
    rows = F.expr(f"explode(filter(array({', '.join(child)}), c -> c.node is not null))")
    return parents.select("tree", "top", rows.alias("x")).select("tree", "top", "x.*")


def descend(nodes: DataFrame, levels: list[DataFrame], top: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with their paths, from ``(tree, top, path)`` of their trees' tops down the levels."""
    cols = [c for c in nodes.columns if c != "size"]
    out = nodes.where("size = 1").join(top, "tree").select(*cols, "top", "path")
    down = None
    for up in reversed(levels):
        have = up.where("size = 1").select("tree", "place").join(top, "tree")
        if down is not None:
            have = have.unionByName(down.select("tree", "place", "top", "path"))
        down = unfold(up.join(have, ["tree", "place"]), fanout)
    return out if down is None else out.unionByName(down.select(*cols, "top", "path"))


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = 16) -> DataFrame:
    """``(doc_id, leaf, other, subroot, root, path)`` of every row.

    ``path`` lists, level by level up to the root, the siblings before and
    after the node, as hex digests in a row. ``other`` is the leaf after
    tampering where ``tampered`` holds, else null.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    nodes = scratch.write(numbered(leaves(docs, tampered), scratch), "rows")
    scratch.drop("laid", "runs")
    levels, tops = climb(nodes, fanout, scratch, "level")
    sources = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "node")
    sources = scratch.write(sources, "sources")
    sources = sources.withColumn("size", F.lit(sources.count()).cast("long"))
    upper, root = climb(sources, fanout, scratch, "upper")
    root = root.select("tree", F.col("node").alias("top"), F.array().cast(PATH).alias("path"))
    subroots = descend(sources, upper, root, fanout).select(
        F.col("place").alias("tree"), F.struct(F.col("node").alias("subroot"), F.col("top").alias("root")).alias("top"),
        "path")
    return descend(nodes, levels, subroots, fanout).select(
        "own.doc_id", F.col("node").alias("leaf"), "own.other", "top.subroot", "top.root", "path")


def proof_hash(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["before"], acc, p["after"]), 256))
