"""Single linkage over a weighted graph (J1b): minimum spanning forest and components by Borůvka's rounds.

In each round every component takes its shortest edge to another one, in the
order ``(dist, a, b)`` that leaves no ties between different edges. The taken
edges belong to the forest; the components that they join become one. At
least half of the components that still have an edge go in each round, so a
graph of n nodes takes at most log2 n rounds, however wide it is.

* The shortest edge per component is one aggregation with partial sums on
  the map side, so a component that holds most edges is no hot key.
* Components that take each other's edge form a tree with one pair of mutual
  choices at its root; the smaller of the pair is the root, and pointers are
  halved until all name their root: log2 of the tree's depth steps.
* Between two components only the shortest edge is carried to the next round.
* Nodes meet their component once, after the last round: the rounds' pointers
  are joined backwards, the smallest round first.
* Every round is written to the checkpoint folder: lost executors cost a
  round's step, and the rounds' plans don't grow.

The merges of the single-linkage dendrogram are the forest's edges in the
order of ``(dist, a, b)``.

``by`` columns keep several graphs in one table apart. Edges ``(by.., a, b,
dist)`` are undirected. Defined cases: an edge with a null end or a null
length and an edge from a node to itself are no edges; of edges that repeat a
pair the shortest counts; a NaN length sorts last; without edges the forest
is empty and every node is a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import freeze


def _between(edges: DataFrame, by: list[str]) -> DataFrame:
    """The shortest edge of each pair of components: ``(by.., ca, cb, e)`` with ``e`` = (dist, a, b), ca < cb."""
    return (edges.where("ca <> cb")
            .select(*by, F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), "e")
            .groupBy(*by, "ca", "cb").agg(F.min("e").alias("e")))


def _roots(taken: DataFrame, by: list[str]) -> DataFrame:
    """``(by.., comp, root)`` of the components in ``taken`` (by.., comp, other)."""
    back = taken.select(*by, F.col("comp").alias("other"), F.col("other").alias("_back"))
    up = freeze(taken.join(back, [*by, "other"], "left").select(
        *by, "comp", F.when((F.col("_back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp"))
        .otherwise(F.col("other")).alias("root")))
    while True:
        above = up.select(*by, F.col("comp").alias("root"), F.col("root").alias("_above"))
        step = freeze(up.join(above, [*by, "root"]).select(
            *by, "comp", F.col("_above").alias("root"), (F.col("_above") != F.col("root")).alias("_moved")))
        up = step.drop("_moved")
        if not step.where("_moved").take(1):
            return up


def _rounds(edges: DataFrame, by: list[str]):
    """Each round's ``(taken, roots)``: taken is ``(by.., comp, e, other)``."""
    usable = edges.where("a is not null and b is not null and dist is not null")
    left = freeze(_between(usable.select(
        *by, F.col("a").alias("ca"), F.col("b").alias("cb"),
        F.struct("dist", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).alias("e")), by))
    while left.take(1):
        ends = left.select(*by, F.col("ca").alias("comp"), F.struct("e", F.col("cb").alias("other")).alias("t")).unionByName(
            left.select(*by, F.col("cb").alias("comp"), F.struct("e", F.col("ca").alias("other")).alias("t")))
        taken = freeze(ends.groupBy(*by, "comp").agg(F.min("t").alias("t")).select(*by, "comp", "t.e", "t.other"))
        roots = _roots(taken.select(*by, "comp", "other"), by)
        yield taken, roots
        # both ends of every edge left took an edge, so both have a root
        moved = (left.join(roots.select(*by, F.col("comp").alias("ca"), F.col("root").alias("_ra")), [*by, "ca"])
                 .join(roots.select(*by, F.col("comp").alias("cb"), F.col("root").alias("_rb")), [*by, "cb"]))
        left = freeze(_between(moved.select(*by, F.col("_ra").alias("ca"), F.col("_rb").alias("cb"), "e"), by))


def _joined(rounds: list[DataFrame], by: list[str]) -> DataFrame | None:
    """``(by.., comp, root)`` after all rounds for each component of the first one.

    From the last round back: a round has at most half the components of the
    one before, so all joins together read about two rows for each node,
    whatever the number of rounds.
    """
    to = None
    for roots in reversed(rounds):
        if to is None:
            to = roots
            continue
        later = to.select(*by, F.col("comp").alias("root"), F.col("root").alias("_last"))
        to = roots.join(later, [*by, "root"], "left").select(*by, "comp", F.coalesce("_last", "root").alias("root"))
    return to


def spanning_forest(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Edges ``(by.., a, b, dist)`` of the minimum spanning forest, a < b; ties go to the smaller (a, b)."""
    by = list(by or [])
    out = None
    for taken, _ in _rounds(edges, by):
        got = taken.select(*by, "e").distinct()   # both ends may have taken the same edge
        out = got if out is None else out.unionByName(got)
    if out is None:
        return edges.select(*by, "a", "b", "dist").where(F.lit(False))
    return freeze(out.select(*by, "e.a", "e.b", "e.dist"))


def components(nodes: DataFrame, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Connected components: ``(by.., id, comp)`` for each distinct ``(by.., id)`` of ``nodes``, comp = smallest id."""
    by = list(by or [])
    label = nodes.select(*by, "id").distinct().withColumn("_c", F.col("id"))
    to = _joined([roots for _, roots in _rounds(edges, by)], by)
    if to is not None:
        label = freeze(label.join(to.select(*by, F.col("comp").alias("_c"), F.col("root").alias("_r")), [*by, "_c"], "left")
                       .select(*by, "id", F.coalesce("_r", "_c").alias("_c")))
    # a graph may name nodes that the table lacks; the smallest id is that of a row of the table
    least = label.groupBy(*by, "_c").agg(F.min("id").alias("comp"))
    return label.join(least, [*by, "_c"]).select(*by, "id", "comp")
