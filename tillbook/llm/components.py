"""Connected components of a graph given by its edges, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillbook.llm.common import written


def _local_minima(edges: DataFrame) -> DataFrame:
    """(node, root): from each node to its least neighbour, and on from there, until a node has no smaller neighbour.

    Pointers are doubled until none moves, so a descent of d steps takes about log2(d) joins.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = both.unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = both.groupBy("node").agg(F.min("other").alias("other"))
    found = written(least.select("node", F.least("node", "other").alias("root")), "roots")
    while True:
        onward = found.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = found.join(onward, "root")
        found = written(jumped.select("node", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")), "roots")
        if found.where("moved").isEmpty():
            return found.select("node", "root")


def _between_roots(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges that lead from one root to another."""
    for end in "ab":
        edges = edges.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end)
    ends = edges.where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
    return ends.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of the component, for every node of an edge.

    ``edges`` has two bigint columns; direction and repetition don't matter, loops are ignored.
    Each round contracts the graph to its local minima. Each of them has taken in a neighbour at least,
    so a round leaves at most half of the nodes, and the least node of a component is
    always among them. Every step is written, so lineage stays short. The neighbours of a node are
    folded before their shuffle; joins are of two written tables, which the adaptive skew
    join splits at a node with very many edges.
    """
    first, second = (F.col(f"`{c}`") for c in edges.columns[:2])
    ends = edges.select(F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))
    current = written(ends.where("a < b").distinct(), "edges")
    found = None
    while not current.isEmpty():
        roots = _local_minima(current)
        current = written(_between_roots(current, roots), "edges")
        if found is None:
            found = roots
        else:
            onward = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = found.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            found = written(found, "found")
    if found is None:
        found = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.select("node", F.col("root").alias("component"))
