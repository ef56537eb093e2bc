"""Connected components of links by hooking roots and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, discard


def roots(links: DataFrame) -> DataFrame:
    """(id, root) of every id that isn't the smallest of its component. links(a, b), either way round.

    Each round hooks every root that has a smaller neighbour to its least one, flattens the trees by pointer jumps, and
    keeps the links between different roots. A root that is left either got another hooked to it, or sees a smaller one in
    the next round, so two rounds at least halve the roots that still have links: about 2 log2(ids) rounds at most, and
    the loop ends when no link is left. Labels are pre-aggregated before each shuffle; the driver sees one row a job."""
    edges = cut(_both(links.select("a", "b")).where("a <> b").distinct(), "links")
    found = None
    while True:
        tree = _flat(edges)
        if found is None:
            found = tree
        else:
            up = tree.select(F.col("id").alias("of"), F.col("root").alias("top"))
            joined = found.join(up, found.root == up.of, "left").select("id", F.coalesce("top", "root").alias("root"))
            merged = cut(joined.unionByName(tree), "roots")
            discard(found)
            found = merged
        left, right = (tree.select(F.col("id").alias("of_" + x), F.col("root").alias("r" + x)) for x in "ab")
        moved = edges.join(left, edges.a == left.of_a, "left").join(right, F.col("b") == F.col("of_b"), "left")
        rest = cut(moved.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct(), "links")
        discard(edges)
        if tree is not found:
            discard(tree)
        edges = rest
        if not edges.limit(1).count():
            discard(edges)
            return found


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _flat(edges: DataFrame) -> DataFrame:
    """(id, root) of the ids with a smaller neighbour: hooked to the least one, then each to the top of its tree."""
    step, written = edges.groupBy("a").agg(F.min("b").alias("root")).where("root < a").withColumnRenamed("a", "id"), None
    while True:
        up = step.select(F.col("id").alias("of"), F.col("root").alias("top"))
        # A pointer whose target has one too may not be at the top yet.
        jumped = cut(step.join(up, step.root == up.of, "left").select("id", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("open")), "tree")
        if written is not None:
            discard(written)
        step, written = jumped.select("id", "root"), jumped
        if not jumped.where("open").limit(1).count():
            step._sparkgauge_path = jumped._sparkgauge_path
            return step
