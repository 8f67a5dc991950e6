"""Union-find on a cluster: connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonmend.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node that has an edge to another; ``edges`` has longs a, b.

    Each round every node joins the neighbour that ranks lowest, or stays a
    root; edges are rewritten to the roots and loops and repeats dropped.  The
    first rounds rank by id, which collapses stars around a smallest id at once;
    later ones by a hash salted with the round, which shrinks any graph, chains
    included, by a constant factor.  ``comp`` is some node of the component.
    """
    edges = materialize(edges.filter("a <> b").select("a", "b").distinct(), "edges-0")
    labels, step = None, 0
    while labels is None or not edges.isEmpty():
        rank = lambda c, salt=step: F.xxhash64(c, F.lit(salt)) if salt > 1 else c
        best = F.min(F.struct(rank(F.col("b")).alias("rank"), F.col("b").alias("id")))
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = around.groupBy("a").agg(best.alias("best"))
        root: Column = F.when(F.col("best.rank") < rank(F.col("a")), F.col("best.id")).otherwise(F.col("a"))
        roots = materialize(roots.select(F.col("a").alias("node"), root.alias("comp")), f"roots-{step}")
        if labels is None:
            labels = roots
        else:
            up = roots.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            older = labels
            labels = materialize(older.join(up, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), f"labels-{step}")
        moved = edges.join(roots.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").join(roots.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b")
        older = edges
        edges = materialize(moved.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"edges-{step + 1}")
        discard(older)
        step += 1
    return labels
