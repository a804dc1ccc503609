"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.session import discard, keep


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, comp``: every node of the edges ``a, b`` with the smallest node of its component.

    Each round, every node hooks to its smallest neighbour if that is smaller, and then to what that one
    hooked to; edges are drawn anew between the roots, and those that became loops or repeat others go.
    So edges shrink from round to round, until none is left. The smallest node is combined on the map
    side and joins are plain equi-joins, so a node with very many edges is no bottleneck. Only the answer
    whether edges are left comes to the driver.
    """
    left = keep(edges.where("a <> b").select("a", "b").distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b"))
        hooks = keep(hooks.toDF("node", "comp"))
        over = hooks.toDF("_n", "_c")
        roots = keep(hooks.join(over, F.col("comp") == F.col("_n")).select("node", F.col("_c").alias("comp")))
        ends = left
        for end in ("a", "b"):
            root = roots.toDF(f"_n{end}", f"_r{end}")
            ends = ends.join(root, F.col(end) == F.col(f"_n{end}"))
        ends = ends.select(F.col("_ra").alias("a"), F.col("_rb").alias("b")).where("a <> b")
        new = keep(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if labels is None:
            labels = roots
        else:
            root = roots.toDF("_n", "_r")
            moved = labels.join(root, F.col("comp") == F.col("_n"), "left")
            labels = keep(moved.select("node", F.coalesce("_r", "comp").alias("comp")))
        discard(left)
        left = new
    return labels if labels is not None else left.toDF("node", "comp")
