"""Connected components of a graph given as edges, by minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketrank.functions.staging import stage


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is its component's least node.

    Every round takes the least root among the neighbours (combined in the map
    tasks, so a node with many edges does no harm) and then the root of that
    root. Both are staged, so a lost executor costs one round.
    """
    both = stage(
        edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    roots = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select(
            "node", F.least("node", "root").alias("root")
        ),
        "roots",
    )
    while True:
        near = both.join(roots, both.b == roots.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("next"))
        of_root = roots.select(F.col("node").alias("next"), F.col("root").alias("far"))
        moved = stage(
            lower.join(of_root, "next", "left").select(
                "node", "old", F.least("next", F.coalesce("far", "next")).alias("root")
            ),
            "roots",
        )
        changed = moved.filter("old <> root").limit(1).count()
        roots = moved.select("node", "root")
        if not changed:
            return roots
