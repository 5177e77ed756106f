"""Connected components of an edge table, by minimum labels with pointer jumping on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.session import materialise

#: Labels are written by so many tasks at most, and one more for so many edges: short tables would else be a file a partition.
LEAST_TASKS, EDGES_A_TASK = 16, 1 << 17


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label of that label; it ends when nothing changes.
    Rounds are written tables, so joins meet plain sized sides (a hot node is split) and lost executors cost one round.
    Loops, repeated edges and both directions are allowed; an empty table gives an empty result.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.filter("a is not null and b is not null")
    tasks = LEAST_TASKS + both.count() // EDGES_A_TASK
    both = materialise(both.distinct().coalesce(tasks), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
    labels = materialise(labels.coalesce(tasks), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        closer = labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        closer = materialise(closer.coalesce(tasks), "labels")
        roots = closer.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        jumped = closer.join(roots, "root").select("node", F.col("jump").alias("root"), (F.col("jump") < F.col("old")).alias("moved"))
        jumped = materialise(jumped.coalesce(tasks), "labels")
        labels = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return labels
