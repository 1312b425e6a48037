"""Connected components as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.common import Scratch


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the component's smallest node) for every node of ``edges(a, b)``.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots by
    doubling, and contracts the edges; a round at least halves the roots that have edges. State is
    written to the shared folder after every step, and deleted once the next step has written.
    """
    disk = Scratch(edges.sparkSession, "components")
    left = disk.write(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = disk.write(left.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    while not left.isEmpty():
        hook = disk.write(
            left.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        )
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            stepped = disk.write(hook.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
            hook = stepped
            if stepped.where("moved").isEmpty():
                break
        to = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
        old_labels, labels = labels, disk.write(labels.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        a = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        old_left, left = left, disk.write(
            left.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        )
        disk.drop(hook, old_labels, old_left)
    return labels
