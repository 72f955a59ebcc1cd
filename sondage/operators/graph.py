"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sondage.sources.files import remove, scratch, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of the undirected edges reaches.

    Smallest neighbouring label and then that label's own label before the
    round, until nothing changes, so the rounds grow with the logarithm of a
    component's diameter.
    Self loops and repeated edges change nothing; nodes that are null have no row.
    Both joins have an exchange on either side, so that a node with very many
    edges can be split. Every round is written to the shared folder, where the
    one before it is removed.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = written(pairs.where("a != b").union(pairs.where("a != b").select("b", "a")).distinct(), "edges")
    lone = pairs.where("a = b").select(F.col("a").alias("node"))
    path = scratch(spark, "labels")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels", path)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("over"))
        last, path = path, scratch(spark, "labels")
        new = written(step.join(up, "root").select("node", "old", F.col("over").alias("root")), "labels", path)
        moved = new.where("root != old").limit(1).count()
        remove(spark, last)
        labels = new.select("node", "root")
        if not moved:
            break
    return labels.union(lone.distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("root")))
