"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowwarden.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of ``edges`` (longs ``a``, ``b``): ``node``, ``label``.

    Each round takes the smallest label among the neighbours, then follows labels one step, until nothing changes;
    the number of rounds grows with the logarithm of the longest path.  Every round is written, which cuts lineage.
    Nodes without an edge are not returned.
    """
    lined = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                        "edges")
    # a node with several smaller neighbours keeps the smallest, which takes over its links to the others
    least = lined.withColumn("m", F.min("a").over(Window.partitionBy("b")))
    fewer = least.select(F.col("m").alias("a"), "b").union(least.where("m <> a").select("m", F.col("a").alias("b"))).distinct()
    both = materialize(fewer.union(fewer.select("b", "a")), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        target = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = materialize(lower.join(target, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels
