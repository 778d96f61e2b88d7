"""Connected components of an edge list, by label propagation with pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``edges`` (columns ``a``, ``b``).

    A component's name is its smallest node. In each round a node takes the smallest label of
    its neighbours, then the label of that label, so star-like graphs end after two or three
    rounds. Labels are written to the checkpoint folder each round; only a count of changes
    comes to the driver. A node with very many neighbours meets them in joins that Spark may
    split, and sums of minima are taken before rows are shuffled.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = cut_lineage(new.join(of_label, "label").select("node", "old", F.least("label", "next").alias("label")))
        changed = jumped.filter("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
