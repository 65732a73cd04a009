"""Connected components of an undirected graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of an edge; label is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then follows the label's own label, so
    chains halve. Rounds end when nothing changes; rows with a null end and self-loops are ignored.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    both = checkpoint(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = checkpoint(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        near = both.join(labels, F.col("u") == F.col("node")).groupBy("v").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("v"), "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))  # plain on both sides, so a hot label can be split
        labels = checkpoint(step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        moved = labels.where("old != label").limit(1).count()
        labels = labels.select("node", "label")
        if not moved:
            return labels
