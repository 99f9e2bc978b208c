"""Connected components by label propagation with pointer jumping, on tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the smallest node that is reachable.

    Each round takes the smallest label among a node and its neighbours, then the label of that label. Rounds go on until
    no label changes; their number follows the logarithm of the diameter. Every round is a written table, and minima are
    combined before the shuffle, so a node with very many edges costs no task more than its share.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "cc-edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "cc-labels")
    while True:
        nearby = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        pulled = labels.join(nearby, labels.node == nearby.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        ahead = labels.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        labels_next = pulled.join(ahead, F.col("via") == F.col("__n")).select("node", F.least("via", "__l").alias("label"), (F.least("via", "__l") < F.col("old")).alias("moved"))
        done, labels_next = labels, materialize(labels_next, "cc-labels")
        discard(done)
        labels = labels_next.select("node", "label")
        labels._scratch = labels_next._scratch
        if not labels_next.filter("moved").limit(1).count():
            discard(both)
            return labels
