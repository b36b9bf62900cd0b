"""Connected components of an edge table by label passing and pointer jumping, round by round in shared tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialized


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the smallest node of its component.

    Each round a node takes the least label among its neighbours' and its own, and then the label of that
    label, so the number of rounds grows with the logarithm of a component's diameter. Labels of a hub are
    combined before the shuffle. Edges with a null end are left out.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = materialized(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialized(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("root")), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("_m")))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "_m").alias("root"), F.col("root").alias("_was"))
        step = materialized(step, "labels")
        jump = step.select(F.col("node").alias("_node"), F.col("root").alias("_next"))
        labels = materialized(step.join(jump, F.col("root") == F.col("_node")).select("node", F.col("_next").alias("root"), "_was"), "labels")
        if labels.where("root <> _was").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
