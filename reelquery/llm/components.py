"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): each node of `edges` (a, b), and the smallest node it reaches.

    Every round hooks a node to the neighbour of least hashed rank (hashing
    keeps chains short whatever the ids' order), follows one more hop, and
    contracts.  Loops and repeated edges do no harm; no edges give no rows.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("v"))
    edges = materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = materialise(
        edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels"
    )
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        hooks = hooks.select(
            F.col("a").alias("v"), F.when(F.col("m") < rank("a"), F.col("m.v")).otherwise(F.col("a")).alias("up")
        )
        hooks = materialise(hooks, "hooks")
        upper = hooks.select(F.col("v").alias("up"), F.col("up").alias("upper"))
        hooks = materialise(hooks.join(upper, "up").select("v", "upper"), "hooks")
        labels = materialise(
            labels.join(hooks, labels["label"] == hooks["v"], "left").select(
                "node", F.coalesce("upper", "label").alias("label")
            ),
            "labels",
        )
        a = hooks.select(F.col("v").alias("a"), F.col("upper").alias("na"))
        b = hooks.select(F.col("v").alias("b"), F.col("upper").alias("nb"))
        edges = edges.join(a, "a").join(b, "b").where("na <> nb")
        edges = edges.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
        edges = materialise(edges, "edges")
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(smallest, "label").select("node", "component")
