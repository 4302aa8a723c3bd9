"""Connected components as repeated contraction: each round at least halves the nodes that still have links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators.keyed import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``): the smallest node reachable.

    A round points each node at the smallest of itself and its neighbours, follows the pointers twice, and
    replaces the links by links between what they point at. Rounds grow as the logarithm of the longest path;
    each is written to the shared folder. A link of a node with itself makes it a node and nothing else.
    """
    links = cut_lineage(links.select("a", "b").distinct())
    labels = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct().withColumn("label", F.col("node"))
    edges = links.filter("a <> b")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_n")).select("node", F.least("node", "_n").alias("to")))
        onward = points.select(F.col("node").alias("to"), F.col("to").alias("next"))
        far = points
        for _ in range(2):
            far = far.join(onward, "to").select("node", F.col("next").alias("to"))
        points = cut_lineage(far, done=(points,))
        moved = points.select(F.col("node").alias("label"), "to")
        labels = cut_lineage(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), done=(labels,))
        a, b = points.select(F.col("node").alias("a"), F.col("to").alias("_a")), points.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        edges = cut_lineage(edges.join(a, "a").join(b, "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), done=(edges, points))
    return labels


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` indices reaches over the links."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new
